"""The query catalogue: each operator over the driver tables, with the same query in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cleaning import block_group, is_valid_id, with_compound_parts
from ..functions.similarity import angle, nearest_feature
from ..operators import audit, clustering, disynthon, fusion, models, ranking, recipes, sampling, similarity_join, spatial, thresholds, validation
from ..operators.dedup import dedup, dedup_selection, stouffer_by
from ..functions.lineage import shared_dir
from ..sources import readers, store
from ..sources.readers import describe_files
from ..sources.sinks import cofold_inputs, coverage, in_chunks, submission_rows
from . import drivers, fixtures as fx, reports

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PAIR_THRESHOLD, Z_CUT, SWEEP = 60.0, 2.0, 50
N_PERM = 1000
PER_CHANNEL = 500


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.withColumns({c: F.round(c, 6) for c in columns or [c for c, t in df.dtypes if t == "double"]})


SEL = f"selection AS ({fx.SELECTION})"
VALID = "coalesce(smiles, '') SIMILAR TO '.*[Cc].*' AND length(coalesce(smiles, '')) > 10"
PART = "nullif(regexp_extract({c}, '^([A-Za-z]+[0-9]+(_[0-9]+)?)-([0-9]+)-([0-9]+)-([0-9]+)$', {i}), '')"
LIB, B1, B2, B3 = (PART.format(c="compound", i=i) for i in (1, 3, 4, 5))
TENTH = "CAST(0.1 AS DOUBLE)"
BASE = f"count_target >= 3 AND count_inhibitor < {TENTH} * count_target AND count_ntc = 0 AND historic_hits < 5"
OTHER = f"count_inhibitor < {TENTH} * count_target AND count_ntc = 0 AND historic_hits < 5"
DEDUP = f"""{SEL}, dd AS (SELECT smiles, CAST(sum(count_target) AS BIGINT) AS count_target, CAST(sum(count_inhibitor) AS BIGINT) AS count_inhibitor,
  CAST(sum(count_ntc) AS BIGINT) AS count_ntc, max(historic_hits) AS historic_hits, min(compound) AS compound,
  sum(zscore) / sqrt(count(*)) AS zscore, max(CASE WHEN {BASE} THEN 1 ELSE 0 END) AS own FROM selection WHERE {VALID} GROUP BY smiles)"""
PAIRS = f"""{DEDUP}, melted AS (SELECT smiles, historic_hits, count_target, count_inhibitor, count_ntc,
  unnest(['AB:' || {LIB} || ':' || {B1} || ':' || {B2}, 'AC:' || {LIB} || ':' || {B1} || ':' || {B3}, 'BC:' || {LIB} || ':' || {B2} || ':' || {B3}]) AS disynthon_id FROM dd),
 pooled AS (SELECT disynthon_id, CAST(sum(count_target) AS BIGINT) AS count_target, CAST(sum(count_inhibitor) AS BIGINT) AS count_inhibitor, CAST(sum(count_ntc) AS BIGINT) AS count_ntc
  FROM melted WHERE disynthon_id IS NOT NULL GROUP BY disynthon_id)"""
HIT = f"count_inhibitor < {TENTH} * count_target AND count_ntc < {TENTH} * count_target"


@query("clean_valid_ids", f"WITH {SEL} SELECT smiles, {VALID} AS valid, CAST(count(*) AS BIGINT) AS n FROM selection GROUP BY ALL")
def _(s, d):
    return fx.selection(s, d).groupBy("smiles", is_valid_id(C("smiles")).alias("valid")).agg(F.count("*").alias("n"))


@query("parse_compound_id", f"WITH {SEL} SELECT DISTINCT compound, {LIB} AS library, {B1} AS bb1, {B2} AS bb2, {B3} AS bb3 FROM selection")
def _(s, d):
    return with_compound_parts(fx.selection(s, d).select("compound").distinct())


@query("dedup_counts", f"WITH {DEDUP} SELECT smiles, count_target, count_inhibitor, count_ntc, historic_hits, compound FROM dd")
def _(s, d):
    return dedup_selection(fx.selection(s, d)).select("smiles", "count_target", "count_inhibitor", "count_ntc", "historic_hits", "compound")


@query("dedup_general", f"WITH {SEL} SELECT smiles, CAST(sum(count_target) AS BIGINT) AS count_target, max(historic_hits) AS historic_hits, arg_min(compound, zscore) AS compound FROM selection WHERE {VALID} GROUP BY smiles HAVING count(*) = count(DISTINCT zscore)")
def _(s, d):
    rows = fx.selection(s, d)
    clear = rows.groupBy("smiles").agg(F.count("*").alias("n"), F.countDistinct("zscore").alias("k")).where("n = k").select("smiles")  # the order has no ties
    found = dedup(rows.select("smiles", "count_target", "historic_hits", "compound", "zscore"), ["count_target"], ["historic_hits"], ["compound"], order="zscore")
    return found.join(clear, "smiles", "left_semi")


@query("block_groups", f"WITH {SEL} SELECT {LIB} || '-' || {B1} || '-' || {B2} AS block_group, count(*) AS n FROM selection GROUP BY 1")
def _(s, d):
    parts = with_compound_parts(fx.selection(s, d))
    return parts.groupBy(block_group(C("library"), C("bb1"), C("bb2")).alias("block_group")).agg(F.count("*").alias("n"))


@query("template_overlap", f"WITH {SEL}, sup AS ({fx.SUPPLEMENT}) SELECT count(*) AS n FROM sup WHERE smiles IN (SELECT smiles FROM selection)")
def _(s, d):
    return reports.template_overlap(fx.supplement(s, d), fx.selection(s, d))


@query("dedup_stouffer", f"WITH {SEL} SELECT smiles, round(sum(zscore) / sqrt(count(*)), 8) AS zscore FROM selection WHERE smiles IS NOT NULL GROUP BY smiles")
def _(s, d):
    return stouffer_by(fx.selection(s, d)).withColumn("zscore", F.round("zscore", 8))  # z has seven decimals: no ties


_LABELS = {
    "label_l0": ("l0", (), BASE),
    "label_l1": ("l1", (), f"count_target > 3 AND (count_inhibitor = 0 OR count_inhibitor < {TENTH} * count_target) AND (count_ntc = 0 OR count_ntc < {TENTH} * count_target) AND historic_hits < 5"),
    "label_l2": ("l2", (), f"{BASE} AND own = 1"),
    "label_l3": ("l3", (Z_CUT,), f"zscore >= 2 AND {OTHER}"),
    "label_l4": ("l4", (), f"count_target >= 10 AND {OTHER}"),
    "label_l5": ("l5", (), "count_target >= 3 AND count_ntc = 0 AND historic_hits < 5"),
    "label_l6": ("l6", ({"qDOS0": 4, "qDOS1": 4, "qDOS2": 3, "qDOS3": 3, "qDOS4": 2},), f"count_target >= CASE {LIB} WHEN 'qDOS0' THEN 4 WHEN 'qDOS1' THEN 4 WHEN 'qDOS2' THEN 3 WHEN 'qDOS3' THEN 3 WHEN 'qDOS4' THEN 2 END AND {OTHER}"),
    "label_l7": ("l7", (Z_CUT,), f"count_target >= 3 AND count_inhibitor < {TENTH} * count_target AND historic_hits < 5 AND zscore >= 2"),
}
for _name, (_key, _args, _where) in _LABELS.items():

    def _label(s, d, key=_key, args=_args):
        return recipes.label(fx.selection(s, d), key, *args).rows.where("positive").select("smiles", "compound", "count_target")

    query(_name, f"WITH {DEDUP} SELECT smiles, compound, count_target FROM dd WHERE {_where}")(_label)


@query("label_l8", f"WITH {PAIRS} SELECT DISTINCT m.smiles FROM melted m JOIN pooled p USING (disynthon_id) WHERE m.historic_hits < 5 AND p.count_target >= 60 AND p.count_inhibitor < {TENTH} * p.count_target AND p.count_ntc < {TENTH} * p.count_target")
def _(s, d):
    return recipes.label(fx.selection(s, d), "l8", PAIR_THRESHOLD).rows.where("positive").select("smiles")


@query("recipe_yields", f"""WITH {DEDUP} SELECT recipe, n_unique, n_positives, round(n_positives / n_unique, 6) AS rate FROM (
  SELECT CAST(count(*) AS BIGINT) AS n_unique, unnest(['l0', 'l1', 'l2', 'l3', 'l4', 'l5', 'l7']) AS recipe,
   unnest([{', '.join(f'count(*) FILTER ({_LABELS[f"label_{k}"][2]})' for k in ('l0', 'l1', 'l2', 'l3', 'l4', 'l5', 'l7'))}]) AS n_positives FROM dd)""")  # fmt: skip
def recipe_yields(s, d):
    """Yields of the recipes from one shared aggregate."""
    rows = recipes.label_many(fx.selection(s, d), l0=None, l1=None, l2=None, l3=Z_CUT, l4=None, l5=None, l7=Z_CUT)
    names = [c for c in rows.columns if c.startswith("is_")]
    one = rows.agg(F.count("*").alias("n_unique"), *(F.count_if(n).alias(n) for n in names))
    out = one.unpivot("n_unique", names, "recipe", "n_positives").withColumn("recipe", F.substring("recipe", 4, 9))
    return out.select("recipe", "n_unique", "n_positives", F.round(C("n_positives") / C("n_unique"), 6).alias("rate"))


@query("dedup_order_diagnostic", f"WITH {DEDUP} SELECT (SELECT count(*) FROM selection WHERE {BASE} AND {VALID}) AS n_raw_passing, count(*) FILTER ({BASE}) AS n_dedup_first, count(*) FILTER (own = 1) AS n_threshold_first FROM dd")
def _(s, d):
    return audit.dedup_order(fx.selection(s, d))


@query("only_from_summing", f"WITH {DEDUP} SELECT count(*) AS n_positives, count(*) FILTER (own = 0) AS n_only_from_summing, round(count(*) FILTER (own = 0) / count(*), 6) AS fraction FROM dd WHERE {BASE}")
def _(s, d):
    return _r(audit.only_from_summing(fx.selection(s, d)))


@query("disynthon_melt", f"WITH {PAIRS} SELECT disynthon_id, count_target, count_inhibitor, count_ntc FROM melted")
def _(s, d):
    return disynthon.melt(dedup_selection(fx.selection(s, d)))


@query("disynthon_agg", f"WITH {PAIRS} SELECT * FROM pooled")
def _(s, d):
    return disynthon.aggregate(disynthon.melt(dedup_selection(fx.selection(s, d))))


@query("disynthon_hits", f"WITH {PAIRS} SELECT *, count_target >= 60 AND {HIT} AS hit FROM pooled")
def _(s, d):
    return disynthon.classify(disynthon.aggregate(disynthon.melt(dedup_selection(fx.selection(s, d)))), PAIR_THRESHOLD)


_CUT = "SELECT {n} AS target_size, min(z) AS z_cutoff FROM (SELECT zscore AS z FROM dd WHERE {o} ORDER BY z DESC LIMIT {n})"


@query("zcut_for_size", f"WITH {DEDUP}, k AS (SELECT count(*) AS n FROM dd WHERE {BASE}), r AS (SELECT zscore AS z, row_number() OVER (ORDER BY zscore DESC) AS rn FROM dd WHERE {OTHER}), c AS (SELECT min(z) AS z_cutoff FROM r, k WHERE rn <= n) SELECT round(z_cutoff, 6) AS z_cutoff, (SELECT count(*) FROM r WHERE z >= z_cutoff) AS n_at_cutoff, (SELECT count(*) FROM r WHERE z >= z_cutoff) - k.n AS delta FROM c, k")
def _(s, d):
    rows = recipes.deduplicated(fx.selection(s, d))
    return _r(thresholds.z_cutoff_for_size(thresholds.other_criteria(rows), rows.where(recipes.base()).count()), "z_cutoff")


@query("threshold_report", f"WITH {DEDUP}, o AS (SELECT zscore AS z, row_number() OVER (ORDER BY zscore DESC) AS rn FROM dd WHERE {BASE.split(' AND count_ntc')[0]} AND historic_hits < 5), s AS (SELECT unnest([50, 200, 1000]) AS n), c AS (SELECT n, min(z) AS c FROM s, o WHERE rn <= n GROUP BY n) SELECT CAST(n AS BIGINT) AS target_size, round(c, 6) AS z_cutoff, (SELECT count(*) FROM o WHERE z >= c) AS n_at_cutoff FROM c")
def _(s, d):
    return _r(reports.derive_thresholds(fx.selection(s, d), sizes=[50, 200, 1000])["size_sweep"], "z_cutoff")


@query("library_floor_search", f"""WITH {DEDUP}, o AS (SELECT avg(CASE WHEN {BASE} THEN 1.0 ELSE 0.0 END) AS rate FROM dd),
 l AS (SELECT {LIB} AS library, count_target, ({OTHER}) AS ok FROM dd), t AS (SELECT unnest(range(1, {SWEEP + 1})) AS floor),
 e AS (SELECT library, floor, abs(count(*) FILTER (ok AND count_target >= floor) / count(*) - (SELECT rate FROM o)) AS err FROM l, t WHERE library IS NOT NULL GROUP BY library, floor)
 SELECT library, CAST(arg_min(floor, (err, floor)) AS INTEGER) AS floor FROM e GROUP BY library""")  # fmt: skip
def _(s, d):
    return thresholds.library_floors(recipes.deduplicated(fx.selection(s, d)), SWEEP)


@query("l7_sweep", f"WITH {DEDUP}, o AS (SELECT zscore AS z, row_number() OVER (ORDER BY zscore DESC) AS rn FROM dd WHERE {BASE.split(' AND count_ntc')[0]} AND historic_hits < 5), s AS (SELECT unnest([100, 500]) AS n), c AS (SELECT n, min(z) AS c FROM s, o WHERE rn <= n GROUP BY n) SELECT CAST(n AS BIGINT) AS target_size, round(c, 6) AS z_cutoff, (SELECT count(*) FROM o WHERE z >= c) AS n_at_cutoff FROM c")
def _(s, d):
    rows = recipes.deduplicated(fx.selection(s, d))
    return _r(thresholds.size_sweep(thresholds.joint_criteria(rows), [100, 500]), "z_cutoff")


@query("l8_sweep", f"""WITH {PAIRS}, t AS (SELECT unnest([CAST(20 AS DOUBLE), 60, 120]) AS threshold), h AS (SELECT threshold, disynthon_id FROM pooled, t WHERE count_target >= threshold AND {HIT})
 SELECT threshold, count(DISTINCT disynthon_id) AS n_hit_disynthons, (SELECT count(DISTINCT smiles) FROM melted m JOIN h h2 USING (disynthon_id) WHERE h2.threshold = h.threshold AND historic_hits < 5) AS n_positives FROM h GROUP BY threshold""")  # fmt: skip
def _(s, d):
    return thresholds.pair_threshold_sweep(recipes.deduplicated(fx.selection(s, d)), [20, 60, 120])


@query("pair_count_percentiles", f"WITH {PAIRS} SELECT unnest([50.0, 75.0, 90.0, 95.0, 99.0, 99.9])::DOUBLE AS percentile, unnest([{', '.join(f'round(quantile_cont(count_target, {q}), 6)' for q in (0.5, 0.75, 0.9, 0.95, 0.99, 0.999))}]) AS value FROM pooled")
def _(s, d):
    return _r(thresholds.count_percentiles(disynthon.aggregate(disynthon.melt(dedup_selection(fx.selection(s, d))))), "value")


@query("audit_zero_rows", f"WITH {SEL} SELECT count(*) FILTER (count_target = 0) AS n_zero, count(*) AS n_rows FROM selection")
def _(s, d):
    return audit.zero_target_rows(fx.selection(s, d))


@query("audit_singletons", f"WITH {SEL} SELECT round(count(*) FILTER (count_target = 1) / count(*), 6) AS singleton_fraction FROM selection")
def _(s, d):
    return _r(audit.singleton_fraction(fx.selection(s, d)))


SUP = f"supplement AS ({fx.SUPPLEMENT})"


@query("audit_totals", f"WITH {SEL}, {SUP} SELECT CAST(sum(count_target) AS BIGINT) AS total_target, CAST(sum(count_inhibitor) AS BIGINT) AS total_inhibitor, CAST(sum(count_ntc) AS BIGINT) AS total_ntc, CAST(sum(count_ntc) + (SELECT sum(count_ntc) FROM supplement) AS BIGINT) AS total_ntc_combined FROM selection")
def _(s, d):
    return audit.read_totals(fx.selection(s, d), fx.supplement(s, d))


@query("audit_library_counts", f"WITH {SEL} SELECT {LIB} AS library, count(*) AS n_rows FROM selection GROUP BY 1")
def _(s, d):
    return audit.library_row_counts(fx.selection(s, d))


@query("audit_invalid_share", f"WITH {SEL} SELECT count(*) AS n_passing, count(*) FILTER (NOT ({VALID})) AS n_invalid, count(*) FILTER ({VALID}) AS n_valid, round(count(*) FILTER (NOT ({VALID})) / count(*), 6) AS fraction_invalid FROM selection WHERE {BASE}")
def _(s, d):
    return _r(audit.invalid_share(fx.selection(s, d)))


@query("audit_supplement_overlap", f"""WITH {SEL}, {SUP}, g AS (SELECT smiles, count(*) AS n, sum(count_ntc) AS c FROM supplement WHERE smiles IS NOT NULL AND trim(smiles) <> '' GROUP BY smiles),
 m AS (SELECT smiles, sum(count_ntc) AS c FROM selection GROUP BY smiles), b AS (SELECT count(*) AS overlapping, count(*) FILTER (m.c = g.c) AS agreements FROM m JOIN g USING (smiles))
 SELECT (SELECT count(*) FROM supplement WHERE smiles IS NULL OR trim(smiles) = '') AS blank_rows, (SELECT count(*) FROM g WHERE n > 1) AS repeated_groups, overlapping, agreements, overlapping - agreements AS disagreements FROM b""")  # fmt: skip
def _(s, d):
    return audit.supplement_overlap(fx.selection(s, d), fx.supplement(s, d))


SLOPES = f"sl AS (SELECT library, count(*) AS n, sum(x * y) / sum(x * x) AS slope, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM (SELECT {LIB} AS library, CAST(count_target AS DOUBLE) AS x, zscore AS y FROM selection WHERE count_target > 3) WHERE library IS NOT NULL GROUP BY library HAVING count(*) >= 10)"


@query("audit_z_slope", f"WITH {SEL}, {SLOPES} SELECT library, n, round(slope, 6) AS slope, round(1 - (yy - 2 * slope * xy + slope * slope * xx) / yy, 6) AS r2 FROM sl")
def _(s, d):
    return _r(audit.z_count_slopes(fx.selection(s, d), 3))


@query("audit_z_summary", f"WITH {SEL}, {SLOPES} SELECT (SELECT count(*) FROM selection WHERE zscore <= 0) AS n_nonpositive, (SELECT round(min(zscore), 6) FROM selection) AS z_min, (SELECT round(max(zscore), 6) FROM selection) AS z_max, round(max(slope) FILTER (slope > 0) / min(slope) FILTER (slope > 0), 6) AS slope_ratio, round(min(1 - (yy - 2 * slope * xy + slope * slope * xx) / yy), 6) AS min_r2 FROM sl")
def _(s, d):
    return _r(audit.z_count_summary(fx.selection(s, d), 3))


@query("audit_enumeration_gap", f"""WITH {SEL}, en AS ({fx.ENUMERATION}), u AS (SELECT compound, max(count_target) AS c, compound NOT IN (SELECT compound FROM en) AS missing FROM selection GROUP BY compound)
 SELECT {', '.join(f'count(*) FILTER ({b}) AS n_{k}, count(*) FILTER ({b} AND missing) AS missing_{k}, round(count(*) FILTER ({b} AND missing) / count(*) FILTER ({b}), 6) AS rate_{k}' for k, b in (('all', 'true'), ('eq_1', 'c = 1'), ('ge_3', 'c >= 3'), ('ge_10', 'c >= 10')))} FROM u""")  # fmt: skip
def _(s, d):
    return _r(audit.enumeration_gap(fx.selection(s, d), fx.enumeration(s, d)))


@query("audit_group_sizes", f"WITH {SEL}, g AS (SELECT smiles, count(*) AS n FROM selection GROUP BY smiles) SELECT n AS n_rows, count(*) AS n_groups FROM g GROUP BY n")
def _(s, d):
    return audit.group_size_histogram(fx.selection(s, d))


@query("audit_group_enrichment", f"WITH {DEDUP}, g AS (SELECT smiles, count(*) AS n FROM selection GROUP BY smiles), p AS (SELECT g.n, d.smiles IS NOT NULL AS pos FROM g LEFT JOIN (SELECT smiles FROM dd WHERE {BASE}) d USING (smiles)), f AS (SELECT count(*) FILTER (n > 1) / count(*) AS a, count(*) FILTER (n > 1 AND pos) / count(*) FILTER (pos) AS b FROM p) SELECT round(a, 6) AS fraction_all, round(b, 6) AS fraction_positives, round(b / a, 6) AS enrichment FROM f")
def _(s, d):
    sel = fx.selection(s, d)
    return _r(audit.group_size_enrichment(sel, recipes.label(sel, "l0").rows.where("positive")))


@query("describe_table", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({c} IS NULL) / count(*) AS null_rate, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS largest FROM customer" for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))) + ")")
def _(s, d):
    return describe_files(s, f"{d}/customer.parquet")


CH = f"channels AS ({fx.CHANNELS}), scaled AS (SELECT row_idx, channel, CASE WHEN score IS NULL THEN NULL WHEN max(score) OVER w <= min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM channels WINDOW w AS (PARTITION BY channel)), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, row_idx) AS rank FROM channels WHERE score IS NOT NULL) WHERE rank <= {PER_CHANNEL}), rrf AS (SELECT row_idx, sum(CASE channel WHEN 'draw' THEN 2.0 ELSE 1.0 END::DOUBLE / (60 + rank)) AS rrf FROM top GROUP BY row_idx), series AS (SELECT r.row_idx, rrf, row_idx % 7 AS series, CAST(round(rrf, 9) AS DOUBLE) AS key FROM rrf r)"
WEIGHTS = {"draw": 2.0}


@query("minmax_channels", f"WITH {CH} SELECT row_idx, channel, round(score, 6) AS score FROM scaled")
def _(s, d):
    return _r(fusion.min_max(fx.channels(s, d)))


@query("rrf_fusion", f"WITH {CH} SELECT row_idx, round(rrf, 9) AS rrf FROM rrf")
def _(s, d):
    return fusion.reciprocal_rank(fx.channels(s, d), PER_CHANNEL, WEIGHTS).withColumn("rrf", F.round("rrf", 9))


@query("combined_score", f"WITH {CH} SELECT row_idx, round(coalesce(max(score), 0), 6) AS score FROM scaled GROUP BY row_idx")
def _(s, d):
    return _r(fusion.combined_score(fx.channels(s, d)))


_PICKS = "picks AS (SELECT row_idx, key AS rrf, series, row_number() OVER (ORDER BY rep, key DESC, row_idx) AS pick FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY key DESC, row_idx) > 1 THEN 1 ELSE 0 END AS rep FROM series) QUALIFY pick <= 50)"


def _picks(s, d):
    ranked = fusion.reciprocal_rank(fx.channels(s, d), PER_CHANNEL, WEIGHTS).withColumn("rrf", F.round("rrf", 9)).withColumn("series", C("row_idx") % 7)
    return fusion.greedy_diverse(ranked, 50)


@query("greedy_diverse_picks", f"WITH {CH}, {_PICKS} SELECT row_idx, series, CAST(pick AS INTEGER) AS pick FROM picks")
def _(s, d):
    return _picks(s, d).select("row_idx", "series", "pick")


@query("shortlist_union", f"WITH {CH} SELECT row_idx, count(*) AS n_sources, string_agg(channel, ';' ORDER BY channel) AS sources FROM top GROUP BY row_idx")
def _(s, d):
    return fusion.shortlist(fx.channels(s, d), PER_CHANNEL)


_N = {"draw": 40, "length": 60}
SHORT = "sh AS (SELECT row_idx, count(*) AS n_sources, string_agg(channel, ';' ORDER BY channel) AS sources FROM top WHERE rank <= CASE channel WHEN 'draw' THEN 40 WHEN 'length' THEN 60 ELSE 0 END GROUP BY row_idx)"


def _ids(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(C("doc_id").alias("row_idx"), F.concat(F.lit("D"), C("doc_id").cast("string")).alias("CatalogID"))


@query("shortlist_by_channel", f"WITH {CH}, {SHORT} SELECT row_idx, n_sources, sources, CatalogID, CAST(row_number() OVER (ORDER BY n_sources DESC, CatalogID) AS INTEGER) AS place FROM (SELECT *, 'D' || CAST(row_idx AS VARCHAR) AS CatalogID FROM sh)")
def _(s, d):
    return fusion.shortlist_table(fusion.shortlist(fx.channels(s, d), _N), _ids(s, d))


@query("channel_members", f"WITH {CH}, {SHORT} SELECT channel, count(*) AS n FROM (SELECT unnest(string_split(sources, ';')) AS channel FROM sh) GROUP BY channel")
def _(s, d):
    return fusion.channel_members(fusion.shortlist(fx.channels(s, d), _N))


@query("series_counts", f"WITH {CH}, {_PICKS} SELECT (SELECT count(DISTINCT series) FROM series) AS n_series_pool, (SELECT count(DISTINCT series) FROM picks) AS n_series_picked")
def _(s, d):
    ranked = fusion.reciprocal_rank(fx.channels(s, d), PER_CHANNEL, WEIGHTS).withColumn("series", C("row_idx") % 7)
    return fusion.series_counts(ranked, _picks(s, d))


@query("naive_top", "SELECT doc_id AS row_idx, CAST(n_chars AS DOUBLE) AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def _(s, d):
    return fusion.naive_top(fx.channels(s, d).where("channel = 'length'")).select("row_idx", "score")


def _submission(s, d):
    template = s.read.parquet(f"{d}/documents.parquet").select(C("doc_id").alias("row_idx"), F.concat(F.lit("D"), C("doc_id").cast("string")).alias("CatalogID"))
    return template, submission_rows(template, _picks(s, d), fusion.combined_score(fx.channels(s, d)))


@query("submission_rows", f"WITH {CH}, {_PICKS}, cs AS (SELECT row_idx, coalesce(max(score), 0) AS score FROM scaled GROUP BY row_idx) SELECT 'D' || CAST(row_idx AS VARCHAR) AS CatalogID, CASE WHEN row_idx IN (SELECT row_idx FROM picks) THEN 1 ELSE 0 END AS Sel_50, round(score, 6) AS Score FROM cs")
def _(s, d):
    return _r(_submission(s, d)[1])


@query("submission_problems", f"""WITH {CH}, {_PICKS}, cs AS (SELECT row_idx, coalesce(max(score), 0) AS score FROM scaled GROUP BY row_idx),
 rows AS (SELECT 'D' || CAST(row_idx AS VARCHAR) AS id, CASE WHEN row_idx IN (SELECT row_idx FROM picks) THEN 1 ELSE 0 END AS sel, score FROM cs WHERE row_idx <> 0),
 tp AS (SELECT 'D' || CAST(doc_id AS VARCHAR) AS id FROM documents),
 c AS (SELECT unnest(['ids differ from the template', 'repeated ids', 'not 51 selected', 'Sel_50 isn''t 0 or 1', 'missing scores', 'row count differs from the template']) AS problem,
  unnest([(SELECT count(*) FROM (FROM rows SELECT id EXCEPT FROM tp SELECT id)) + (SELECT count(*) FROM (FROM tp SELECT id EXCEPT FROM rows SELECT id)) > 0, (SELECT count(*) <> count(DISTINCT id) FROM rows), (SELECT sum(sel) <> 51 FROM rows),
   (SELECT count(*) FILTER (sel NOT IN (0, 1)) > 0 FROM rows), (SELECT count(*) FILTER (score IS NULL) > 0 FROM rows), (SELECT count(*) FROM rows) <> (SELECT count(*) FROM tp)]) AS bad)
 SELECT problem FROM c WHERE bad""")
def _(s, d):
    template, rows = _submission(s, d)
    return validation.scored_list_problems(rows.where("CatalogID != 'D0'"), template, 51)


RK = f"ranked AS ({fx.RANKED}), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_idx) AS rn FROM ranked), n AS (SELECT count(*) AS n, sum(label) AS p FROM ranked)"
_LOGAUC = "(SELECT sum(log10(n.n - n.p) - log10(greatest(fp, 1))) / n.p / log10(n.n - n.p) FROM (SELECT rn - row_number() OVER (ORDER BY rn) AS fp FROM o WHERE label = 1))"


def _ranked(s, d):
    return ranking.scored(fx.ranked(s, d))


@query("enrichment_at_k", f"WITH {RK} SELECT round((SELECT sum(label) FROM o WHERE rn <= 50) / 50.0 / (p / n), 6) AS ef FROM n")
def _(s, d):
    return _r(ranking.enrichment(_ranked(s, d), 50))


@query("enrichment_pct", f"WITH {RK} SELECT round((SELECT sum(label) FROM o, n WHERE rn <= greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0))) / greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0)) / (p / n), 6) AS ef FROM n")
def _(s, d):
    return _r(ranking.enrichment_pct(_ranked(s, d), 0.1))


@query("log_auc", f"WITH {RK} SELECT round({_LOGAUC}, 6) AS log_auc FROM n")
def _(s, d):
    return _r(ranking.log_auc(_ranked(s, d)))


@query("roc_auc", f"WITH {RK}, a AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM ranked) SELECT round((sum(r) FILTER (label = 1) - max(p) * (max(p) + 1) / 2) / (max(p) * (max(n) - max(p))), 6) AS roc_auc FROM a, n")
def _(s, d):
    return _r(ranking.roc_auc(_ranked(s, d)))


@query("avg_precision", f"WITH {RK}, g AS (SELECT score, sum(label) AS k, count(*) AS m FROM ranked GROUP BY score), c AS (SELECT k, sum(k) OVER w AS tp, sum(m) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(k * tp / seen) / sum(k), 6) AS average_precision FROM c")
def _(s, d):
    return _r(ranking.average_precision(_ranked(s, d)))


@query("ranking_summary", f"WITH {RK} SELECT n AS n_total, CAST(p AS BIGINT) AS n_hits, round((SELECT sum(label) FROM o, n WHERE rn <= least(50, n)) / least(50, n) / (p / n), 6) AS ef_50, round((SELECT sum(label) FROM o, n WHERE rn <= greatest(1, round_even(n * CAST(0.01 AS DOUBLE), 0))) / greatest(1, round_even(n * CAST(0.01 AS DOUBLE), 0)) / (p / n), 6) AS ef_1pct, round({_LOGAUC}, 6) AS log_auc FROM n")
def _(s, d):
    return _r(ranking.summarize(_ranked(s, d)))


_U = "CAST({} AS UHUGEINT)".format
_TOP = _U("'18446744073709551616'")


def _mixed(source: str, x: str, keep: str) -> str:
    """A subquery with h, the splitmix64 of x, beside the columns kept."""
    step = lambda shift, by, inner: f"(SELECT {keep}, CAST({_U(f'xor(z, z >> {shift})')} * {_U(repr(str(by)))} % {_TOP} AS UBIGINT) AS z FROM {inner})"
    first = f"(SELECT {keep}, CAST(({_U(x)} + {_U(repr(str(0x9E3779B97F4A7C15)))}) % {_TOP} AS UBIGINT) AS z FROM {source})"
    return f"(SELECT {keep}, xor(z, z >> 31) AS h FROM {step(27, 0x94D049BB133111EB, step(30, 0xBF58476D1CE4E5B9, first))})"


def _draws(size: str, draws: int, seed: int) -> str:
    """CTEs up to dw (draw, place): Floyd's draws of m of n rows; ``size`` selects n and m."""
    return f"""dk AS (SELECT draw, h AS key FROM {_mixed(f"range({draws}) t(draw)", f"{seed << 32} + draw", "draw")}), dz AS ({size}),
 dj AS (SELECT draw, key, CAST(unnest(range(CAST(n - m AS BIGINT), CAST(n AS BIGINT))) AS UBIGINT) AS j FROM dk, dz),
 dt AS MATERIALIZED (SELECT draw, CAST(j AS BIGINT) AS j, CAST(h % (j + 1) AS BIGINT) AS t FROM {_mixed("dj", f"({_U('key')} + j) % {_TOP}", "draw, j")}),
 dc AS (SELECT draw, j FROM (SELECT draw, j, row_number() OVER (PARTITION BY draw, t ORDER BY j) AS k FROM dt) WHERE k > 1 UNION SELECT dt.draw, dt.j FROM dt JOIN dc ON dt.draw = dc.draw AND dt.t = dc.j),
 dw AS (SELECT CAST(dt.draw AS INTEGER) AS draw, CASE WHEN dc.j IS NULL THEN dt.t ELSE dt.j END AS place FROM dt LEFT JOIN dc ON dt.draw = dc.draw AND dt.j = dc.j)"""  # fmt: skip


NULL = f"""{RK}, {_draws("SELECT n, p AS m FROM n", N_PERM, 42)},
 ph AS (SELECT draw AS perm, place + 1 AS rn, place + 1 - row_number() OVER (PARTITION BY draw ORDER BY place) AS fp FROM dw),
 pw AS (SELECT perm, count(*) FILTER (rn <= 50) / 50.0 / (max(p) / max(n)) AS ef_50, count(*) FILTER (rn <= greatest(1, round_even(n.n * CAST(0.01 AS DOUBLE), 0))) / max(greatest(1, round_even(n.n * CAST(0.01 AS DOUBLE), 0))) / (max(p) / max(n)) AS ef_1pct, sum(log10(n.n - n.p) - log10(greatest(fp, 1))) / max(n.p) / log10(max(n.n - n.p)) AS log_auc FROM ph, n GROUP BY perm),
 nul AS (UNPIVOT pw ON ef_50, ef_1pct, log_auc INTO NAME metric VALUE value)"""  # fmt: skip


@query("perm_null_summary", f"WITH RECURSIVE {NULL} SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM nul GROUP BY metric")
def _(s, d):
    return _r(ranking.summarize_null(ranking.permutation_null(_ranked(s, d).select("row_idx", "label"), N_PERM)))


@query("null_percentiles", f"WITH RECURSIVE {NULL}, obs AS (SELECT 'log_auc' AS metric, {_LOGAUC} AS observed FROM n) SELECT metric, round(observed, 6) AS observed, round(100 * avg(CASE WHEN value <= observed THEN 1.0 ELSE 0.0 END), 6) AS percentile FROM nul JOIN obs USING (metric) GROUP BY metric, observed")
def _(s, d):
    rows = _ranked(s, d)
    observed = ranking.log_auc(rows).select(F.lit("log_auc").alias("metric"), C("log_auc").alias("observed"))
    return _r(ranking.percentiles(observed, ranking.permutation_null(rows.select("row_idx", "label"), N_PERM)))


_OBS = f"""obs AS (SELECT 'ef_50' AS metric, (SELECT sum(label) FROM o WHERE rn <= 50) / 50.0 / (p / n) AS observed FROM n
 UNION ALL SELECT 'ef_1pct', (SELECT sum(label) FROM o, n WHERE rn <= greatest(1, round_even(n * CAST(0.01 AS DOUBLE), 0))) / greatest(1, round_even(n * CAST(0.01 AS DOUBLE), 0)) / (p / n) FROM n
 UNION ALL SELECT 'log_auc', {_LOGAUC} FROM n)"""


@query("evaluate_channel", f"WITH RECURSIVE {NULL}, {_OBS} SELECT metric, round(max(observed), 6) AS observed, round(100 * avg(CASE WHEN value <= observed + 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS percentile, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM nul JOIN obs USING (metric) GROUP BY metric")
def _(s, d):
    return _r(ranking.evaluate_channel(fx.ranked(s, d), N_PERM))


def _vectors(s, d, kind="real"):
    e = fx.embeddings(s, d)
    vector = {"real": C("embedding").cast("array<double>"), "relu": F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0).cast("float")).cast("double")), "bits": F.filter(F.transform("embedding", lambda x, i: F.when(x > 0.1, i)), lambda x: x.isNotNull())}[kind]
    return e.select(C("vec_id").alias("row_idx"), vector.alias("bits" if kind == "bits" else "vector"), "label")


VEC = "v AS (SELECT vec_id AS row_idx, label, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0)) AS relu, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS raw, list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > CAST(0.1 AS FLOAT) THEN i - 1 END), lambda x: x IS NOT NULL) AS bits FROM embeddings), a AS (SELECT * FROM v WHERE row_idx < 20)"


_TANI = "len(list_intersect({a}.bits, {b}.bits)) / (len({a}.bits) + len({b}.bits) - len(list_intersect({a}.bits, {b}.bits)))"


def _anchored(s, d, kind):
    q = _vectors(s, d, kind)
    return q, q.where("row_idx < 20")


@query("gen_tanimoto_max", f"WITH {VEC} SELECT v.row_idx, round(max(list_dot_product(v.relu, a.relu) / (list_dot_product(v.relu, v.relu) + list_dot_product(a.relu, a.relu) - list_dot_product(v.relu, a.relu))), 6) AS similarity FROM v, a GROUP BY v.row_idx")
def _(s, d):
    return _r(similarity_join.generalized_tanimoto(*_anchored(s, d, "relu")))


@query("binary_tanimoto_max", f"WITH {VEC} SELECT v.row_idx, round(max(len(list_intersect(v.bits, a.bits)) / (len(v.bits) + len(a.bits) - len(list_intersect(v.bits, a.bits)))), 6) AS similarity FROM v, a GROUP BY v.row_idx")
def _(s, d):
    return _r(similarity_join.bit_tanimoto(*_anchored(s, d, "bits"), vector="bits"))


@query("usr_max", f"WITH {VEC} SELECT v.row_idx, round(max(1 / (1 + list_sum(list_transform(list_zip(v.raw, a.raw), lambda z: abs(z[1] - z[2]))) / len(v.raw))), 6) AS similarity FROM v, a GROUP BY v.row_idx")
def _(s, d):
    return _r(similarity_join.shape(*_anchored(s, d, "real")))


_NEAREST_POSITIVE = f"WITH {VEC}, p AS (SELECT * FROM v WHERE label = 0) SELECT v.row_idx, round(CASE WHEN v.label = 0 THEN 1.0 ELSE max(len(list_intersect(v.bits, p.bits)) / (len(v.bits) + len(p.bits) - len(list_intersect(v.bits, p.bits)))) END, 6) AS similarity FROM v, p GROUP BY v.row_idx, v.label"


@query("nearest_positive", _NEAREST_POSITIVE)
def _(s, d):
    q = _vectors(s, d, "bits")
    return _r(similarity_join.nearest_positive(q, q.where("label = 0"), 64).drop("n_compared"), "similarity")


@query("fingerprint_gather", f"WITH {VEC} SELECT row_idx, CAST(len(bits) AS BIGINT) AS n_bits, label FROM v WHERE label = 3")
def _(s, d):
    """Fingerprints stored as packed words by bucket, and those of one label gathered by key."""
    name = f"prints_{uuid.uuid4().hex}"
    store.save_store(_vectors(s, d, "bits"), name, f"{shared_dir(s)}/hitloom-{name}", 64, 16)
    found = store.gather(s.table(name), _vectors(s, d).where("label = 3").select("row_idx", "label"))
    return found.select("row_idx", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w)).alias("n_bits"), "label")


@query("resumed_similarity", _NEAREST_POSITIVE)
def _(s, d):
    """The nearest positive block by block, each kept as it is done."""
    q = _vectors(s, d, "bits")
    path = f"{shared_dir(s)}/hitloom-blocks-{uuid.uuid4().hex}"
    run = lambda rows: similarity_join.nearest_positive(rows, q.where("label = 0"), 64).drop("n_compared")
    return _r(store.run_blocks(q.select("row_idx", "bits"), path, run, 8), "similarity")


@query("pairwise_tanimoto_mean", f"WITH {VEC} SELECT round(avg(len(list_intersect(x.bits, y.bits)) / (len(x.bits) + len(y.bits) - len(list_intersect(x.bits, y.bits)))), 6) AS mean_similarity FROM v x JOIN v y ON x.row_idx < y.row_idx WHERE x.label = 0 AND y.label = 0")
def _(s, d):
    return _r(similarity_join.mean_pairwise(_vectors(s, d, "bits").where("label = 0")))


def _pool(s, d):
    return fx.embeddings(s, d).select(C("vec_id").alias("row_idx"), (C("vec_id") % 25 == 0).alias("positive"), C("label").alias("cluster"))


POOL = "pool AS (SELECT vec_id AS row_idx, vec_id % 25 = 0 AS positive, label AS cluster, label IN (SELECT label FROM embeddings WHERE vec_id % 25 = 0) AS near FROM embeddings), k AS (SELECT count(*) FILTER (positive) AS p FROM pool), rr AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY md5('0:' || row_idx), row_idx) AS rn FROM pool WHERE NOT positive)"
_NEAR = "round_even(CAST(0.8 AS DOUBLE) * 2 * p, 0)"


@query("sample_negatives", f"WITH {POOL} SELECT row_idx, near FROM rr, k WHERE rn <= CASE WHEN near THEN {_NEAR} ELSE 2 * p - {_NEAR} END")
def _(s, d):
    return sampling.sample_negatives(sampling.similar_by_cluster(_pool(s, d)), 2.0).select("row_idx", C("similar").alias("near"))


@query("sample_summary", f"WITH {POOL}, g AS (SELECT near FROM rr, k WHERE rn <= CASE WHEN near THEN {_NEAR} ELSE 2 * p - {_NEAR} END) SELECT CAST(2 * p AS INTEGER) AS n_requested, CAST({_NEAR} AS INTEGER) AS n_similar_requested, (SELECT count(*) FILTER (near) FROM g) AS n_similar, CAST(2 * p - {_NEAR} AS INTEGER) AS n_elsewhere_requested, (SELECT count(*) FILTER (NOT near) FROM g) AS n_elsewhere, CAST(2 * p - (SELECT count(*) FROM g) AS BIGINT) AS shortfall FROM k")
def _(s, d):
    pool = sampling.similar_by_cluster(_pool(s, d))
    return sampling.sample_summary(pool, sampling.sample_negatives(pool, 2.0), 2.0)


@query("subsample", "SELECT vec_id AS row_idx FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT 60")
def _(s, d):
    return sampling.subsample(fx.embeddings(s, d).select(C("vec_id").alias("row_idx")), 60)


@query("vector_angles", "WITH a AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(degrees(acos(greatest(-1, least(1, list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)))))), 4) AS degrees FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings WHERE vec_id > 0), a")
def _(s, d):
    e = fx.embeddings(s, d)
    first = e.where("vec_id = 0").select(C("embedding").alias("a"))
    return e.where("vec_id > 0").crossJoin(F.broadcast(first)).select("vec_id", F.round(angle(C("a"), C("embedding")), 4).alias("degrees"))  # one row is sent


@query("nearest_features", "WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), f AS (SELECT * FROM p WHERE vec_id < 12) SELECT p.vec_id, round(min(sqrt((p.x - f.x) ** 2 + (p.y - f.y) ** 2 + (p.z - f.z) ** 2)), 6) AS distance FROM p, f GROUP BY p.vec_id")
def _(s, d):
    e = fx.embeddings(s, d).select("vec_id", F.array(*(C("embedding")[k].cast("double") for k in range(3))).alias("xyz"))
    features = e.where("vec_id < 12").agg(F.collect_list("xyz").alias("points"))  # twelve points
    return e.crossJoin(F.broadcast(features)).select("vec_id", F.round(nearest_feature(C("points"), C("xyz")), 6).alias("distance"))


@query("sample_random", f"WITH {POOL} SELECT row_idx FROM (SELECT row_idx, row_number() OVER (ORDER BY md5('0:' || row_idx), row_idx) AS rn FROM pool WHERE NOT positive), k WHERE rn <= 2 * p")
def _(s, d):
    return sampling.sample_random(_pool(s, d), 2.0).select("row_idx")


@query("stratum_flag", f"WITH {VEC}, s AS (SELECT v.row_idx, max(len(list_intersect(v.bits, a.bits)) / (len(v.bits) + len(a.bits) - len(list_intersect(v.bits, a.bits)))) AS similarity FROM v, a GROUP BY v.row_idx), q AS (SELECT similarity, row_number() OVER (ORDER BY similarity) - 1 AS i, (count(*) OVER () - 1) * (1 - 5 * CAST(0.8 AS DOUBLE) * 2 * 20 / count(*) OVER ()) AS h FROM s), c AS (SELECT sum(similarity * (1 - abs(h - i))) AS c FROM q WHERE abs(h - i) < 1) SELECT row_idx, CASE WHEN similarity >= c THEN 1 ELSE 0 END AS flag FROM s, c")
def _(s, d):
    return sampling.stratum_flag(similarity_join.bit_tanimoto(*_anchored(s, d, "bits"), vector="bits"), 20).select("row_idx", "flag")


@query("testbed_shortlist", "WITH l AS (SELECT vec_id AS row_idx, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings), o AS (SELECT row_idx FROM l WHERE label = 0 ORDER BY md5('0:' || row_idx), row_idx LIMIT (SELECT 300 - count(*) FILTER (label = 1) FROM l)) SELECT row_idx, label FROM l WHERE label = 1 OR row_idx IN (SELECT row_idx FROM o)")
def _(s, d):
    return sampling.testbed_shortlist(fx.embeddings(s, d).select(C("vec_id").alias("row_idx"), (C("label") == 0).cast("int").alias("label")), 300)


_NEAREST = f"s AS (SELECT v.row_idx, max({_TANI.format(a='v', b='a')}) AS similarity FROM v, a GROUP BY v.row_idx)"
N_DRAWS = 1000
_OF_DRAWS = _draws("SELECT count(*) AS n, 8 AS m FROM v", N_DRAWS, 42)


@query("hit_clustering_null", f"WITH RECURSIVE {VEC}, {_OF_DRAWS}, dr AS (SELECT draw, row_idx, bits FROM dw JOIN (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS place FROM v) USING (place)) SELECT x.draw, round(avg({_TANI.format(a='x', b='y')}), 6) AS value FROM dr x JOIN dr y ON x.draw = y.draw AND x.row_idx < y.row_idx GROUP BY x.draw")
def _(s, d):
    return _r(sampling.clustering_null(_vectors(s, d, "bits").select("row_idx", "bits"), 8, N_DRAWS))


@query("anchor_null", f"WITH RECURSIVE {VEC}, {_NEAREST}, {_OF_DRAWS} SELECT draw, round(avg(similarity), 6) AS value FROM dw JOIN (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS place FROM s) USING (place) GROUP BY draw")
def _(s, d):
    return _r(sampling.anchor_null(*_anchored(s, d, "bits"), 8, N_DRAWS))


_STRATA_DRAWS = _draws("SELECT count(*) AS n, count(*) FILTER (row_idx % 25 = 0) AS m FROM v", N_DRAWS, 42)
_SPREAD = "round(avg(value), 6) AS null_mean, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"
_REPORT = f"round(100 * avg(CASE WHEN value <= observed THEN 1.0 ELSE 0.0 END), 6) AS percentile, round(max(observed), 6) AS observed, {_SPREAD}"


def _library(s, d):
    return _vectors(s, d, "bits").withColumn("label", (C("row_idx") % 25 == 0).cast("int"))


@query("hit_clustering_report", f"""WITH RECURSIVE {VEC}, {_STRATA_DRAWS}, dr AS (SELECT draw, row_idx, bits FROM dw JOIN (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS place FROM v) USING (place)),
 nul AS (SELECT round(avg({_TANI.format(a='x', b='y')}), 12) AS value FROM dr x JOIN dr y ON x.draw = y.draw AND x.row_idx < y.row_idx GROUP BY x.draw),
 obs AS (SELECT round(avg({_TANI.format(a='x', b='y')}), 12) AS observed FROM v x JOIN v y ON x.row_idx < y.row_idx AND x.row_idx % 25 = 0 AND y.row_idx % 25 = 0)
 SELECT (SELECT count(*) FROM v WHERE row_idx % 25 = 0) AS n_hits, (SELECT count(*) FROM v) AS n_library, 'mean_pairwise_similarity' AS metric, {_REPORT} FROM nul, obs""")  # fmt: skip
def _(s, d):
    return _r(drivers.hit_clustering_report(_library(s, d), N_DRAWS))


@query("anchor_report", f"""WITH RECURSIVE {VEC}, {_NEAREST}, {_STRATA_DRAWS}, nul AS (SELECT avg(similarity) AS value FROM dw JOIN (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS place FROM s) USING (place) GROUP BY draw),
 obs AS (SELECT avg(similarity) AS observed FROM s WHERE row_idx % 25 = 0)
 SELECT (SELECT count(*) FROM v WHERE row_idx % 25 = 0) AS n_hits, 'mean_anchor_similarity' AS metric, {_REPORT} FROM nul, obs""")  # fmt: skip
def _(s, d):
    rows = _library(s, d)
    return _r(drivers.anchor_report(rows, rows.where("row_idx < 20").select("row_idx", "bits"), N_DRAWS))


@query("similarity_strata", f"""WITH {VEC}, p AS (SELECT * FROM v WHERE label = 0 AND row_idx % 5 = 0), q AS (SELECT v.row_idx, CASE WHEN v.label = 0 AND v.row_idx % 5 = 0 THEN 1.0 ELSE max({_TANI.format(a='v', b='p')}) END AS similarity FROM v, p GROUP BY v.row_idx, v.label),
 k AS (SELECT 1 + (count(*) - 1) * (1 - 8.0::DOUBLE * (SELECT count(*) FROM p) / count(*)) AS spot FROM q), o AS (SELECT similarity AS s, row_number() OVER (ORDER BY similarity) AS rn FROM q),
 c AS (SELECT max(s) FILTER (rn = floor(spot)) + (any_value(spot) - floor(any_value(spot))) * (max(s) FILTER (rn = ceil(spot)) - max(s) FILTER (rn = floor(spot))) AS cut FROM o, k) SELECT row_idx, round(similarity, 6) AS similarity, CASE WHEN similarity >= cut THEN 1 ELSE 0 END AS flag FROM q, c""")  # fmt: skip
def _(s, d):
    q = _vectors(s, d, "bits")
    path = f"{shared_dir(s)}/hitloom-strata-{uuid.uuid4().hex}"
    return _r(drivers.similarity_strata(q, q.where("label = 0 and row_idx % 5 = 0"), 64, path, blocks=8)[0], "similarity")


@query("spatial_bridging", "WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) SELECT w.vec_id FROM p w WHERE label >= 6 AND EXISTS (SELECT 1 FROM p l WHERE l.label <= 1 AND (l.x - w.x) ** 2 + (l.y - w.y) ** 2 + (l.z - w.z) ** 2 <= CAST(0.0036 AS DOUBLE)) AND EXISTS (SELECT 1 FROM p l WHERE l.label BETWEEN 2 AND 5 AND (l.x - w.x) ** 2 + (l.y - w.y) ** 2 + (l.z - w.z) ** 2 <= CAST(0.0036 AS DOUBLE))")
def _(s, d):
    e = fx.embeddings(s, d)
    p = e.select("vec_id", "label", *(C("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))
    return spatial.bridging(p.where("label >= 6"), p.where("label <= 1"), p.where("label between 2 and 5"), 0.06).select("vec_id")


RING_CUT = 0.03


@query("ring_members", f"""WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
 b AS MATERIALIZED (SELECT m.id AS a, n.id AS b FROM p m JOIN p n ON m.id <> n.id AND sqrt((n.x - m.x) ** 2 + (n.y - m.y) ** 2 + (n.z - m.z) ** 2) <= {RING_CUT}),
 w AS (SELECT [a, b] AS path FROM b UNION ALL SELECT list_append(path, b.b) FROM w JOIN b ON b.a = path[-1] WHERE len(path) < 6 AND NOT list_contains(path, b.b)),
 c AS (SELECT path FROM w JOIN b ON b.a = path[-1] AND b.b = path[1] WHERE len(path) >= 3)
 SELECT DISTINCT unnest(path) AS id FROM c""")  # fmt: skip
def _(s, d):
    """Points on cycles of up to six bonds, a bond being a pair within the cutoff."""
    e = fx.embeddings(s, d)
    points = e.select(C("vec_id").alias("id"), *(C("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))
    return spatial.ring_members(spatial.close_pairs(points, RING_CUT).select("a", "b"), 6)


def _scores(s, d):
    e = _vectors(s, d, "bits")
    return e.select("row_idx", F.conv(F.substring(F.md5(C("row_idx").cast("string").cast("binary")), 1, 6), 16, 10).cast("double").alias("score"), "bits", C("label").cast("string").alias("scaffold"))


@query("best_per_group", "SELECT label AS scaffold, arg_max(vec_id, (s, -vec_id)) AS row_idx FROM (SELECT CAST(label AS VARCHAR) AS label, vec_id, CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 6) AS BIGINT) AS s FROM embeddings) GROUP BY label")
def _(s, d):
    return clustering.best_of_group(_scores(s, d)).select("scaffold", "row_idx")


LINK_CUT = 0.62
TOP = f"""{VEC}, top AS (SELECT row_idx, bits, CAST(label AS VARCHAR) AS scaffold, CAST('0x' || substr(md5(CAST(row_idx AS VARCHAR)), 1, 6) AS BIGINT) AS score FROM v ORDER BY 4 DESC, 1 LIMIT {{n}}),
 c AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_idx) AS place FROM {{src}})"""


@query("butina", f"""WITH RECURSIVE {TOP.format(n=500, src="top")},
 nb AS MATERIALIZED (SELECT x.place, coalesce(list(y.place ORDER BY y.place) FILTER (y.place IS NOT NULL), []) AS near FROM c x LEFT JOIN c y ON x.place <> y.place AND {_TANI.format(a="x", b="y")} >= 0.4 - 1e-9 GROUP BY x.place),
 o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY len(near) DESC, place DESC) AS k FROM nb),
 g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[]) AS own
  UNION ALL SELECT g.k + 1, CASE WHEN list_contains(seen, o.place) THEN seen ELSE list_concat(seen, [o.place], near) END,
   CASE WHEN list_contains(seen, o.place) THEN CAST([] AS BIGINT[]) ELSE list_concat([o.place], list_filter(near, lambda z: NOT list_contains(seen, z))) END FROM g JOIN o ON o.k = g.k + 1),
 b AS (SELECT list_min(own) AS place FROM g WHERE len(own) > 0)
 SELECT row_idx, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS pick FROM b JOIN c USING (place) ORDER BY place LIMIT 50""")  # fmt: skip
def _(s, d):
    return clustering.butina_select(_scores(s, d), 500, 50, 0.4)


@query("average_linkage", f"""WITH RECURSIVE {VEC}, u AS (SELECT min(row_idx) AS rep, count(*) AS w, bits FROM v WHERE len(bits) > 0 GROUP BY bits),
 d AS (SELECT a.rep AS x, b.rep AS y, CAST(a.w * b.w AS DOUBLE) AS n, a.w * b.w * (1 - {_TANI.format(a="a", b="b")}) AS t FROM u a JOIN u b ON a.rep < b.rep),
 s AS (SELECT false AS merge, x, y, n, t FROM d
  UNION ALL (WITH p AS (SELECT * FROM s WHERE NOT merge), m AS (SELECT arg_min({{'x': x, 'y': y}}, (round(t / n, 9), x, y)) AS m, min(round(t / n, 9)) AS d FROM p),
   q AS (SELECT CASE WHEN p.x = m.m.y THEN m.m.x ELSE p.x END AS x, CASE WHEN p.y = m.m.y THEN m.m.x ELSE p.y END AS y, n, t FROM p, m WHERE m.d <= {LINK_CUT})
   SELECT false, least(x, y), greatest(x, y), sum(n), sum(t) FROM q WHERE x <> y GROUP BY ALL UNION ALL SELECT true, m.m.x, m.m.y, 0, 0 FROM m WHERE m.d <= {LINK_CUT})),
 r AS (SELECT rep, rep AS cluster FROM u UNION ALL SELECT r.rep, s.x FROM r JOIN s ON s.merge AND s.y = r.cluster)
 SELECT v.row_idx, coalesce(min(r.cluster), v.row_idx) AS cluster FROM v LEFT JOIN u ON v.bits = u.bits LEFT JOIN r USING (rep) GROUP BY v.row_idx""")  # fmt: skip
def _(s, d):
    return clustering.average_linkage(_vectors(s, d, "bits"), LINK_CUT)


@query("maxmin", f"""WITH RECURSIVE {TOP.format(n=500, src="(SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY scaffold ORDER BY score DESC, row_idx) = 1)").replace("CAST(label AS VARCHAR) AS scaffold", "CAST(row_idx % 151 AS VARCHAR) AS scaffold")},
 dm AS MATERIALIZED (SELECT x.place AS p, list(round(1 - {_TANI.format(a="x", b="y")}, 12) ORDER BY y.place) AS d FROM c x, c y GROUP BY x.place),
 g AS (SELECT 1 AS pick, CAST(1 AS BIGINT) AS place, list_transform(d, lambda x, i: CASE WHEN i = 1 THEN -1 ELSE x END) AS gap FROM dm WHERE p = 1
  UNION ALL SELECT pick + 1, p, list_transform(list_zip(gap, d), lambda z, i: CASE WHEN i = p THEN -1 ELSE least(z[1], z[2]) END) FROM g JOIN dm ON p = list_position(gap, list_max(gap)) WHERE pick < 20)
 SELECT row_idx, CAST(score AS DOUBLE) AS score, CAST(pick AS INTEGER) AS pick FROM g JOIN c USING (place)""")  # fmt: skip
def _(s, d):
    return clustering.maxmin_select(_scores(s, d).withColumn("scaffold", (C("row_idx") % 151).cast("string")), 500, 20)


TREE = 0.45


@query("tree_clusters", "SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS every_row_once, true AS valid FROM embeddings")
def _(s, d):
    """The tree's clusters hold each row once, and each cluster of several rows keeps to the threshold."""
    rows = _vectors(s, d, "bits")
    found = clustering.tree_clusters(rows, TREE, 64)
    quality = clustering.cluster_quality(rows, found)
    sums = quality.agg(F.sum("n").alias("n_rows"), F.bool_and(C("mean_similarity").isNull() | (C("mean_similarity") >= TREE - 1e-9)).alias("valid"))
    once = found.agg((F.count("*") == F.countDistinct("row_idx")).alias("every_row_once"))
    return sums.crossJoin(once).select("n_rows", "every_row_once", "valid")  # one row each


@query("cluster_size_summary", "WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS n_clusters, min(n) AS min_size, quantile_cont(n, 0.5) AS median_size, max(n) AS max_size, round(avg(n), 6) AS mean_size FROM g")
def _(s, d):
    return _r(clustering.cluster_sizes(fx.embeddings(s, d).select(C("label").alias("cluster"))))


@query("chunked_files", "SELECT name, CAST(floor((row_number() OVER (ORDER BY name) - 1) / ceil((SELECT count(*) FROM customer) / 7.0)) AS INTEGER) AS chunk FROM (SELECT c_name AS name FROM customer)")
def _(s, d):
    return in_chunks(s.read.parquet(f"{d}/customer.parquet").select(C("c_name").alias("name")), 7)


def _features(s, d):
    return fx.embeddings(s, d).select(C("vec_id").alias("row_idx"), C("embedding").cast("array<double>").alias("features"), (C("label") < 3).cast("int").alias("label"), (C("vec_id") % 40).alias("block"))


_HAND = 5


@query("group_folds", f"""WITH RECURSIVE g AS (SELECT p_size % 50 + 100 * (p_partkey % 7) AS g, count(*) AS n FROM part GROUP BY 1),
 o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, md5(CAST(g AS VARCHAR))) AS k FROM g),
 d AS (SELECT CAST(0 AS BIGINT) AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, -1 AS fold, CAST(0 AS BIGINT) AS n
  UNION ALL SELECT d.k + 1, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + o.n ELSE x END), list_position(load, list_min(load)) - 1, o.n FROM d JOIN o ON o.k = d.k + 1)
 SELECT CAST(fold AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM d WHERE fold >= 0 GROUP BY fold""")  # fmt: skip
def _(s, d):
    parts = s.read.parquet(f"{d}/part.parquet").select((C("p_size") % 50 + 100 * (C("p_partkey") % 7)).alias("g"))
    return sampling.grouped_folds(parts, "g", _HAND).groupBy("fold").agg(F.countDistinct("g").alias("n_groups"), F.count("*").alias("n_rows"))


@query("gbdt_scores")
def _(s, d):
    rows = _features(s, d)
    return models.score(models.train(rows, rounds=8), rows).select("row_idx", "label", "score")


@query("grouped_cv")
def _(s, d):
    return models.grouped_cv(_features(s, d), "block", folds=3, rounds=4)


def _kept(s, df, name, form="parquet", **options):
    """A table derived from the given ones, written to the shared folder for a reader to read: its path."""
    path = f"{shared_dir(s)}/hitloom-{name}-{uuid.uuid4().hex}{'' if form == 'text' else '.' + form}"
    df.write.options(**options).format(form).save(path)
    return path


@query("read_projection", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(s, d):
    rows = readers.selection(s, f"{d}/orders.parquet", ["o_custkey", "o_orderstatus"])
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("read_csv", "SELECT o_orderpriority AS label, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(s, d):
    path = _kept(s, s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority"), "orders", "csv", header=True)
    rows = readers.query_table(s, path, "o_orderkey", "o_orderpriority")
    return rows.groupBy(C("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.sum(C("o_orderkey").cast("long")).alias("keys"))


@query("labelled_library", "SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS hits FROM (SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id))")
def _(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id").select(C("doc_id").cast("string").alias("SMILES"), C("quality").alias("LABEL"))
    return readers.labelled_library(s, _kept(s, rows, "library")).agg(F.count("*").alias("n"), F.sum(C("LABEL").cast("long")).alias("hits"))


@query("read_anchors", "SELECT c_name AS smiles, c_mktsegment AS detail FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 = 1")
def _(s, d):
    rows = s.read.parquet(f"{d}/customer.parquet").select(C("c_name").alias("smiles"), (C("c_nationkey") % 3).cast("string").alias("source"), C("c_mktsegment").alias("detail"))
    return readers.anchors(s, _kept(s, rows, "anchors"), ["1"], ["BUILDING", "MACHINERY"]).select("smiles", "detail")


@query("read_template", "SELECT 'D' || CAST(doc_id AS VARCHAR) AS CatalogID, source AS SMILES, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents")
def _(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").select(F.concat(F.lit("D"), C("doc_id").cast("string")).alias("CatalogID"), C("source").alias("SMILES"))
    return readers.split_template(s, _kept(s, rows.coalesce(1), "template", "csv", header=True)).withColumn("row_idx", C("row_idx").cast("long"))


@query("read_channel", f"WITH {CH} SELECT row_idx, 'draw' AS channel, score FROM channels WHERE channel = 'draw'")
def _(s, d):
    own = fx.channels(s, d).where("channel = 'draw'").select("row_idx", "score")
    return readers.channel(s, _kept(s, own, "channel"), "draw", s.read.parquet(f"{d}/documents.parquet").count())


@query("nul_bytes", "SELECT count(*) AS n_files, CAST(sum(k) AS BIGINT) AS n_nul FROM (SELECT label, count(*) FILTER (vec_id % 9 = 0) AS k FROM embeddings GROUP BY label)")
def _(s, d):
    """Text files of each label with a NUL byte in each ninth line."""
    e = fx.embeddings(s, d).select(F.concat(C("vec_id").cast("string"), F.when(C("vec_id") % 9 == 0, F.lit("\0")).otherwise(F.lit(""))).alias("value"), "label")
    path = f"{shared_dir(s)}/hitloom-nul-{uuid.uuid4().hex}"
    e.repartition("label").write.partitionBy("label").text(path)
    found = readers.nul_bytes(s, f"{path}/*/*.txt")
    return found.agg(F.count("*").alias("n_files"), F.sum("n_nul").alias("n_nul"))


@query("pdb_atoms", "SELECT label % 5 AS kind, count(*) AS n, round(sum(round(CAST(embedding[1] AS DOUBLE) * 40, 3)), 2) AS x, round(sum(round(CAST(embedding[2] AS DOUBLE) * 40, 3)), 2) AS y, round(sum(round(CAST(embedding[3] AS DOUBLE) * 40, 3)), 2) AS z FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1")
def _(s, d):
    """Fixed-width atom records made of the vectors, parsed again."""
    xyz = [F.round(C("embedding")[k].cast("double") * 40, 3) for k in range(3)]
    element = F.element_at(F.array(*map(F.lit, ("C", "N", "O", "S", "P"))), (C("label") % 5 + 1).cast("int"))
    line = F.format_string("%-6s%5d %-4s%1s%3s %1s%4d    %8.3f%8.3f%8.3f%22s%2s", F.when(C("vec_id") % 2 == 0, "HETATM").otherwise("ATOM"), C("vec_id") % 99999, element, F.lit(" "), F.lit("LIG"), F.lit("A"), C("label").cast("int"), *xyz, F.lit(""), element)
    path = _kept(s, fx.embeddings(s, d).select(line.alias("value")), "pdb", "text")
    atoms = spatial.parse_atoms(readers.text_lines(s, path)).where("record = 'HETATM'")
    kind = F.array_position(F.array(*map(F.lit, ("C", "N", "O", "S", "P"))), C("element")) - 1
    return atoms.groupBy(kind.cast("int").alias("kind")).agg(F.count("*").alias("n"), *(F.round(F.sum(a), 2).alias(a) for a in "xyz"))


@query("empirical_null", f"WITH RECURSIVE {NULL} SELECT 'labels' AS name, metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM nul GROUP BY metric")
def _(s, d):
    n, hits = ranking.sizes(_ranked(s, d))
    return _r(reports.empirical_null(s, [f"labels:{n}:{hits}"], n_perm=N_PERM))


@query("evaluate_team", f"WITH {RK}, a AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM ranked) SELECT round((sum(r) FILTER (label = 1) - max(p) * (max(p) + 1) / 2) / (max(p) * (max(n) - max(p))), 6) AS roc_auc, (SELECT count(*) FROM o WHERE rn <= 50 AND label = 1) AS hits FROM a, n")
def _(s, d):
    rows = _ranked(s, d)
    top = rows.orderBy(F.desc("score"), "row_idx").limit(50).select("row_idx", F.lit(1).alias("picked_"))
    team = rows.select("row_idx", C("score").alias("Score")).join(top, "row_idx", "left").select("row_idx", "Score", F.coalesce("picked_", F.lit(0)).alias("Sel_50"))
    return _r(models.evaluate_team(rows.select("row_idx", "label"), team, "row_idx", "label", "Sel_50").select("roc_auc", "hits"))


@query("id_list_problems", "SELECT unnest(['not 50 lines', 'ids that aren''t in the template']) AS problem FROM (SELECT count(*) AS n FROM documents) WHERE n > 0")
def _(s, d):
    ids = _ids(s, d)
    listed = ids.orderBy("row_idx").limit(40).select("CatalogID").unionByName(ids.limit(1).select(F.concat(F.lit("x"), "CatalogID").alias("CatalogID")))
    return validation.id_list_problems(listed, ids)


@query("cofold_skips", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unparseable' ELSE CAST(c_nationkey AS VARCHAR) || ' heavy atoms > 20' END AS reason FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey > 20")
def _(s, d):
    rows = s.read.parquet(f"{d}/customer.parquet").select(C("c_custkey").cast("string").alias("id"), C("c_name").alias("smiles"), (C("c_mktsegment") != "BUILDING").alias("ok"), C("c_nationkey").alias("n_atoms"))
    alignment = _kept(s, rows.limit(3).select(F.concat(F.lit(">"), "id").alias("value")), "alignment", "text")
    return cofold_inputs(rows, "ligand: %s", "smiles", readable="ok", max_size=20, alignment=f"{alignment}/*.txt")[1]


@query("score_coverage", f"WITH {CH} SELECT count(*) AS n_ids, count(score) AS n_scored, min(score) AS least, max(score) AS largest, count(score) < count(*) AS partial FROM channels WHERE channel = 'label'")
def _(s, d):
    return coverage(fx.channels(s, d).where("channel = 'label'"))
