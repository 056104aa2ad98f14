"""The operators that SQL can express, in DuckDB SQL over the whole documents table (ids that don't repeat)."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)"""


def backoff(alpha: float, least: int) -> str:
    """Stupid-backoff scores of order three."""
    return f"""
    WITH {_WORDS},
      t AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM w),
      p AS (SELECT doc_id, k, x, lag(x) OVER (PARTITION BY doc_id ORDER BY k) AS v, lag(x, 2) OVER (PARTITION BY doc_id ORDER BY k) AS u FROM t),
      c1 AS (SELECT x, count(*) AS n FROM t GROUP BY x),
      c2 AS (SELECT v, x, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, x),
      c3 AS (SELECT u, v, x, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, x),
      tot AS (SELECT count(*) AS n FROM t),
      s AS (SELECT p.doc_id, CASE WHEN p.u IS NOT NULL THEN c3.n < {least} WHEN p.v IS NOT NULL THEN c2.n < {least} ELSE false END AS late,
                   p.u IS NOT NULL AND c3.n = 1 AS single,
                   CASE WHEN c3.n >= {least} THEN ln(c3.n / d.n)
                        WHEN c2.n >= {least} THEN ln(c2.n / b.n) + CASE WHEN p.u IS NULL THEN 0 ELSE ln({alpha}) END
                        ELSE ln(a.n / tot.n) + CASE WHEN p.v IS NULL THEN 0 WHEN p.u IS NULL THEN ln({alpha}) ELSE 2 * ln({alpha}) END END AS z
            FROM p JOIN c1 a ON p.x = a.x LEFT JOIN c1 b ON p.v = b.x LEFT JOIN c2 ON p.v = c2.v AND p.x = c2.x
                   LEFT JOIN c2 d ON p.u = d.v AND p.v = d.x LEFT JOIN c3 ON p.u = c3.u AND p.v = c3.v AND p.x = c3.x, tot)
    SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, count(*) FILTER (s.late) AS n_backoff, count(*) FILTER (s.single) AS n_single, round(coalesce(sum(s.z), 0), 6) AS log_score
    FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id, len(w.w)
    """


def removal(length: int) -> str:
    """Bytes covered by strings of the given length that also start earlier."""
    return f"""
    WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      s AS (SELECT doc_id, list_transform(range(0, CAST(length(h) // 2 - {length - 1} AS BIGINT)), lambda i: md5(substr(h, 2 * i + 1, {2 * length}))) AS m FROM h WHERE length(h) >= {2 * length}),
      u AS (SELECT doc_id, generate_subscripts(m, 1) - 1 AS p, unnest(m) AS m FROM s),
      d AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS k FROM u) WHERE k > 1),
      g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length} THEN 0 ELSE 1 END AS new FROM d),
      r AS (SELECT doc_id, min(p) AS a, max(p) + {length} AS e FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
      k AS (SELECT r.doc_id, r.a, r.e, lag(r.e, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY r.a) AS before FROM r),
      j AS (SELECT k.doc_id, string_agg(substr(h.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(e) AS last, sum(e - a) AS n, count(*) AS runs FROM k JOIN h USING (doc_id) GROUP BY k.doc_id)
    SELECT h.doc_id, CAST(length(h.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(j.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(j.runs, 0) AS BIGINT) AS n_spans,
           sha256(unhex(coalesce(j.kept, '') || substr(h.h, 2 * coalesce(j.last, 0) + 1))) AS kept_sha256
    FROM h LEFT JOIN j USING (doc_id)
    """


def shingle_components(words: int, num: int, den: int) -> str:
    """Components of documents linked by shingle similarity; equal sets are one row of the join."""
    return f"""
    WITH RECURSIVE {_WORDS},
      sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [md5(array_to_string(w, ' '))]
                    ELSE list_distinct(list_transform(range(1, CAST(len(w) - {words - 2} AS BIGINT)), lambda i: md5(array_to_string(w[i:i + {words - 1}], ' ')))) END AS s FROM w),
      cl AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sh),
      e AS (SELECT doc_id, n, unnest(s) AS x FROM cl WHERE doc_id = rep AND n > 0),
      l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
            WHERE {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
      ab AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
      reach AS (SELECT doc_id AS a, doc_id AS r FROM cl WHERE doc_id = rep UNION SELECT ab.b, reach.r FROM reach JOIN ab ON reach.a = ab.a WHERE reach.r < ab.b),
      root AS (SELECT a, min(r) AS root FROM reach GROUP BY a)
    SELECT cl.doc_id, CAST(cl.n AS BIGINT) AS n_shingles, CASE WHEN cl.n = 0 THEN cl.doc_id ELSE root.root END AS component_id
    FROM cl JOIN root ON cl.rep = root.a
    """


def importance(buckets: int, percent: int, least: int, seed: int) -> str:
    """Importance resampling: CRC-32 by its table, gains by bucket, mean by document, seeded Gumbel draws."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""
    WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: {step})) AS t),
      src AS (SELECT 0 AS part, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
      w AS (SELECT part, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM src),
      f AS (SELECT part, doc_id, unnest(list_concat(w, list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
      n AS (SELECT part, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
      h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
      b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                    lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % {buckets} AS b FROM h, crc),
      c AS (SELECT b, sum(n) FILTER (part = 0) AS s, sum(n) FILTER (part = 1) AS t FROM n JOIN b USING (f) GROUP BY b),
      a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c),
      g AS (SELECT b, CAST(floor(1000 * ln((coalesce(c.t, 0) + 1.0::DOUBLE) * (a.s + {buckets})::DOUBLE / ((coalesce(c.s, 0) + 1.0::DOUBLE) * (a.t + {buckets})::DOUBLE))) AS BIGINT) AS g FROM c, a),
      d AS (SELECT doc_id, sum(n * g) AS total, sum(n) AS n FROM n JOIN b USING (f) JOIN g USING (b) WHERE part = 0 GROUP BY doc_id),
      z AS (SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(d.n, 0) AS BIGINT) AS n_features,
                   CAST(coalesce((d.total - ((d.total % d.n) + d.n) % d.n) / d.n, 0) AS BIGINT) AS weight,
                   CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
            FROM w LEFT JOIN d USING (doc_id) WHERE w.part = 0),
      r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS k, count(*) OVER () AS n FROM z WHERE n_words >= {least})
    SELECT z.doc_id, z.n_features, z.weight, z.weight + z.noise AS score, CASE WHEN r.k <= {percent} * r.n // 100 THEN r.k END AS rank
    FROM z LEFT JOIN r USING (doc_id)
    """
