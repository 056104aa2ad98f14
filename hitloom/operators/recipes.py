"""Named labelling recipes: deduplicate first, then apply a threshold.

``label`` evaluates any number of recipes over one aggregate: a structure is
shuffled once, whatever the number of recipes.  A predicate that is null (a
missing z-score) counts as false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import compound_part, finite
from ..functions.lineage import settled
from . import disynthon
from .dedup import dedup_selection

C, I, N, H = F.col, "count_inhibitor", "count_ntc", "historic_hits"
MAX_HISTORIC = 5


def _tenth(name: str) -> Column:
    return C(name) < F.lit(0.1) * C("count_target")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def base(least: int = 3) -> Column:
    """Count floor, weak inhibition, no control reads, rarely seen before."""
    return _yes((C("count_target") >= least) & _tenth(I) & (C(N) == 0) & (C(H) < MAX_HISTORIC))


def strict() -> Column:
    return _yes((C("count_target") > 3) & ((C(I) == 0) | _tenth(I)) & ((C(N) == 0) | _tenth(N)) & (C(H) < MAX_HISTORIC))


def zscore(cut: float) -> Column:
    """A z-score cutoff in place of the count floor."""
    return _yes((finite(C("zscore")) >= cut) & _tenth(I) & (C(N) == 0) & (C(H) < MAX_HISTORIC))


def count_ge_10() -> Column:
    return base(10)


def no_competition() -> Column:
    return _yes((C("count_target") >= 3) & (C(N) == 0) & (C(H) < MAX_HISTORIC))


def per_library(floors: dict[str, int], library: Column | None = None) -> Column:
    """A count floor for each library; libraries without one are never positive."""
    lib = compound_part(C("compound"), 1) if library is None else library
    pairs = [x for k, v in sorted(floors.items()) for x in (F.lit(k), F.lit(v))]
    floor = F.try_element_at(F.create_map(*pairs), lib) if pairs else F.lit(None)
    return _yes((C("count_target") >= floor) & _tenth(I) & (C(N) == 0) & (C(H) < MAX_HISTORIC))


def joint_zscore(cut: float) -> Column:
    """Count floor and z-score; the control isn't asked."""
    return _yes((C("count_target") >= 3) & _tenth(I) & (C(H) < MAX_HISTORIC) & (finite(C("zscore")) >= cut))


@dataclass(frozen=True)
class Labelled:
    """A recipe's name and version, and all structures with a column positive."""

    name: str
    version: str
    rows: DataFrame


def raw_evidence() -> Column:
    """An aggregate: whether a raw row passes the base recipe by itself."""
    return F.max(_yes(base()).cast("int")).alias("own_evidence")

#: recipe: name, and its predicate over the shared aggregate
RECIPES: dict[str, tuple[str, Callable[..., Column]]] = {
    "l0": ("base", base),
    "l1": ("strict", strict),
    "l2": ("individually_evidenced", lambda: base() & (F.col("own_evidence") == 1)),
    "l3": ("zscore", zscore),
    "l4": ("count_ge_10", count_ge_10),
    "l5": ("no_competition", no_competition),
    "l6": ("per_library", per_library),
    "l7": ("joint_zscore", joint_zscore),
}


def deduplicated(selection: DataFrame) -> DataFrame:
    """The one aggregate that all recipes share."""
    return dedup_selection(selection, raw_evidence(), zscore=True)


def version(key: str, value: float | None = None) -> str:
    if key in ("l3", "l7"):
        return f"v1_z{value:.4f}"
    return f"v1_t{value:.1f}" if key == "l8" else "v1"


def label(selection: DataFrame, key: str, *args) -> Labelled:
    """One recipe by key, l0 to l8, with its parameter if it has one."""
    if key == "l8":
        rows = settled(deduplicated(selection), "deduplicated")  # pairs and labels read it: one scan of the selection
        return Labelled("disynthon_competitive_hit", version("l8", args[0]), disynthon_labels(rows, args[0]))
    name, predicate = RECIPES[key]
    return Labelled(name, version(key, args[0] if args and key in ("l3", "l7") else None), deduplicated(selection).withColumn("positive", predicate(*args)))


def label_many(selection: DataFrame, **chosen) -> DataFrame:
    """One aggregate with a column is_<key> for each chosen recipe; the value is its parameter (None: none)."""
    rows = deduplicated(selection)
    return rows.withColumns({f"is_{k}": RECIPES[k][1](*([] if v is None else [v])) for k, v in chosen.items()})


def disynthon_labels(rows: DataFrame, threshold: float) -> DataFrame:
    """Structures of which a building-block pair, pooled over the library, is a competitive hit."""
    melted = disynthon.melt(rows)
    hits = disynthon.classify(disynthon.aggregate(melted), threshold).where("hit").select("disynthon_id")
    return disynthon.propagate(rows, hits, MAX_HISTORIC)
