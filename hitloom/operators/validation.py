"""Checks of submissions and tables: problems as rows, not exceptions, unless a contract is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cleaning import require_columns

C = F.col
COLUMNS = ["CatalogID", "Sel_50", "Score"]


def _problems(spark, checks: dict[str, bool]) -> DataFrame:
    found = [(k,) for k, bad in checks.items() if bad]
    return spark.createDataFrame(found, "problem string")


def scored_list_problems(rows: DataFrame, template: DataFrame, n: int = 50) -> DataFrame:
    """One row for each rule that a scored table with n selected rows breaks."""
    spark = rows.sparkSession
    if rows.columns != COLUMNS:
        return _problems(spark, {f"columns are {rows.columns}, not {COLUMNS}": True})
    ids, wanted = rows.select("CatalogID"), template.select("CatalogID")
    one = rows.agg(F.count("*").alias("n"), F.countDistinct("CatalogID").alias("d"), F.sum("Sel_50").alias("s"), F.count_if(~C("Sel_50").isin(0, 1)).alias("odd"), F.count_if(C("Score").isNull() | F.isnan(C("Score").cast("double"))).alias("missing")).first()
    return _problems(spark, {
        "ids differ from the template": not (ids.subtract(wanted).isEmpty() and wanted.subtract(ids).isEmpty()),
        "repeated ids": one["n"] != one["d"],
        f"not {n} selected": (one["s"] or 0) != n,
        "Sel_50 isn't 0 or 1": one["odd"] > 0,
        "missing scores": one["missing"] > 0,
        "row count differs from the template": one["n"] != wanted.count(),
    })


def id_list_problems(ids: DataFrame, template: DataFrame, n: int = 50) -> DataFrame:
    """The same for a bare list of selected ids."""
    own = ids.select("CatalogID")
    total, distinct = own.agg(F.count("*"), F.countDistinct("CatalogID")).first()
    return _problems(ids.sparkSession, {
        f"not {n} lines": total != n,
        "repeated ids": total != distinct,
        "ids that aren't in the template": not own.join(template.select("CatalogID"), "CatalogID", "left_anti").isEmpty(),
    })


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def require_contract(df: DataFrame, ids: str, selection: str, label: str | None = None) -> DataFrame:
    """Columns of a dataset for evaluation; label only where the dataset has one."""
    return require_columns(df, ids, selection, *([label] if label else []))


def outputs_complete(inputs: DataFrame, outputs: DataFrame, key: str) -> None:
    """An error if an input has no output."""
    lost = inputs.select(key).subtract(outputs.select(key)).count()
    if lost:
        raise RuntimeError(f"{lost} inputs without output")
