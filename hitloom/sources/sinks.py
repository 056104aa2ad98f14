"""Writers: submissions, rankings, reports, templated files and chunks."""

from __future__ import annotations

import datetime as dt
import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from ..functions.cleaning import finite
from ..functions.ranks import ordered

C = F.col


def write_ids(picks: DataFrame, path: str, n: int = 50) -> list[str]:
    """One id a line, in order of pick; returns what is wrong with the list."""
    ids = [r[0] for r in picks.orderBy("pick").select("CatalogID").limit(n + 1).collect()]
    Path(path).write_text("".join(f"{i}\n" for i in ids))
    return [w for w, bad in ((f"not {n} ids", len(ids) != n), ("repeated ids", len(set(ids)) != len(ids))) if bad]


def submission_rows(template: DataFrame, picks: DataFrame, scores: DataFrame) -> DataFrame:
    """CatalogID, Sel_50, Score for all rows of the template."""
    flagged = template.join(picks.select("row_idx", F.lit(1).alias("p_")), "row_idx", "left")
    return flagged.join(scores.select("row_idx", "score"), "row_idx", "left").select("CatalogID", F.coalesce("p_", F.lit(0)).alias("Sel_50"), C("score").alias("Score"))


def write_submission(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def save_ranking(scores: DataFrame, path: str, top: int = 50) -> tuple[dict, DataFrame]:
    """Keep the scores; returns their range over finite ones and the naive top."""
    scores.write.mode("errorifexists").parquet(path)
    kept = scores.sparkSession.read.parquet(path)
    s = finite(C("score"))
    low, high, mean, n = kept.agg(F.min(s), F.max(s), F.avg(s), F.count(s)).first()
    from ..operators.fusion import naive_top

    return {"min": low, "max": high, "mean": mean, "n_scored": n}, naive_top(kept, top)


def git_sha(folder: str = ".") -> str | None:
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def write_report(folder: str, label: str, content: dict) -> Path:
    """content as report.json in a new folder named by the time; never overwrites."""
    now = dt.datetime.now(dt.UTC)
    out = Path(folder) / f"{now:%Y%m%dT%H%M%S%f}_{label}"
    out.mkdir(parents=True, exist_ok=False)
    (out / "report.json").write_text(json.dumps(content | {"run_at_utc": now.isoformat(), "git_sha": git_sha()}, indent=2, default=str))
    return out


def in_chunks(files: DataFrame, n: int, column: str = "name") -> DataFrame:
    """files with chunk: sorted and cut into at most n contiguous runs of equal length (the last may be shorter)."""
    size = max(1, -(-files.count() // n))
    return ordered(files, column, out="place_").withColumn("chunk", F.floor((C("place_") - 1) / size).cast("int")).drop("place_")


def templated(rows: DataFrame, template: str, *columns: str, max_size: int | None = None, size: str = "n_atoms") -> tuple[DataFrame, DataFrame]:
    """content for each row by a printf template, and the rows that are skipped (too large or without a size)."""
    ok = C(size).isNotNull() & (C(size) <= max_size) if max_size is not None else F.lit(True)
    return rows.where(ok).withColumn("content", F.format_string(template, *columns)), rows.where(~F.coalesce(ok, F.lit(False)))


def cofold_inputs(rows: DataFrame, template: str, *columns: str, readable: str, max_size: int, alignment: str, size: str = "n_atoms") -> tuple[DataFrame, DataFrame]:
    """content for each row by a printf template, and id and reason of the rows that are skipped.

    readable: a flag whether the structure could be read, size: its heavy
    atoms.  An alignment file that holds NUL bytes is an error before any row
    is written.
    """
    from .readers import check_alignment

    check_alignment(rows.sparkSession, alignment)
    reason = F.when(~F.coalesce(C(readable), F.lit(False)), F.lit("unparseable")).when(C(size).isNull(), F.lit("no size")).when(C(size) > max_size, F.format_string(f"%d heavy atoms > {max_size}", C(size)))
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason").withColumn("content", F.format_string(template, *columns)), judged.where("reason is not null").select("id", "reason")


def coverage(scores: DataFrame) -> DataFrame:
    """One row: how many ids there are, how many have a finite score, the range of scores, and whether the coverage is partial (unscored isn't zero)."""
    own = finite(C("score"))
    return scores.agg(F.count("*").alias("n_ids"), F.count(own).alias("n_scored"), F.min(own).alias("least"), F.max(own).alias("largest")).withColumn("partial", C("n_scored") < C("n_ids"))


def write_files(rows: DataFrame, folder: str, suffix: str = ".yaml") -> None:
    """One file for each row (id, content), written by the tasks; the folder must be one that they share."""

    def save(part):
        base = Path(folder)
        base.mkdir(parents=True, exist_ok=True)
        for r in part:
            tmp = base / f".{r['id']}{suffix}.tmp"
            tmp.write_text(r["content"])
            tmp.rename(base / f"{r['id']}{suffix}")

    rows.select("id", "content").foreachPartition(save)


def without_nul(rows: DataFrame, column: str = "value") -> DataFrame:
    return rows.withColumn(column, F.regexp_replace(column, "\\x00", ""))
