"""The driver contract, also without the subpackage for training data."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    assert "recipe_yields" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_imports_alone(tmp_path):
    for name in ("hitloom", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recipe_yields' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_uses_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "hitloom")):
        if "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert not re.search(r"\bllm\b", text.read()), f


def test_flagship(spark):
    import __spark_entry__ as e

    if os.path.isdir(SMALL):
        got = {r.recipe: r.n_positives for r in e.entry(spark).collect()}
        assert (got["l0"], got["l1"], got["l2"], got["l3"], got["l4"], got["l5"], got["l7"]) == (807, 711, 684, 743, 347, 1235, 507)


def test_queries_match_their_sql(spark):
    """A few queries against the oracle engine on the smallest tables."""
    import duckdb

    import __spark_entry__ as e

    if not os.path.isdir(SMALL):
        return
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    for name in ("label_l8", "library_floor_search", "audit_supplement_overlap", "rrf_fusion", "log_auc", "sample_negatives", "stratum_flag"):
        want = con.execute(e.oracle_sql()[name]).df()
        got = e.queries()[name](spark, SMALL).toPandas()[list(want.columns)]
        key = lambda d: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d.itertuples(index=False))
        assert key(got) == key(want), name
