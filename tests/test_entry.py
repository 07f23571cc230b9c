import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from leafline.plans import queries as core

REPO = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def rows(df):
    show = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(show, r)) for r in df.itertuples(index=False, name=None))


@needs_data
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert rows(core.queries()[name](spark, str(DATA)).toPandas()) == rows(con.execute(core.oracle_sql()[name]).fetchdf())


@needs_data
def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_does_not_need_the_llm_subpackage():
    for path in (REPO / "leafline").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "leafline.llm" not in path.read_text(), path
    code = "import sys; sys.modules['leafline.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, env=os.environ | {"PYTHONPATH": str(REPO)})
