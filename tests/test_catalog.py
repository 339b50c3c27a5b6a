"""Each query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn.plans import catalog
from tarn.sources.table import TableLoader, table_like

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in found))


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = sql.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, got), rows(want.columns, want.fetchall())
    assert a == b


def test_promotion_is_over_the_whole_table(spark, tmp_path, monkeypatch):
    """Every row of lineitem is appended, some before the promotion and some after, and scanned."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    for k, name in enumerate(("schema_promote",)):
        monkeypatch.setattr(catalog, "place", lambda _, k=k: f"file://{tmp_path}/{k}")
        df = catalog.QUERIES[name](spark, str(DATA))
        assert dict(df.dtypes)["l_linenumber"] == "bigint"
        table = TableLoader(spark, f"file://{tmp_path}/{k}").load()
        records = [f.record_count for f, _ in table.live_files()]
        assert sum(records) == table.scan().count() == lines.count()
        assert sorted(r["n"] for r in table.entries().groupBy("sequence_number").agg(F.sum("record_count").alias("n")).collect()) == sorted(
            lines.filter(c).count() for c in ("l_linenumber <= 3", "l_linenumber > 3")
        )
    assert df.count() == lines.count()


def test_list_promotion_is_of_whole_vectors(spark, tmp_path, monkeypatch):
    """Old float files and new double files are scanned together, and every element is as it was."""
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = {r["vec_id"]: list(r["embedding"]) for r in vectors.collect()}
    for k, name in enumerate(("schema_list_promote",)):
        monkeypatch.setattr(catalog, "place", lambda _, k=k: f"file://{tmp_path}/{k}")
        df = catalog.QUERIES[name](spark, str(DATA))
        table = TableLoader(spark, f"file://{tmp_path}/{k}").load()
        assert sum(f.record_count for f, _ in table.live_files()) == df.count() == len(want)
        kinds = {spark.read.parquet(f.file_path).schema["embedding"].dataType.elementType.simpleString() for f, _ in table.live_files() if f.record_count}
        assert kinds == {"float", "double"}
    assert dict(df.dtypes)["embedding"] == "array<double>"
    assert {r["vec_id"]: list(r["embedding"]) for r in df.collect()} == want


def test_pruned_files_where_a_year_has_several(spark, sql, monkeypatch):
    """Files end after 100 rows, as those of a large year do after more: all of the years asked for are read, no other."""
    made = []

    def filled(df, partition):
        made.append(table_like(spark, catalog.place(spark), df, partition))
        made[0].append(df, file_rows=100)
        return made[0]

    monkeypatch.setattr(catalog, "filled", filled)
    df = catalog.QUERIES["pruned_files"](spark, str(DATA))
    want = sql.sql(catalog.ORACLE_SQL["pruned_files"])
    assert df.columns == want.columns and [tuple(r) for r in df.collect()] == want.fetchall()
    planned = [f for f, _ in made[0].plan(where=[("l_shipdate", ">=", dt.datetime(1998, 1, 1))])]
    late = [f for f, _ in made[0].live_files() if f.partition["l_shipdate_year"] >= 28]
    assert sorted(f.file_path for f in planned) == sorted(f.file_path for f in late)
    assert len(made[0].live_files()) > len(planned) > df.collect()[0]["n_files"]


def test_bucket_query_against_the_scalar_form(spark):
    from tarn.functions.transforms import Transform
    from tarn.model.types import Primitive

    df = catalog.QUERIES["transform_bucket"](spark, str(DATA)).join(spark.read.parquet(f"{DATA}/orders.parquet"), "o_orderkey")
    bucket = Transform("bucket", 16)
    assert all(r["v"] == bucket.apply(r["o_custkey"], Primitive("long")) for r in df.select("v", "o_custkey").collect())


def test_entry_without_the_training_data_subpackage(tmp_path):
    """The entry module and its other queries must stand when that subpackage and the pipeline are gone."""
    root = Path(__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        at = p.relative_to(root)
        if "tests" not in at.parts and "llm" not in at.parts and at.name != "corpus_pipeline.py":
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_aggregate' in q and 'op3_exact_dedup' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/root"})
