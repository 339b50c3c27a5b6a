from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.errors import AvroError, CommitConflict, InvalidMetadata, InvalidPath, MetadataNotFound, SchemaError, TableAlreadyExists, TableNotInitialized, Unsupported
from tarn.model.evolution import SchemaUpdate
from tarn.model.manifests import (
    DataFile, Entry, FileContent, Manifest, ManifestFile, ManifestReader, ManifestWriter, Status, decode_manifest_list, encode_manifest, encode_manifest_list,
)
from tarn.model.metadata import SortField, SortOrder, TableMetadata
from tarn.model.partitioning import PartitionSpec
from tarn.model.types import Field, Primitive, Schema
from tarn.operators.transaction import OverwriteFiles
from tarn.sources import avro
from tarn.sources.storage import Storage, data_path
from tarn.sources.table import Table, TableLoader, table_like

P = Primitive.parse
EVENTS = Schema(0, (Field(1, "id", True, P("long")), Field(2, "ts", False, P("timestamp")), Field(3, "name", False, P("string"))))


def new(spark, tmp_path, schema=EVENTS, **how) -> Table:
    loader = TableLoader(spark, f"file://{tmp_path}/t").with_schema(schema)
    if "spec" in how:
        loader.with_partition_spec(how["spec"])
    return loader.with_properties(how.get("properties", {})).create()


def fake(name: str, k: int) -> DataFile:
    return DataFile(f"/data/{name}.parquet", 1111 * k, 10111 * k)


def manifests(table: Table) -> list[ManifestFile]:
    return table.read_manifest_list(table.current_snapshot())


def test_append_twice(spark, tmp_path):
    t = new(spark, tmp_path)
    t.add_files([fake("f1", 1)])
    t.add_files([DataFile("/data/f2.parquet", 2222, 20222)])
    a, b = manifests(TableLoader(spark, t.location).load())
    assert (a.sequence_number, b.sequence_number, a.added_files, b.added_files, a.added_rows, b.added_rows, b.existing_files) == (1, 2, 1, 1, 1111, 2222, 0)


def test_overwrite(spark, tmp_path):
    t = new(spark, tmp_path)
    t.add_files([fake("f1", 1)])
    t.add_files([DataFile("/data/f2.parquet", 2222, 20222)])
    t.new_transaction().overwrite_files(delete=["/data/f1.parquet", "/data/none.parquet"], add=[DataFile("/data/f3.parquet", 3333, 30333)]).commit()
    (m,) = manifests(t)
    assert m.sequence_number == 3 and (m.added_files, m.added_rows, m.existing_files, m.existing_rows, m.deleted_files, m.deleted_rows) == (1, 3333, 1, 2222, 1, 1111)
    numbers = {e.status: (e.sequence_number, e.data_file.file_path) for e, _ in t.read_entries()}
    assert numbers == {Status.DELETED: (1, "/data/f1.parquet"), Status.EXISTING: (2, "/data/f2.parquet"), Status.ADDED: (3, "/data/f3.parquet")}
    stats = t.current_snapshot().summary.stats
    assert (stats["total-records"], stats["deleted-records"], stats["added-records"]) == ("5555", "1111", "3333")
    t.new_transaction().overwrite_files(delete_all=True).commit()
    assert t.live_files() == [] and t.current_snapshot().summary.stats["total-records"] == "0"


def test_delete_manifests_are_carried(spark, tmp_path):
    t = new(spark, tmp_path)
    t.add_files([fake("f1", 1)])
    deletes = Manifest(EVENTS, PartitionSpec(0), "deletes", [Entry(Status.ADDED, replace(fake("d", 1), content=FileContent.POSITION_DELETES), 7)])
    data, described = ManifestWriter(1, 7).write(t.storage.to_uri("metadata/d.avro"), deletes)
    t.storage.put("metadata/d.avro", data)
    t.storage.put(t.storage.relative(t.current_snapshot().manifest_list), encode_manifest_list([*manifests(t), described]))
    t.new_transaction().overwrite_files(add=[fake("f9", 1)]).commit()
    assert [m.content for m in manifests(t)] == [0, 1]
    t.new_transaction().overwrite_files(delete_all=True).commit()
    assert [m.content for m in manifests(t)] == [0]


def test_manifest_round_trip():
    names = ["orderkey", "suppkey", "shipdate"]
    s = Schema(0, tuple(Field(i + 1, n, False, P("date" if n == "shipdate" else "long")) for i, n in enumerate(names)))
    spec = PartitionSpec.builder(0, s).identity("suppkey").identity("shipdate").build()
    f = DataFile("/tmp/data_file", 1000, 10000, {"suppkey": 555, "shipdate": dt.date(1969, 1, 1)}, lower_bounds={1: b"\x01"}, column_sizes={1: 9163}, split_offsets=[4])
    m = Manifest(s, spec, entries=[Entry(Status.ADDED, f, 3988626671889928484, None, None)])
    data, described = ManifestWriter(1, 3988626671889928484).write("/m.avro", m)
    again = ManifestReader.for_manifest_file(described).read(data)
    assert again.schema == s and again.spec == spec and again.entries[0].data_file == f and again.entries[0].sequence_number == 1
    assert described.partitions[0].lower_bound == (555).to_bytes(8, "little") and not described.partitions[1].contains_null
    assert decode_manifest_list(encode_manifest_list([described])) == [described]


def test_inheritance_only_for_added():
    m = Manifest(EVENTS, PartitionSpec(0), entries=[Entry(s, fake("f", 1)) for s in (Status.ADDED, Status.EXISTING)])
    got = ManifestReader(5, 77).read(encode_manifest(m)).entries
    assert [(e.snapshot_id, e.sequence_number) for e in got] == [(77, 5), (77, None)]


def test_other_names_of_list_counts():
    renamed = json.loads(json.dumps(avro.read_file(encode_manifest_list([]))[0]).replace("added_files_count", "added_data_files_count"))
    row = {"manifest_path": "p", "manifest_length": 1, "partition_spec_id": 0, "content": 0, "sequence_number": 1, "min_sequence_number": 1, "added_snapshot_id": 2,
           "added_data_files_count": 3, "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": 5, "existing_rows_count": 0, "deleted_rows_count": 0}
    assert decode_manifest_list(avro.write_file(renamed, [row], codec="deflate"))[0].added_files == 3


def test_avro_agrees_with_the_jvm(spark, tmp_path):
    """Spark's class path has another implementation of the format."""
    data = encode_manifest(Manifest(EVENTS, PartitionSpec(0), entries=[Entry(Status.ADDED, replace(fake("é", 1), lower_bounds={1: b"ab"}), 5, 6)]))
    path = tmp_path / "m.avro"
    path.write_bytes(data)
    jvm = spark._jvm
    reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(str(path)), jvm.org.apache.avro.generic.GenericDatumReader())
    row = json.loads(reader.next().toString())
    assert row["status"] == 1 and row["data_file"]["file_path"] == "/data/é.parquet" and row["data_file"]["record_count"] == 1111


@settings(max_examples=40)
@given(st.lists(st.fixed_dictionaries({"a": st.integers(-(2**63), 2**63 - 1), "b": st.none() | st.text(), "c": st.lists(st.floats(allow_nan=False)), "d": st.dictionaries(st.text(), st.binary())})), st.sampled_from(["null", "deflate"]))
def test_avro_round_trip(rows, codec):
    fields = [("a", "long"), ("b", ["null", "string"]), ("c", {"type": "array", "items": "double"}), ("d", {"type": "map", "values": "bytes"})]
    schema = {"type": "record", "name": "r", "fields": [{"name": n, "type": t} for n, t in fields]}
    assert avro.read_file(avro.write_file(schema, rows, codec=codec))[2] == rows


def test_avro_errors():
    with pytest.raises(AvroError):
        avro.read_file(b"no")
    with pytest.raises(AvroError):
        avro.read_file(encode_manifest_list([])[:20])


def test_metadata_keeps_unknown_keys():
    j = TableMetadata.new("file:///t", EVENTS, PartitionSpec(0)).to_json() | {"statistics": [{"x": 1}], "current-snapshot-id": None}
    again = TableMetadata.decode(json.dumps(j))
    assert again.to_json()["statistics"] == [{"x": 1}] and again.current_snapshot() is None and again.to_json()["current-snapshot-id"] == -1
    assert again.last_column_id == 3 and again.last_partition_id == 999
    for bad in ("{", "{}", json.dumps(j | {"format-version": 1})):
        with pytest.raises(InvalidMetadata):
            TableMetadata.decode(bad)


def test_loading(spark, tmp_path):
    loader = TableLoader(spark, f"file://{tmp_path}/x")
    with pytest.raises(MetadataNotFound):
        loader.load()
    assert not (tmp_path / "x").exists() and not Table(spark, f"file://{tmp_path}/x").detect()
    with pytest.raises(SchemaError):
        loader.create()
    with pytest.raises(TableNotInitialized):
        _ = Table(spark, f"file://{tmp_path}/x").metadata
    t = loader.with_schema(EVENTS).with_properties({"a": "b"}).load_or_create()
    assert loader.load_or_create().metadata == t.metadata and t.metadata.properties == {"a": "b"}
    with pytest.raises(TableAlreadyExists):
        loader.create()


def test_newest_version_is_by_number(spark, tmp_path):
    t = new(spark, tmp_path)
    for n in (99999, 100000):
        m = replace(t.metadata, properties={"n": str(n)})
        t.storage.put(f"metadata/{n}-00000000-0000-0000-0000-000000000000.metadata.json", m.encode().encode())
    assert TableLoader(spark, t.location).load().metadata.properties == {"n": "100000"}


def test_storage(spark, tmp_path):
    s = Storage(spark, f"file://{tmp_path}/a b")
    assert s.put("d/x", b"1", exclusive=True) and not s.put("d/x", b"2", exclusive=True) and s.get("d/x") == b"1"
    assert s.relative(s.to_uri("d/x")) == "d/x" and [m.location for m in s.list("d")] == ["d/x"] and s.list("none") == []
    with pytest.raises(InvalidPath):
        s.relative("file:///elsewhere/x")
    s.delete("d/x")
    assert not s.exists("d/x")
    assert data_path("f", "a=1") == "data/a=1/f" and len(data_path("f", "").split("/")[1]) == 8


def test_two_writers_lose_nothing(spark, tmp_path):
    a = new(spark, tmp_path)
    b = TableLoader(spark, a.location).load()
    a.add_files([fake("a", 1)])
    b.add_files([fake("b", 2)])
    a.add_files([fake("c", 3)])
    got = TableLoader(spark, a.location).load()
    assert {f.file_path for f, _ in got.live_files()} == {f"/data/{n}.parquet" for n in "abc"} and got.current_snapshot().summary.stats["total-records"] == "6666"


def test_conflict_without_retries(spark, tmp_path):
    a = new(spark, tmp_path, properties={"commit.retry.num-retries": "0"})
    b = TableLoader(spark, a.location).load()
    a.add_files([fake("a", 1)])
    with pytest.raises(CommitConflict):
        b.add_files([fake("b", 2)])


def test_a_stalled_writer_publishes_nothing(spark, tmp_path, monkeypatch):
    """One that finds the next version free, and then stalls while another writer takes it, doesn't overwrite it."""
    a = new(spark, tmp_path, properties={"commit.retry.num-retries": "0"})
    b = TableLoader(spark, a.location).load()
    b.add_files([fake("b", 2)])
    monkeypatch.setattr(a, "latest_version", lambda: a.version)
    with pytest.raises(CommitConflict):
        a.add_files([fake("a", 1)])
    assert [f.file_path for f, _ in TableLoader(spark, a.location).load().live_files()] == [fake("b", 2).file_path]


def test_many_writers_lose_no_commit(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    t = new(spark, tmp_path, properties={"commit.retry.num-retries": "50"})

    def add(k):
        TableLoader(spark, t.location).load().add_files([fake(f"w{k}", 1)])

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(add, range(12)))
    now = TableLoader(spark, t.location).load()
    assert now.version == 12 and len(now.live_files()) == 12


def test_deletes_apply_to_rows_of_their_time(spark, tmp_path):
    """Position deletes to files no newer than they are, equality deletes to older ones; clashing column names."""
    from tarn.plans import catalog

    df = spark.createDataFrame([(i, i % 3, str(i)) for i in range(30)], "_path long, _place long, pos string")
    t = catalog.table_like(spark, f"file://{tmp_path}/my table", df)
    t.append(df.filter("_path < 20"))
    t.append(df.filter("_path >= 20"))
    t = TableLoader(spark, t.location).load()
    everything = spark.read.parquet(*[f.file_path for f, _ in t.live_files()])
    at = everything.filter("_path in (3, 4, 25)").select(F.regexp_replace(F.url_decode("_metadata.file_path"), "^file:/+", "file:///").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    positions = catalog.delete_files(t, at, FileContent.POSITION_DELETES)
    keys = catalog.delete_files(t, spark.createDataFrame([(1,), (None,)], "_place long"), FileContent.EQUALITY_DELETES, equality_ids=[2])
    catalog.register_deletes(t, positions + keys, 2)
    t = TableLoader(spark, t.location).load()
    kept = sorted(r["_path"] for r in t.scan().collect())
    assert kept == [i for i in range(30) if i not in (3, 4, 25) and (i >= 20 or i % 3 != 1)]
    assert t.scan().columns == df.columns and t.scan(where=[("_path", "<", 4)]).count() == 2


def test_files_of_other_formats(spark, tmp_path):
    from tarn.plans import catalog

    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    t = catalog.table_like(spark, f"file://{tmp_path}/t", df)
    df.write.orc(f"{tmp_path}/orc")
    files = [DataFile(f"file://{p}", 1, 1, file_format="ORC") for p in map(str, tmp_path.glob("orc/*.orc"))]
    t.add_files(files)
    t.append(df)
    assert sorted(r["k"] for r in t.scan().collect()) == [1, 1, 2, 2]
    t.add_files([DataFile(f"file://{tmp_path}/x.avro", 1, 1, file_format="AVRO")])
    with pytest.raises(Unsupported):
        t.scan()


def test_settings_are_left_as_they_were(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        t = new(spark, tmp_path)
        t.append(spark.createDataFrame([(1, None, "a")], "id long, ts timestamp_ntz, name string"))
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_large_tuples_are_rebalanced(spark, tmp_path, monkeypatch):
    """The rows of one partition tuple may go to several tasks: the shuffle is one that AQE splits."""
    import tarn.operators.append as ap
    from tarn.plans import catalog

    df = spark.range(60_000).select(F.lit("one").alias("k"), F.concat(F.lit("x" * 50), F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("v"))
    t = catalog.table_like(spark, f"file://{tmp_path}/t", df, lambda b: b.identity("k"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        t.append(df.repartition(8))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(t.live_files()) > 1 and t.scan().count() == 60_000
    assert ap.FILE_ROWS > 60_000


def test_transaction_is_one_version(spark, tmp_path):
    t = new(spark, tmp_path)
    s = SchemaUpdate.for_schema(EVENTS).add_field(None, "x", False, "int").apply(0)
    t.new_transaction().append_files([fake("a", 1)]).update_schema(s).overwrite_files(delete_all=True, add=[fake("b", 1)]).commit()
    assert t.version == 1 and t.metadata.last_sequence_number == 3 and len(t.metadata.snapshots) == 2 and t.metadata.refs["main"].snapshot_id == t.metadata.current_snapshot_id
    assert [x["metadata-file"].rsplit("/", 1)[1][:5] for x in t.metadata.metadata_log] == ["00000"]


def test_schema_rules_of_tables(spark, tmp_path):
    t = new(spark, tmp_path, spec=PartitionSpec.builder(0, EVENTS).identity("name").build())
    with pytest.raises(SchemaError):
        t.new_transaction().update_schema(SchemaUpdate.for_schema(EVENTS).delete_field(3).apply(0)).commit()
    t.new_transaction().update_schema(SchemaUpdate.for_schema(EVENTS).add_field(None, "r", True, "int").apply(0)).commit()
    t.new_transaction().update_schema(SchemaUpdate.for_schema(t.current_schema()).delete_field(4).apply(0)).commit()
    assert t.metadata.last_column_id == 4
    with pytest.raises(SchemaError):  # id 4 was used
        t.new_transaction().update_schema(SchemaUpdate.for_schema(t.current_schema()).add_field(None, "z", False, "int").apply(0)).commit()
    t.new_transaction().append_files([replace(fake("a", 1), partition={"name": "x"})]).commit()
    with pytest.raises(SchemaError):
        t.new_transaction().update_schema(SchemaUpdate.for_schema(t.current_schema(), 4).add_field(None, "q", True, "int").apply(0)).commit()


def test_rows_with_nulls_and_partitions(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"k/{i % 3}", dt.datetime(2020 + i % 2, 1, 1), [i], {"a": i}) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, l array<int>, m map<string,int>")
    t = table_like(spark, f"file://{tmp_path}/t", df, lambda b: b.identity("k").year("ts"))
    t.append(df)
    assert sorted(map(str, t.scan().collect())) == sorted(map(str, df.collect()))
    assert {(f.partition["k"], f.partition["ts_year"]) for f, _ in t.live_files()} == {(r[1], r[2].year - 1970) for r in rows}
    assert t.scan(where=[("k", "is-null", None)]).count() == 10 and len(t.plan(where=[("k", "is-null", None)])) == 2
    assert t.scan(where=[("ts", ">=", dt.datetime(2021, 1, 1)), ("k", "in", ["k/1"])]).count() == sum(r[2].year == 2021 and r[1] == "k/1" for r in rows)
    assert len(t.plan(where=[("id", "<", 1)])) == 1


def test_scan_by_ids_and_pushdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    t = table_like(spark, f"file://{tmp_path}/t", df)
    t.append(df)
    t.new_transaction().update_schema(SchemaUpdate.for_schema(t.current_schema()).rename_field(1, "m").promote_field(1, "long").apply(0)).commit()
    t.append(spark.createDataFrame([(3, "c")], "m long, s string"))
    df.write.parquet(f"{tmp_path}/plain")
    out = t.scan(where=[("m", ">", 1)]).select("m")
    assert sorted(r[0] for r in out.collect()) == [2, 3]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(m,1)" in plan and "ReadSchema: struct<m:bigint>" in plan
    first = t.metadata.snapshots[0].snapshot_id
    assert t.scan(snapshot_id=first).columns == ["n", "s"]


def test_required_fields_and_wrong_columns(spark, tmp_path):
    t = new(spark, tmp_path)
    with pytest.raises(SchemaError):
        t.append(spark.createDataFrame([(1,)], "id long").withColumnRenamed("id", "other"))
    with pytest.raises(SchemaError):
        t.append(spark.createDataFrame([("1",)], "id string"))
    with pytest.raises(Exception, match="null in required field id"):
        t.append(spark.createDataFrame([(None,)], "id long"))
    t.append(spark.createDataFrame([(1,)], "id int"))
    assert [tuple(r) for r in t.scan().collect()] == [(1, None, None)]
    t.append(spark.createDataFrame([], "id long"))
    assert t.scan().count() == 1


def test_sort_order_and_rolling(spark, tmp_path):
    order = SortOrder(1, (SortField(1, direction="desc", null_order="nulls-last"),))
    t = TableLoader(spark, f"file://{tmp_path}/t").with_schema(EVENTS).with_sort_order(order).create()
    t.append(spark.range(100).repartition(1), file_rows=30)
    files = [f for f, _ in t.live_files()]
    assert sorted(f.record_count for f in files) == [10, 30, 30, 30] and all(f.sort_order_id == 1 for f in files)
    assert [r[0] for r in spark.read.parquet(files[0].file_path).collect()] == sorted((r[0] for r in spark.read.parquet(files[0].file_path).collect()), reverse=True)


def test_data_source(spark, tmp_path):
    from tarn.sources.datasource import register

    register(spark)
    t = new(spark, tmp_path, Schema(0, (Field(1, "id", False, P("long")), Field(2, "s", False, P("string")))))
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    rows.write.format("tarn").option("path", t.location).mode("append").save()
    rows.write.format("tarn").option("path", t.location).mode("append").save()
    assert spark.read.format("tarn").option("path", t.location).load().count() == 4
    rows.write.format("tarn").option("path", t.location).mode("overwrite").save()
    assert sorted(map(tuple, TableLoader(spark, t.location).load().scan().collect())) == [(1, "a"), (2, None)]
    # Files without field ids are read by name, as by Table.scan().
    rows.coalesce(1).write.parquet(f"{tmp_path}/plain")
    (plain,) = tmp_path.glob("plain/*.parquet")
    now = TableLoader(spark, t.location).load()
    now.add_files([DataFile(f"file://{plain}", 2, 1)])
    both = [sorted(map(repr, df.collect())) for df in (now.scan(), spark.read.format("tarn").option("path", t.location).load())]
    assert both[0] == both[1] and len(both[0]) == 4


def test_stream_batches_are_committed_once(spark, tmp_path):
    from tarn.streaming.sink import BATCH, QUERY, committed_batches, write_stream

    df = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "id long, name string")
    df.write.parquet(f"{tmp_path}/in")
    t = table_like(spark, f"file://{tmp_path}/t", df)
    t.append(df.limit(0), {QUERY: "q", BATCH: "0"})  # as if batch 0 had been committed before a crash
    write_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), t.location, "q", f"{tmp_path}/cp").awaitTermination()
    t.refresh()
    assert t.scan().count() == 0 and committed_batches(t, "q") == {0}
    write_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), t.location, "r", f"{tmp_path}/cp2").awaitTermination()
    t.refresh()
    assert t.scan().count() == 10


def test_many_manifests_are_read_by_tasks(spark, tmp_path, monkeypatch):
    import tarn.sources.table as module

    t = new(spark, tmp_path)
    for k in range(4):
        t.add_files([fake(f"f{k}", 1)])
    want = sorted(r["file_path"] for r in t.entries().collect())
    monkeypatch.setattr(module, "ON_DRIVER", 1)
    assert sorted(r["file_path"] for r in t.entries().collect()) == want and t.manifests().count() == 4 and t.history().count() == 4


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["append", "delete", "replace", "all"]), st.integers(0, 5)), max_size=6))
def test_random_histories(spark, tmp_path_factory, steps):
    t = new(spark, tmp_path_factory.mktemp("h"))
    live: dict[str, int] = {}
    for n, (what, k) in enumerate(steps):
        f, gone = fake(f"s{n}", k + 1), sorted(live)[k : k + 1]
        if what == "append":
            t.add_files([f])
        elif what == "all":
            t.new_transaction().add_operation(OverwriteFiles([f], everything=True)).commit()
            live.clear()
        else:
            t.new_transaction().overwrite_files(delete=gone, add=[f] if what == "replace" else []).commit()
            for p in gone:
                live.pop(p)
        if what != "delete":
            live[f.file_path] = f.record_count
    t = TableLoader(spark, t.location).load()
    assert {f.file_path: f.record_count for f, _ in t.live_files()} == live
    if steps:
        assert int(t.current_snapshot().summary.stats["total-records"]) == sum(live.values())
