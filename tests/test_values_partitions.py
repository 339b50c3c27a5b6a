from __future__ import annotations

import datetime as dt
import decimal
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.errors import BadValue, PartitionError
from tarn.functions.transforms import Transform, murmur3
from tarn.model import values
from tarn.model.partitioning import PartitionField, PartitionSpec
from tarn.model.types import Field, ListType, Primitive, Schema, StructType

P = Primitive.parse


def test_json_forms():
    t = dt.datetime(2017, 11, 16, 22, 31, 8, 123456)
    cases = [
        (42, P("int"), 42), (dt.date(2023, 1, 1), P("date"), "2023-01-01"), (dt.time(22, 31, 8, 123456), P("time"), "22:31:08.123456"),
        (t, P("timestamp"), "2017-11-16T22:31:08.123456"), (t.replace(tzinfo=dt.UTC), P("timestamptz"), "2017-11-16T22:31:08.123456+00:00"),
        (uuid.UUID(int=5), P("uuid"), str(uuid.UUID(int=5))), (b"\x00\x01\x02\xff", P("binary"), "000102ff"),
        ({"a": 1, "b": 2}, StructType((Field(1, "a", False, P("int")), Field(2, "b", False, P("int")))), {"a": 1, "b": 2}),
        ([1, 2, 3], ListType(1, False, P("int")), [1, 2, 3]),
    ]
    for v, kind, j in cases:
        assert values.to_json(v, kind) == j and values.from_json(j, kind) == v


def test_binary_forms():
    assert values.to_bytes(0x11223344, P("int")) == b"\x44\x33\x22\x11"
    assert values.to_bytes(True, P("boolean")) == b"\x01" and values.to_bytes(False, P("boolean")) == b"\x00"
    assert values.from_bytes(values.to_bytes(5, P("int")), P("long")) == 5
    with pytest.raises(BadValue):
        values.to_bytes("x", P("int"))
    with pytest.raises(BadValue):
        values.to_bytes([1], ListType(1, False, P("int")))
    with pytest.raises(BadValue):
        values.to_bytes(b"abc", P("fixed[4]"))


@given(st.one_of(
    st.tuples(st.integers(-(2**31), 2**31 - 1), st.just("int")), st.tuples(st.integers(-(2**63), 2**63 - 1), st.just("long")),
    st.tuples(st.dates(), st.just("date")), st.tuples(st.datetimes(), st.just("timestamp")), st.tuples(st.times(), st.just("time")),
    st.tuples(st.text(), st.just("string")), st.tuples(st.uuids(), st.just("uuid")), st.tuples(st.binary(), st.just("binary")),
    st.tuples(st.decimals(-1000, 1000, places=2), st.just("decimal(9,2)")), st.tuples(st.floats(allow_nan=False), st.just("double")),
))
def test_round_trips(case):
    v, kind = case
    assert values.from_bytes(values.to_bytes(v, P(kind)), P(kind)) == v
    assert values.from_json(values.to_json(v, P(kind)), P(kind)) == v


def test_infer_and_display():
    assert values.infer([None, 3]) == ListType(0, False, P("long"))
    assert values.infer(decimal.Decimal("1.25")) == P("decimal(3,2)")
    for empty in ([], [None], object()):
        with pytest.raises(BadValue):
            values.infer(empty)
    assert values.display(None, P("int")) == "null" and values.display(True, P("boolean")) == "true"
    with pytest.raises(BadValue):
        values.display([1], ListType(1, False, P("int")))


def schema() -> Schema:
    return Schema(0, (Field(0, "id", True, P("long")), Field(1, "user_id", True, P("string")), Field(2, "ts", True, P("timestamp")), Field(3, "l", False, ListType(4, True, P("int")))))


def spec() -> PartitionSpec:
    return PartitionSpec.builder(0, schema()).identity("user_id").add("ts", Transform("day"), "ts_day").build()


def test_spec_and_tuple():
    s = spec()
    assert [(f.field_id, f.name) for f in s.fields] == [(1000, "user_id"), (1001, "ts_day")] and s.last_assigned_field_id() == 1001
    assert [(f.id, f.type) for f in s.as_struct_type(schema()).fields] == [(1000, P("string")), (1001, P("int"))]
    tuple_ = s.partition_values({1: "a", 2: dt.datetime(2023, 1, 1)}, schema())
    assert s.path(tuple_, schema()) == "user_id=a/ts_day=19358"
    assert s.path({"user_id": None, "ts_day": None}, schema()) == "user_id=null/ts_day=null"
    assert s.path({"user_id": "a/b=c", "ts_day": 1}, schema()) == "user_id=a%2Fb%3Dc/ts_day=1"
    assert PartitionSpec.from_json(s.to_json()) == s and PartitionSpec.unpartitioned().is_empty()
    for bad in ({1: "a"}, {1: 5, 2: dt.datetime(2023, 1, 1)}, {1: "a", 2: "x"}):
        with pytest.raises(PartitionError):
            s.partition_values(bad, schema())


@pytest.mark.parametrize("fields", [
    [PartitionField(1, 1000, "a", Transform("identity")), PartitionField(2, 1000, "b", Transform("day"))], [PartitionField(9, 1000, "a", Transform("identity"))],
    [PartitionField(1, 1000, "", Transform("identity"))], [PartitionField(1, 1000, "a", Transform("identity")), PartitionField(2, 1001, "a", Transform("day"))],
    [PartitionField(4, 1000, "a", Transform("identity"))], [PartitionField(1, 1000, "a", Transform("day"))],
])
def test_bad_specs(fields):
    with pytest.raises(PartitionError):
        PartitionSpec.try_new(0, fields, schema())


def test_transform_text():
    for text in ("void", "identity", "year", "month", "day", "hour", "bucket[16]", "truncate[4]"):
        assert str(Transform.parse(text)) == text
    with pytest.raises(PartitionError):
        Transform.parse("zorder")
    with pytest.raises(PartitionError):
        PartitionSpec.builder(0, schema()).identity("user_id").identity("user_id")


def test_murmur3_known_values():
    # From the format's public specification: hashes of 34 as a long, and of text.
    assert murmur3((34).to_bytes(8, "little")) == 2017239379 and murmur3(b"iceberg") == 1210000089


def test_transforms_agree_with_columns(spark):
    rows = [(dt.datetime(1969, 12, 31, 12), -7, "abcdef"), (dt.datetime(2023, 1, 1), 15, "é"), (None, None, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, n long, s string")
    for text, column, kind in [
        ("year", "ts", "timestamp"), ("month", "ts", "timestamp"), ("day", "ts", "timestamp"), ("hour", "ts", "timestamp"), ("identity", "n", "long"),
        ("void", "s", "string"), ("bucket[16]", "n", "long"), ("bucket[7]", "s", "string"), ("bucket[7]", "ts", "timestamp"), ("truncate[10]", "n", "long"), ("truncate[2]", "s", "string"),
    ]:
        t = Transform.parse(text)
        got = [r[0] for r in df.select(t.column(F.col(column), P(kind))).collect()]
        assert got == [t.apply(r[["ts", "n", "s"].index(column)], P(kind)) for r in rows], text
    assert Transform("day").apply(dt.datetime(1969, 12, 31, 12), P("timestamp")) == -1
