from __future__ import annotations

import json
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tarn.errors import SchemaError
from tarn.model.evolution import SchemaUpdate
from tarn.model.types import Field, ListType, MapType, Primitive, Schema, SchemaBuilder, StructType
from tarn.operators.append import arrow_schema

LONG, STRING, DOUBLE = Primitive("long"), Primitive("string"), Primitive("double")


def nested() -> Schema:
    names = StructType((Field(5, "callsign", True, STRING), Field(6, "rank", True, STRING)))
    return Schema(0, (
        Field(1, "id", True, LONG), Field(2, "ts", False, Primitive("timestamp")), Field(3, "crew", False, ListType(4, True, names)),
        Field(7, "marks", False, MapType(8, STRING, 9, False, DOUBLE)),
    ))


def test_json_round_trip():
    s = nested()
    j = json.loads(s.encode())
    assert j["type"] == "struct" and j["schema-id"] == 0
    assert j["fields"][2]["type"] == {
        "type": "list", "element-id": 4, "element-required": True,
        "element": {"type": "struct", "fields": [
            {"id": 5, "name": "callsign", "required": True, "type": "string"}, {"id": 6, "name": "rank", "required": True, "type": "string"},
        ]},
    }
    assert j["fields"][3]["type"] == {"type": "map", "key-id": 8, "key": "string", "value-id": 9, "value-required": False, "value": "double"}
    assert Schema.decode(s.encode()) == s


def test_ids_and_names():
    s = nested()
    assert s.max_field_id() == 9
    assert [f.id for f in s.all_fields()] == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert "crew.element.callsign" in s.all_fields_by_name()
    assert s.all_fields_by_id()[9].name == "value"
    assert Schema(0).max_field_id() == 0


def test_fresh_ids():
    s = replace(nested(), fields=nested().fields[2:]).with_fresh_ids()
    assert [f.id for f in s.all_fields()] == [1, 2, 3, 4, 5, 6, 7]


def test_builder_orders_nested_ids_first():
    b = SchemaBuilder(3)
    f = b.new_struct("s", [b.new_int("a"), b.new_string("b")])
    assert f.id == 3 and [x.id for x in f.type.fields] == [1, 2]
    assert b.add(f).build().id == 3


@pytest.mark.parametrize("text", ["boolean", "int", "long", "float", "double", "date", "time", "timestamp", "timestamptz", "string", "uuid", "binary", "decimal(9,2)", "fixed[16]"])
def test_primitive_text(text):
    assert str(Primitive.parse(text)) == text


def test_unknown_type():
    with pytest.raises(SchemaError):
        Primitive.parse("variant")


def test_spark_mapping():
    s = nested()
    struct = s.to_spark()
    assert struct["id"].metadata["parquet.field.id"] == 1 and not struct["id"].nullable
    assert struct["crew"].dataType == T.ArrayType(StructType(s.fields[2].type.element.fields).to_spark(), False)
    again = Schema.from_spark(struct)
    assert [f.name for f in again.fields] == [f.name for f in s.fields] and [f.id for f in again.all_fields()] == list(range(1, 10))
    assert Schema.from_spark(T.StructType([T.StructField("b", T.ByteType())])).fields[0].type == Primitive("int")


def test_arrow_ids_at_every_level():
    a = arrow_schema(nested())
    assert a.field("crew").type.value_field.metadata[b"PARQUET:field_id"] == b"4"
    assert a.field("crew").type.value_type.field("callsign").metadata[b"PARQUET:field_id"] == b"5"


def base() -> Schema:
    return Schema(0, (Field(1, "id", True, Primitive("int")), Field(2, "name", False, STRING, "a doc")), identifier_field_ids=(1,))


def test_add_delete_promote_rename():
    s = SchemaUpdate.for_schema(base()).add_field(None, "ts", False, "timestamp").apply(1)
    assert s.fields[-1] == Field(3, "ts", False, Primitive("timestamp")) and s.id == 1 and s.identifier_field_ids == (1,) and s.fields[1].doc == "a doc"
    assert [f.name for f in SchemaUpdate.for_schema(base()).delete_field(2).apply(1).fields] == ["id"]
    assert SchemaUpdate.for_schema(base()).promote_field(1, "long").apply(1).fields[0].type == LONG
    assert SchemaUpdate.for_schema(base()).rename_field(1, "user_id").apply(1).fields[0].name == "user_id"


def test_add_nested():
    s = SchemaUpdate.for_schema(nested()).add_field(4, "age", False, "int").apply(1)
    assert s.all_fields_by_name()["crew.element.age"].id == 10
    s = SchemaUpdate.for_schema(base()).add_field(None, "l", False, ListType(0, True, StructType((Field(0, "x", False, LONG),)))).apply(1)
    assert [f.id for f in s.all_fields()] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("change", [
    lambda b: b.add_field(99, "x", False, "int"), lambda b: b.add_field(1, "x", False, "int"), lambda b: b.add_field(None, "name", False, "int"),
    lambda b: b.delete_field(99), lambda b: b.promote_field(1, "long").delete_field(1), lambda b: b.delete_field(1).promote_field(1, "long"),
    lambda b: b.promote_field(1, "string"), lambda b: b.promote_field(2, "long"),
])
def test_builder_refuses(change):
    with pytest.raises(SchemaError):
        change(SchemaUpdate.for_schema(base()))


def test_between():
    assert SchemaUpdate.between(nested(), nested()).is_empty()
    target = SchemaUpdate.for_schema(nested()).add_field(4, "age", False, "int").rename_field(2, "at").apply(1)
    u = SchemaUpdate.between(nested(), target)
    assert [f.id for f in u.added_fields()] == [10] and list(u.changed) == [2]
    assert u.apply(1, nested()) == target
    lost = replace(base(), fields=base().fields[:1])
    assert SchemaUpdate.between(base(), lost).deleted_fields() == [2]
    assert SchemaUpdate.between(lost, base()).merge(SchemaUpdate(deleted={1})).deleted == {1}


@pytest.mark.parametrize("new", [
    Field(1, "id", True, STRING), Field(2, "name", True, STRING), Field(2, "name", False, ListType(5, True, STRING)),
])
def test_between_refuses(new):
    with pytest.raises(SchemaError):
        SchemaUpdate.between(base(), replace(base(), fields=tuple(new if f.id == new.id else f for f in base().fields)))


def test_narrowing_and_list_elements_refused():
    with pytest.raises(SchemaError):
        SchemaUpdate.between(Schema(0, (Field(1, "a", False, LONG),)), Schema(0, (Field(1, "a", False, Primitive("int")),)))
    lists = [Schema(0, (Field(1, "l", False, ListType(2, True, t)),)) for t in (STRING, Primitive("int"))]
    with pytest.raises(SchemaError):
        SchemaUpdate.between(*lists)
    wide = SchemaUpdate.between(Schema(0, (Field(1, "d", False, Primitive("decimal", 7, 2)),)), Schema(0, (Field(1, "d", False, Primitive("decimal", 20, 2)),)))
    assert list(wide.promoted) == [1]


def test_an_id_can_not_move():
    moved = Schema(1, (Field(1, "id", True, LONG), Field(5, "callsign", False, STRING)))
    with pytest.raises(SchemaError):
        SchemaUpdate.between(nested(), moved)


types = st.recursive(
    st.sampled_from([LONG, STRING, DOUBLE, Primitive("date")]),
    lambda inner: st.one_of(
        st.builds(lambda t, r: ListType(0, r, t), inner, st.booleans()),
        st.builds(lambda t: MapType(0, STRING, 0, False, t), inner),
        st.lists(inner, min_size=1, max_size=3).map(lambda ts: StructType(tuple(Field(0, f"f{i}", False, t) for i, t in enumerate(ts)))),
    ),
    max_leaves=6,
)


@settings(max_examples=50, deadline=None)
@given(st.lists(types, min_size=1, max_size=5), st.data())
def test_apply_of_between(kinds, data):
    s = Schema(0, tuple(Field(0, f"c{i}", False, t) for i, t in enumerate(kinds))).with_fresh_ids()
    assert Schema.decode(s.encode()) == s
    b = SchemaUpdate.for_schema(s).add_field(None, "new", False, data.draw(types))
    if data.draw(st.booleans()):
        b.delete_field(s.fields[0].id)
    target = b.apply(1)
    assert SchemaUpdate.between(s, target).apply(1, s) == target
