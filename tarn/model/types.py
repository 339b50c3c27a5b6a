"""Types, fields and schemas: identity by integer field id; JSON and Spark forms."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from ..errors import SchemaError

#: Types without parameters and their Spark types.
SIMPLE = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(),
    "uuid": T.BinaryType(), "binary": T.BinaryType(),
}
FIELD_ID, DOC, KIND = "parquet.field.id", "tarn.doc", "tarn.type"


@dataclass(frozen=True)
class Primitive:
    """A scalar type: a name of SIMPLE, time, decimal (with precision and scale) or fixed (with length)."""

    name: str
    precision: int = 0
    scale: int = 0
    length: int = 0

    def __str__(self) -> str:
        if self.name == "decimal":
            return f"decimal({self.precision},{self.scale})"
        return f"fixed[{self.length}]" if self.name == "fixed" else self.name

    @classmethod
    def parse(cls, text: str) -> Primitive:
        if m := re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)", text):
            return cls("decimal", int(m[1]), int(m[2]))
        if m := re.fullmatch(r"fixed\[\s*(\d+)\s*\]", text):
            return cls("fixed", length=int(m[1]))
        if text in SIMPLE or text == "time":
            return cls(text)
        raise SchemaError(f"no such type: {text}")

    def to_json(self) -> str:
        return str(self)

    def to_spark(self) -> T.DataType:
        if self.name == "decimal":
            return T.DecimalType(self.precision, self.scale)
        if self.name == "time":
            return T.TimeType(6)
        return T.BinaryType() if self.name == "fixed" else SIMPLE[self.name]


@dataclass(frozen=True)
class ListType:
    element_id: int
    element_required: bool
    element: Type

    def to_json(self) -> dict:
        return {"type": "list", "element-id": self.element_id, "element-required": self.element_required, "element": self.element.to_json()}

    def to_spark(self) -> T.DataType:
        return T.ArrayType(self.element.to_spark(), not self.element_required)

    def parts(self) -> list[Field]:
        return [Field(self.element_id, "element", self.element_required, self.element)]


@dataclass(frozen=True)
class MapType:
    key_id: int
    key: Type
    value_id: int
    value_required: bool
    value: Type

    def to_json(self) -> dict:
        return {
            "type": "map", "key-id": self.key_id, "key": self.key.to_json(),
            "value-id": self.value_id, "value-required": self.value_required, "value": self.value.to_json(),
        }

    def to_spark(self) -> T.DataType:
        return T.MapType(self.key.to_spark(), self.value.to_spark(), not self.value_required)

    def parts(self) -> list[Field]:
        return [Field(self.key_id, "key", True, self.key), Field(self.value_id, "value", self.value_required, self.value)]


@dataclass(frozen=True)
class StructType:
    fields: tuple[Field, ...] = ()

    def to_json(self) -> dict:
        return {"type": "struct", "fields": [f.to_json() for f in self.fields]}

    def to_spark(self) -> T.StructType:
        return T.StructType([f.to_spark() for f in self.fields])

    def parts(self) -> list[Field]:
        return list(self.fields)


Type = Primitive | ListType | MapType | StructType


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    required: bool
    type: Type
    doc: str | None = None

    def to_json(self) -> dict:
        out = {"id": self.id, "name": self.name, "required": self.required, "type": self.type.to_json()}
        return out | ({"doc": self.doc} if self.doc is not None else {})

    def to_spark(self) -> T.StructField:
        meta: dict = {FIELD_ID: self.id}
        if self.doc is not None:
            meta[DOC] = self.doc
        if isinstance(self.type, Primitive) and self.type.name in ("uuid", "fixed"):
            meta[KIND] = str(self.type)
        return T.StructField(self.name, self.type.to_spark(), not self.required, meta)

    def is_primitive(self) -> bool:
        return isinstance(self.type, Primitive)


def type_from_json(j: str | dict) -> Type:
    if isinstance(j, str):
        return Primitive.parse(j)
    kind = j.get("type")
    if kind == "struct":
        return StructType(tuple(field_from_json(f) for f in j["fields"]))
    if kind == "list":
        return ListType(j["element-id"], j["element-required"], type_from_json(j["element"]))
    if kind == "map":
        return MapType(j["key-id"], type_from_json(j["key"]), j["value-id"], j["value-required"], type_from_json(j["value"]))
    raise SchemaError(f"no such type: {kind}")


def field_from_json(j: dict) -> Field:
    return Field(j["id"], j["name"], j["required"], type_from_json(j["type"]), j.get("doc"))


class Ids:
    """Hands out field ids above the highest one in use."""

    def __init__(self, last: int = 0):
        self.last = last

    def __call__(self) -> int:
        self.last += 1
        return self.last


def fresh(t: Type, ids: Ids) -> Type:
    """t with new ids in depth-first order: an element, key or value has its own before what is in it."""
    if isinstance(t, StructType):
        return StructType(tuple(fresh_field(f, ids) for f in t.fields))
    if isinstance(t, ListType):
        own = ids()
        return ListType(own, t.element_required, fresh(t.element, ids))
    if isinstance(t, MapType):
        key_id = ids()
        key = fresh(t.key, ids)
        value_id = ids()
        return MapType(key_id, key, value_id, t.value_required, fresh(t.value, ids))
    return t


def fresh_field(f: Field, ids: Ids) -> Field:
    own = ids()
    return replace(f, id=own, type=fresh(f.type, ids))


#: Spark types that widen to one of ours.
_FROM_SPARK = {
    T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float",
    T.DoubleType: "double", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.StringType: "string",
}


def type_from_spark(t: T.DataType, kind: str | None = None) -> Type:
    """Ids are 0 until with_fresh_ids()."""
    if isinstance(t, T.StructType):
        return StructType(tuple(field_from_spark(f) for f in t.fields))
    if isinstance(t, T.ArrayType):
        return ListType(0, not t.containsNull, type_from_spark(t.elementType))
    if isinstance(t, T.MapType):
        return MapType(0, type_from_spark(t.keyType), 0, not t.valueContainsNull, type_from_spark(t.valueType))
    if isinstance(t, T.DecimalType):
        return Primitive("decimal", t.precision, t.scale)
    if isinstance(t, T.BinaryType):
        return Primitive.parse(kind or "binary")
    if type(t).__name__ == "TimeType":
        return Primitive("time")
    for spark, name in _FROM_SPARK.items():
        if type(t) is spark:
            return Primitive(name)
    raise SchemaError(f"no type of tables holds Spark's {t.simpleString()}")


def field_from_spark(f: T.StructField) -> Field:
    meta = f.metadata or {}
    return Field(int(meta.get(FIELD_ID, 0)), f.name, not f.nullable, type_from_spark(f.dataType, meta.get(KIND)), meta.get(DOC))


@dataclass(frozen=True)
class Schema:
    id: int
    fields: tuple[Field, ...] = ()
    identifier_field_ids: tuple[int, ...] | None = None
    extras: dict = field(default_factory=dict, compare=False)

    def struct(self) -> StructType:
        return StructType(self.fields)

    def all_fields(self) -> Iterator[Field]:
        """Every field, nested ones too, depth first."""

        def walk(parts: list[Field]) -> Iterator[Field]:
            for f in parts:
                yield f
                if not f.is_primitive():
                    yield from walk(f.type.parts())

        return walk(list(self.fields))

    def all_fields_by_id(self) -> dict[int, Field]:
        return {f.id: f for f in self.all_fields()}

    def all_fields_by_name(self) -> dict[str, Field]:
        """By dotted name, such as users.element.first_name."""
        found: dict[str, Field] = {}

        def walk(parts: list[Field], above: str) -> None:
            for f in parts:
                found[above + f.name] = f
                if not f.is_primitive():
                    walk(f.type.parts(), f"{above}{f.name}.")

        walk(list(self.fields), "")
        return found

    def get_field_by_name(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def max_field_id(self) -> int:
        return max((f.id for f in self.all_fields()), default=0)

    def with_id(self, schema_id: int) -> Schema:
        return replace(self, id=schema_id)

    def with_fresh_ids(self, last: int = 0) -> Schema:
        ids = Ids(last)
        return replace(self, fields=tuple(fresh_field(f, ids) for f in self.fields))

    def to_spark(self) -> T.StructType:
        return self.struct().to_spark()

    @classmethod
    def from_spark(cls, struct: T.StructType, schema_id: int = 0) -> Schema:
        """A new schema of a DataFrame's columns, with ids from 1 in order."""
        return cls(schema_id, type_from_spark(struct).fields).with_fresh_ids()

    def to_json(self) -> dict:
        own = {} if self.identifier_field_ids is None else {"identifier-field-ids": list(self.identifier_field_ids)}
        return self.extras | {"type": "struct", "schema-id": self.id} | own | {"fields": [f.to_json() for f in self.fields]}

    @classmethod
    def from_json(cls, j: dict) -> Schema:
        known = {"type", "schema-id", "identifier-field-ids", "fields"}
        ids = j.get("identifier-field-ids")
        return cls(j.get("schema-id", 0), tuple(field_from_json(f) for f in j["fields"]), None if ids is None else tuple(ids), {k: v for k, v in j.items() if k not in known})

    def encode(self) -> str:
        return json.dumps(self.to_json())

    @classmethod
    def decode(cls, text: str) -> Schema:
        try:
            return cls.from_json(json.loads(text))
        except (ValueError, KeyError, TypeError) as e:
            raise SchemaError(f"not a schema: {e}") from e


class SchemaBuilder:
    """Fields with ids from 1. Nested fields are made before the field that holds them and so have lower ids."""

    def __init__(self, schema_id: int = 0):
        self.schema_id, self.ids, self.fields = schema_id, Ids(), []

    def new_primitive(self, name: str, kind: str) -> Field:
        return Field(self.ids(), name, False, Primitive.parse(kind))

    def __getattr__(self, name: str):
        """new_<kind>(name) for each type without parameters."""
        kind = name.removeprefix("new_")
        if name.startswith("new_") and (kind in SIMPLE or kind == "time"):
            return lambda column: self.new_primitive(column, kind)
        raise AttributeError(name)

    def new_struct(self, name: str, fields: list[Field]) -> Field:
        return Field(self.ids(), name, False, StructType(tuple(fields)))

    def new_list(self, name: str, element: Type, element_required: bool = True) -> Field:
        own = self.ids()
        return Field(own, name, False, ListType(self.ids(), element_required, element))

    def new_map(self, name: str, key: Type, value: Type, value_required: bool = False) -> Field:
        own, key_id = self.ids(), self.ids()
        return Field(own, name, False, MapType(key_id, key, self.ids(), value_required, value))

    def add(self, f: Field, required: bool = False, doc: str | None = None) -> SchemaBuilder:
        self.fields.append(replace(f, required=required or f.required, doc=doc or f.doc))
        return self

    def build(self) -> Schema:
        return Schema(self.schema_id, tuple(self.fields))
