"""Partition specs: which transforms of which fields make up a file's partition tuple."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PartitionError
from ..functions.transforms import Transform
from . import values
from .types import Field, Primitive, Schema, StructType

FIRST_ID = 1000


@dataclass(frozen=True)
class PartitionField:
    source_id: int
    field_id: int
    name: str
    transform: Transform

    def to_json(self) -> dict:
        return {"source-id": self.source_id, "field-id": self.field_id, "name": self.name, "transform": str(self.transform)}

    @classmethod
    def from_json(cls, j: dict) -> PartitionField:
        return cls(j["source-id"], j["field-id"], j["name"], Transform.parse(j["transform"]))


def _sources(schema: Schema) -> dict[int, tuple[str, Primitive]]:
    """The primitive fields that are reachable through structs alone: dotted name and type by id."""
    found: dict[int, tuple[str, Primitive]] = {}

    def walk(fields: tuple[Field, ...], above: str) -> None:
        for f in fields:
            if isinstance(f.type, Primitive):
                found[f.id] = (above + f.name, f.type)
            elif isinstance(f.type, StructType):
                walk(f.type.fields, f"{above}{f.name}.")

    walk(schema.fields, "")
    return found


@dataclass(frozen=True)
class PartitionSpec:
    spec_id: int
    fields: tuple[PartitionField, ...] = ()

    @classmethod
    def unpartitioned(cls) -> PartitionSpec:
        return cls(0)

    @classmethod
    def try_new(cls, spec_id: int, fields: list[PartitionField], schema: Schema) -> PartitionSpec:
        spec = cls(spec_id, tuple(fields))
        spec.bind(schema)
        return spec

    @staticmethod
    def builder(spec_id: int, schema: Schema) -> PartitionSpecBuilder:
        return PartitionSpecBuilder(spec_id, schema)

    def bind(self, schema: Schema) -> list[tuple[PartitionField, str, Primitive]]:
        """Each field with its source's dotted name and type; raises where the spec does not fit the schema."""
        sources, ids, names, bound = _sources(schema), set(), set(), []
        for f in self.fields:
            if f.field_id in ids:
                raise PartitionError(f"partition field id {f.field_id} is used twice")
            if not f.name or f.name in names:
                raise PartitionError(f"partition field name {f.name!r} is empty or used twice")
            if f.source_id not in sources:
                raise PartitionError(f"no primitive field with id {f.source_id}")
            ids.add(f.field_id)
            names.add(f.name)
            path, kind = sources[f.source_id]
            f.transform.result_type(kind)
            bound.append((f, path, kind))
        return bound

    def is_empty(self) -> bool:
        return not self.fields

    def last_assigned_field_id(self) -> int:
        return max((f.field_id for f in self.fields), default=FIRST_ID - 1)

    def as_struct_type(self, schema: Schema) -> StructType:
        """The type of a partition tuple, all optional."""
        return StructType(tuple(Field(f.field_id, f.name, False, f.transform.result_type(t)) for f, _, t in self.bind(schema)))

    def columns(self, schema: Schema) -> list[Column]:
        """The tuple's values as expressions over the table's columns."""
        out = []
        for f, path, t in self.bind(schema):
            c = F.col(".".join(f"`{p}`" for p in path.split(".")))
            out.append(f.transform.column(c, t).alias(f.name))
        return out

    def partition_values(self, by_source: dict[int, Any], schema: Schema) -> dict[str, Any]:
        """The tuple of one row, given its source values by field id."""
        out = {}
        for f, _, t in self.bind(schema):
            if f.source_id not in by_source:
                raise PartitionError(f"no value for field {f.source_id}")
            try:
                out[f.name] = f.transform.apply(by_source[f.source_id], t)
            except (values.BadValue, TypeError, AttributeError) as e:
                raise PartitionError(str(e)) from e
        return out

    def path(self, tuple_: dict[str, Any], schema: Schema) -> str:
        """name=value/… with values percent-encoded; null as null, days and years as numbers."""
        return "/".join(f"{f.name}={quote(values.display(tuple_.get(f.name), f.type), safe=' ()+,.:;@_-')}" for f in self.as_struct_type(schema).fields)

    def path_column(self, schema: Schema) -> Column:
        """The same as an expression over the table's columns, without encoding."""
        parts = [F.concat(F.lit(f"{f.name}="), F.coalesce(c.cast("string"), F.lit("null"))) for f, c in zip(self.fields, self.columns(schema), strict=True)]
        return F.concat_ws("/", *parts)

    def to_json(self) -> dict:
        return {"spec-id": self.spec_id, "fields": [f.to_json() for f in self.fields]}

    @classmethod
    def from_json(cls, j: dict) -> PartitionSpec:
        return cls(j["spec-id"], tuple(PartitionField.from_json(f) for f in j["fields"]))


class PartitionSpecBuilder:
    """Fields by name; ids from 1000. A source is used once for each transform at most."""

    def __init__(self, spec_id: int, schema: Schema):
        self.spec_id, self.schema, self.fields = spec_id, schema, []

    def add(self, column: str, transform: Transform, name: str) -> PartitionSpecBuilder:
        f = self.schema.get_field_by_name(column)
        if f is None:
            raise PartitionError(f"no field {column}")
        if any(p.source_id == f.id and p.transform == transform for p in self.fields):
            raise PartitionError(f"{column} is partitioned by {transform} already")
        self.fields.append(PartitionField(f.id, FIRST_ID + len(self.fields), name, transform))
        return self

    def identity(self, column: str) -> PartitionSpecBuilder:
        return self.add(column, Transform("identity"), column)

    def void(self, column: str) -> PartitionSpecBuilder:
        return self.add(column, Transform("void"), f"{column}_null")

    def year(self, column: str) -> PartitionSpecBuilder:
        return self.add(column, Transform("year"), f"{column}_year")

    def month(self, column: str) -> PartitionSpecBuilder:
        return self.add(column, Transform("month"), f"{column}_month")

    def day(self, column: str) -> PartitionSpecBuilder:
        return self.add(column, Transform("day"), f"{column}_day")

    def hour(self, column: str) -> PartitionSpecBuilder:
        return self.add(column, Transform("hour"), f"{column}_hour")

    def bucket(self, column: str, n: int) -> PartitionSpecBuilder:
        return self.add(column, Transform("bucket", n), f"{column}_bucket")

    def truncate(self, column: str, width: int) -> PartitionSpecBuilder:
        return self.add(column, Transform("truncate", width), f"{column}_trunc")

    def build(self) -> PartitionSpec:
        return PartitionSpec.try_new(self.spec_id, self.fields, self.schema)
