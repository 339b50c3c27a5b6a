"""Table metadata, snapshots and their summaries, logs, references and sort orders, and their JSON."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from ..errors import InvalidMetadata, SerializeMetadataJson, TableNotInitialized
from .partitioning import PartitionSpec
from .types import Schema

VERSION = 2
NO_SNAPSHOT = -1


def now_ms() -> int:
    return time.time_ns() // 1_000_000


@dataclass(frozen=True)
class SortField:
    source_id: int
    transform: str = "identity"
    direction: str = "asc"
    null_order: str = "nulls-first"

    def to_json(self) -> dict:
        return {"source-id": self.source_id, "transform": self.transform, "direction": self.direction, "null-order": self.null_order}

    @classmethod
    def from_json(cls, j: dict) -> SortField:
        return cls(j["source-id"], j["transform"], j["direction"], j["null-order"])


@dataclass(frozen=True)
class SortOrder:
    order_id: int = 0
    fields: tuple[SortField, ...] = ()

    def to_json(self) -> dict:
        return {"order-id": self.order_id, "fields": [f.to_json() for f in self.fields]}

    @classmethod
    def from_json(cls, j: dict) -> SortOrder:
        return cls(j["order-id"], tuple(SortField.from_json(f) for f in j["fields"]))


#: Keys of a summary whose totals go from snapshot to snapshot.
TOTALS = ("total-records", "total-files-size", "total-data-files", "total-delete-files", "total-position-deletes", "total-equality-deletes")


@dataclass
class Summary:
    """An operation and its counts; counts are text in JSON."""

    operation: str
    stats: dict[str, str] = field(default_factory=dict)

    def add(self, key: str, n: int) -> None:
        self.stats[key] = str(int(self.stats.get(key, "0")) + n)

    def copy_totals(self, other: Summary | None) -> None:
        for key in TOTALS:
            if other and key in other.stats:
                self.stats[key] = other.stats[key]

    def added_file(self, records: int, size: int) -> None:
        for key, n in (("added-data-files", 1), ("added-records", records), ("added-files-size", size)):
            self.add(key, n)
        self.existing_file(records, size)

    def existing_file(self, records: int, size: int) -> None:
        for key, n in (("total-data-files", 1), ("total-records", records), ("total-files-size", size)):
            self.add(key, n)

    def removed_file(self, records: int, size: int) -> None:
        for key, n in (("deleted-data-files", 1), ("deleted-records", records), ("removed-files-size", size)):
            self.add(key, n)

    def to_json(self) -> dict:
        return {"operation": self.operation} | self.stats

    @classmethod
    def from_json(cls, j: dict) -> Summary:
        return cls(j.get("operation", "append"), {k: str(v) for k, v in j.items() if k != "operation"})


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: int
    parent_snapshot_id: int | None
    sequence_number: int
    timestamp_ms: int
    manifest_list: str
    summary: Summary
    schema_id: int | None
    extras: dict = field(default_factory=dict, compare=False)

    def to_json(self) -> dict:
        out = self.extras | {
            "snapshot-id": self.snapshot_id, "sequence-number": self.sequence_number, "timestamp-ms": self.timestamp_ms,
            "manifest-list": self.manifest_list, "summary": self.summary.to_json(),
        }
        if self.parent_snapshot_id is not None:
            out["parent-snapshot-id"] = self.parent_snapshot_id
        if self.schema_id is not None:
            out["schema-id"] = self.schema_id
        return out

    @classmethod
    def from_json(cls, j: dict) -> Snapshot:
        known = {"snapshot-id", "parent-snapshot-id", "sequence-number", "timestamp-ms", "manifest-list", "summary", "schema-id"}
        return cls(
            j["snapshot-id"], j.get("parent-snapshot-id"), j.get("sequence-number", 0), j["timestamp-ms"], j["manifest-list"],
            Summary.from_json(j.get("summary", {})), j.get("schema-id"), {k: v for k, v in j.items() if k not in known},
        )


@dataclass(frozen=True)
class Ref:
    """A branch or tag with its retention."""

    snapshot_id: int
    type: str = "branch"
    retention: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"snapshot-id": self.snapshot_id, "type": self.type} | self.retention

    @classmethod
    def from_json(cls, j: dict) -> Ref:
        return cls(j["snapshot-id"], j.get("type", "branch"), {k: v for k, v in j.items() if k not in ("snapshot-id", "type")})


@dataclass(frozen=True)
class TableMetadata:
    """One version of a table. Keys that are not known here are kept in extras and written again."""

    location: str
    schemas: tuple[Schema, ...]
    current_schema_id: int
    partition_specs: tuple[PartitionSpec, ...]
    default_spec_id: int
    table_uuid: str = ""
    last_sequence_number: int = 0
    last_updated_ms: int = 0
    last_column_id: int = 0
    last_partition_id: int = 999
    properties: dict = field(default_factory=dict)
    current_snapshot_id: int = NO_SNAPSHOT
    snapshots: tuple[Snapshot, ...] = ()
    snapshot_log: tuple[dict, ...] = ()
    metadata_log: tuple[dict, ...] = ()
    sort_orders: tuple[SortOrder, ...] = (SortOrder(),)
    default_sort_order_id: int = 0
    refs: dict = field(default_factory=dict)
    format_version: int = VERSION
    extras: dict = field(default_factory=dict)

    @classmethod
    def new(cls, location: str, schema: Schema, spec: PartitionSpec, properties: dict | None = None, sort_order: SortOrder | None = None) -> TableMetadata:
        spec.bind(schema)
        order = sort_order or SortOrder()
        return cls(
            location, (schema,), schema.id, (spec,), spec.spec_id, str(uuid.uuid4()), 0, now_ms(), schema.max_field_id(),
            spec.last_assigned_field_id(), dict(properties or {}), sort_orders=(SortOrder(), order) if order.order_id else (order,), default_sort_order_id=order.order_id,
        )

    def schema(self, schema_id: int) -> Schema:
        for s in self.schemas:
            if s.id == schema_id:
                return s
        raise InvalidMetadata(f"no schema {schema_id}")

    def current_schema(self) -> Schema:
        return self.schema(self.current_schema_id)

    def spec(self, spec_id: int) -> PartitionSpec:
        for s in self.partition_specs:
            if s.spec_id == spec_id:
                return s
        raise InvalidMetadata(f"no partition spec {spec_id}")

    def current_spec(self) -> PartitionSpec:
        return self.spec(self.default_spec_id)

    def sort_order(self) -> SortOrder:
        return next((o for o in self.sort_orders if o.order_id == self.default_sort_order_id), SortOrder())

    def snapshot(self, snapshot_id: int) -> Snapshot:
        for s in self.snapshots:
            if s.snapshot_id == snapshot_id:
                return s
        raise TableNotInitialized(f"no snapshot {snapshot_id}")

    def current_snapshot(self) -> Snapshot | None:
        return None if self.current_snapshot_id == NO_SNAPSHOT else self.snapshot(self.current_snapshot_id)

    def schema_for_spec(self, spec: PartitionSpec) -> Schema:
        """The newest schema that a spec fits: of an old spec, a source field may be gone by now."""
        for s in sorted(self.schemas, key=lambda s: (s.id == self.current_schema_id, s.id), reverse=True):
            if {f.source_id for f in spec.fields} <= s.all_fields_by_id().keys():
                return s
        raise InvalidMetadata(f"no schema has the fields of partition spec {spec.spec_id}")

    def with_snapshot(self, s: Snapshot) -> TableMetadata:
        return replace(
            self, current_snapshot_id=s.snapshot_id, snapshots=(*self.snapshots, s),
            snapshot_log=(*self.snapshot_log, {"snapshot-id": s.snapshot_id, "timestamp-ms": s.timestamp_ms}),
            refs=self.refs | {"main": Ref(s.snapshot_id)},
        )

    def to_json(self) -> dict:
        return self.extras | {
            "format-version": self.format_version, "table-uuid": self.table_uuid, "location": self.location,
            "last-sequence-number": self.last_sequence_number, "last-updated-ms": self.last_updated_ms, "last-column-id": self.last_column_id,
            "schemas": [s.to_json() for s in self.schemas], "current-schema-id": self.current_schema_id,
            "partition-specs": [s.to_json() for s in self.partition_specs], "default-spec-id": self.default_spec_id,
            "last-partition-id": self.last_partition_id, "properties": self.properties, "current-snapshot-id": self.current_snapshot_id,
            "snapshots": [s.to_json() for s in self.snapshots], "snapshot-log": list(self.snapshot_log), "metadata-log": list(self.metadata_log),
            "sort-orders": [o.to_json() for o in self.sort_orders], "default-sort-order-id": self.default_sort_order_id,
            "refs": {k: r.to_json() for k, r in self.refs.items()},
        }

    @classmethod
    def from_json(cls, j: dict) -> TableMetadata:
        known = set(cls("", (), 0, (), 0).to_json())
        try:
            if j["format-version"] != VERSION:
                raise InvalidMetadata(f"format version {j['format-version']}; only {VERSION} is supported")
            current = j.get("current-snapshot-id")
            return cls(
                j["location"], tuple(map(Schema.from_json, j["schemas"])), j["current-schema-id"], tuple(map(PartitionSpec.from_json, j["partition-specs"])),
                j["default-spec-id"], j["table-uuid"], j["last-sequence-number"], j["last-updated-ms"], j["last-column-id"], j["last-partition-id"],
                j.get("properties") or {}, NO_SNAPSHOT if current is None else current, tuple(map(Snapshot.from_json, j.get("snapshots") or [])),
                tuple(j.get("snapshot-log") or []), tuple(j.get("metadata-log") or []), tuple(map(SortOrder.from_json, j["sort-orders"])),
                j["default-sort-order-id"], {k: Ref.from_json(r) for k, r in (j.get("refs") or {}).items()}, VERSION,
                {k: v for k, v in j.items() if k not in known},
            )
        except (KeyError, TypeError, AttributeError) as e:
            raise InvalidMetadata(f"not table metadata: {e!r}") from e

    def encode(self) -> str:
        try:
            return json.dumps(self.to_json(), indent=2)
        except (TypeError, ValueError) as e:
            raise SerializeMetadataJson(str(e)) from e

    @classmethod
    def decode(cls, text: str | bytes) -> TableMetadata:
        try:
            j = json.loads(text)
        except ValueError as e:
            raise InvalidMetadata(f"not JSON: {e}") from e
        return cls.from_json(j)
