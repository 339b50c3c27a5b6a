"""Tables: opening and creating them, what they consist of as DataFrames, and scans of their rows."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MetadataNotFound, SchemaError, TableAlreadyExists, TableNotInitialized, Unsupported
from ..model import values
from ..model.manifests import DataFile, Entry, FileContent, ManifestFile, ManifestReader, Status, decode_manifest_list, partition_json
from ..model.metadata import Snapshot, SortOrder, TableMetadata
from ..model.partitioning import PartitionSpec
from ..model.types import Field, Primitive, Schema
from ..operators.append import write_rows
from ..operators.transaction import AppendFiles, OverwriteFiles, Transaction, version_path
from .storage import Storage, open_uri

_METADATA = re.compile(r"metadata/(\d+)-[0-9a-f-]{36}\.metadata\.json")
#: A condition of a scan: column, one of = < <= > >= in is-null not-null, and a value (or values, or None).
Condition = tuple[str, str, Any]
OPERATORS: dict[str, Callable] = {
    "=": lambda c, v: c == v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)), "is-null": lambda c, v: c.isNull(), "not-null": lambda c, v: c.isNotNull(),
}
_SCALARS = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType()}


def _columns(kind: str, names: str) -> list[T.StructField]:
    return [T.StructField(n, _SCALARS[kind]) for n in names.split()]


def _by_field(value: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, T.MapType(T.IntegerType(), value)) for n in names.split()]


ENTRIES = T.StructType([
    *_columns("int", "status"), *_columns("long", "snapshot_id sequence_number file_sequence_number"), *_columns("int", "spec_id content"),
    *_columns("string", "file_path file_format partition"), *_columns("long", "record_count file_size_in_bytes"),
    *_by_field(T.LongType(), "column_sizes value_counts null_value_counts"), *_by_field(T.BinaryType(), "lower_bounds upper_bounds"), *_columns("int", "sort_order_id"),
])
MANIFESTS = T.StructType([
    *_columns("string", "manifest_path"), *_columns("long", "manifest_length"), *_columns("int", "partition_spec_id content"),
    *_columns("long", "sequence_number min_sequence_number added_snapshot_id"), *_columns("int", "added_files existing_files deleted_files"),
    *_columns("long", "added_rows existing_rows deleted_rows"),
])
#: Manifests that the driver reads itself; more are read by tasks.
ON_DRIVER = 64


def _entry_row(e: Entry, spec_id: int) -> tuple:
    f = e.data_file
    return (
        int(e.status), e.snapshot_id, e.sequence_number, e.file_sequence_number, spec_id, int(f.content), f.file_path, f.file_format, partition_json(f.partition),
        f.record_count, f.file_size_in_bytes, f.column_sizes, f.value_counts, f.null_value_counts, f.lower_bounds, f.upper_bounds, f.sort_order_id,
    )


class Table:
    """A table at a location. One without metadata (not created yet) has a location and storage only."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.storage = spark, Storage(spark, url)
        self._metadata: TableMetadata | None = None
        self.version, self._path = -1, ""

    @property
    def location(self) -> str:
        return self.storage.location

    @property
    def metadata(self) -> TableMetadata:
        if self._metadata is None:
            raise TableNotInitialized(f"no table was loaded from {self.location}")
        return self._metadata

    @property
    def metadata_uri(self) -> str:
        if not self._path:
            raise TableNotInitialized(f"no table was loaded from {self.location}")
        return self.storage.to_uri(self._path)

    def set_state(self, metadata: TableMetadata, version: int, path: str) -> None:
        self._metadata, self.version, self._path = metadata, version, path

    # Opening

    def _versions(self) -> list[tuple[int, str]]:
        found = ((_METADATA.fullmatch(m.location), m.location) for m in self.storage.list("metadata"))
        return [(int(m[1]), path) for m, path in found if m]

    def latest_version(self) -> int:
        return max((v for v, _ in self._versions()), default=-1)

    def detect(self) -> bool:
        """Whether there is a table; failures of the storage are raised, not taken for absence."""
        return bool(self._versions())

    def refresh(self) -> None:
        """Load the newest version: the greatest number, of equals the last updated."""
        found = self._versions()
        if not found:
            raise MetadataNotFound(f"no table at {self.location}")
        top = max(v for v, _ in found)
        best = [(TableMetadata.decode(self.storage.get(p)), p) for v, p in found if v == top]
        metadata, path = max(best, key=lambda x: x[0].last_updated_ms)
        self.set_state(metadata, top, path)

    def create(self, schema: Schema, spec: PartitionSpec, properties: dict | None, sort_order: SortOrder | None) -> None:
        if self.detect():
            raise TableAlreadyExists(f"there is a table at {self.location}")
        metadata = TableMetadata.new(self.location, schema, spec, properties, sort_order)
        path = version_path(self.location, 0)
        if not self.storage.put(path, metadata.encode().encode(), exclusive=True):
            raise TableAlreadyExists(f"there is a table at {self.location}")
        self.set_state(metadata, 0, path)

    # State

    def current_schema(self) -> Schema:
        return self.metadata.current_schema()

    def current_partition_spec(self) -> PartitionSpec:
        return self.metadata.current_spec()

    def current_snapshot(self) -> Snapshot | None:
        return self.metadata.current_snapshot()

    def read_manifest_list(self, snapshot: Snapshot) -> list[ManifestFile]:
        return decode_manifest_list(self.storage.get_uri(snapshot.manifest_list))

    def _at(self, snapshot_id: int | None) -> Snapshot | None:
        return self.metadata.current_snapshot() if snapshot_id is None else self.metadata.snapshot(snapshot_id)

    def read_entries(self, snapshot_id: int | None = None) -> list[tuple[Entry, int]]:
        """All entries of a snapshot with their partition specs' ids, deleted ones too."""
        snapshot = self._at(snapshot_id)
        if snapshot is None:
            return []
        listed = self.read_manifest_list(snapshot)
        with ThreadPoolExecutor(8) as pool:
            read = pool.map(lambda m: ManifestReader.for_manifest_file(m).read(self.storage.get_uri(m.manifest_path)), listed)
            return [(e, m.spec.spec_id) for m in read for e in m.entries]

    def _live(self, snapshot_id: int | None) -> list[tuple[Entry, int]]:
        return [(e, spec) for e, spec in self.read_entries(snapshot_id) if e.status != Status.DELETED]

    def live_files(self, snapshot_id: int | None = None) -> list[tuple[DataFile, int]]:
        """The live data files; delete files are not among them."""
        return [(e.data_file, spec) for e, spec in self._live(snapshot_id) if e.data_file.content == FileContent.DATA]

    def live_deletes(self, snapshot_id: int | None = None) -> list[tuple[Entry, int]]:
        """The live delete files' entries."""
        return [(e, spec) for e, spec in self._live(snapshot_id) if e.data_file.content != FileContent.DATA]

    # Metadata as DataFrames

    def entries(self, snapshot_id: int | None = None) -> DataFrame:
        """A row for each manifest entry. Of many manifests, tasks read them, one at a time."""
        snapshot = self._at(snapshot_id)
        listed = self.read_manifest_list(snapshot) if snapshot else []
        if len(listed) <= ON_DRIVER or not self.storage.local:
            return self.spark.createDataFrame([_entry_row(e, spec) for e, spec in self.read_entries(snapshot_id)], ENTRIES)
        found = [(self.storage.relative(m.manifest_path), m.sequence_number, m.added_snapshot_id) for m in listed]
        root = str(self.storage.local)

        def read(batches):
            for pdf in batches:
                for path, sequence, owner in pdf.itertuples(index=False, name=None):
                    with open(os.path.join(root, path), "rb") as f:
                        m = ManifestReader(sequence, owner).read(f.read())
                    import pandas as pd

                    yield pd.DataFrame([_entry_row(e, m.spec.spec_id) for e in m.entries], columns=ENTRIES.names)

        spread = self.spark.createDataFrame(found, "path string, sequence long, owner long").repartition(min(len(found), 64))
        return spread.mapInPandas(read, ENTRIES)

    def files(self, snapshot_id: int | None = None) -> DataFrame:
        """A row for each live file; content tells data files (0) from delete files."""
        return self.entries(snapshot_id).filter(F.col("status") != int(Status.DELETED))

    def manifests(self, snapshot_id: int | None = None) -> DataFrame:
        snapshot = self._at(snapshot_id)
        rows = [tuple(getattr(m, n) for n in MANIFESTS.names) for m in (self.read_manifest_list(snapshot) if snapshot else [])]
        return self.spark.createDataFrame(rows, MANIFESTS)

    def snapshots(self) -> DataFrame:
        rows = [(s.sequence_number, s.snapshot_id, s.parent_snapshot_id, s.timestamp_ms, s.summary.operation, s.summary.stats, s.schema_id) for s in self.metadata.snapshots]
        return self.spark.createDataFrame(rows, "sequence_number long, snapshot_id long, parent_id long, timestamp_ms long, operation string, summary map<string,string>, schema_id int")

    def history(self) -> DataFrame:
        """The snapshot log, each entry with the snapshot before it in the log."""
        rows = [(i, e["snapshot-id"], e["timestamp-ms"]) for i, e in enumerate(self.metadata.snapshot_log)]
        before = [None, *[r[1] for r in rows[:-1]]]
        return self.spark.createDataFrame([(*r, b) for r, b in zip(rows, before, strict=True)], "position int, snapshot_id long, timestamp_ms long, previous_id long")

    # Scans

    def scan(self, snapshot_id: int | None = None, where: Iterable[Condition] = ()) -> DataFrame:
        """The rows of a snapshot under the current schema (of an older snapshot: the schema it was written with).

        Columns are found by field id, so renamed ones keep their rows, added ones are null and widened ones are widened;
        files without ids are read by name. Files that the conditions rule out by partition or bounds are not read; the
        conditions are then applied to the rows, which Spark pushes down to the files' row groups.
        """
        snapshot = self._at(snapshot_id)
        schema = self.current_schema()
        if snapshot_id is not None and snapshot.schema_id is not None:
            schema = self.metadata.schema(snapshot.schema_id)
        return self._rows(self._planned(snapshot_id, where), self.live_deletes(snapshot_id), schema, where)

    def scan_files(self, files: list[DataFile], schema: Schema, where: Iterable[Condition] = ()) -> DataFrame:
        """The rows of these data files, whatever delete files say."""
        return self._filtered(self._read(files, schema), where)

    @staticmethod
    def _filtered(rows: DataFrame, where: Iterable[Condition]) -> DataFrame:
        for name, op, value in where:
            rows = rows.filter(OPERATORS[op](F.col(name), value))
        return rows

    def _rows(self, planned: list[tuple[Entry, int]], deletes: list[tuple[Entry, int]], schema: Schema, where: Iterable[Condition]) -> DataFrame:
        """The rows of data files without those that the delete files name.

        A position delete applies to data files of its partition that are no newer than it, an equality delete to those
        that are older; in an unpartitioned spec an equality delete applies to all older files. Data files to which the
        same delete files apply are read together.
        """
        groups: dict[tuple, tuple[list[DataFile], list[DataFile]]] = {}
        for e, spec in planned:
            own = [d for d, of in deletes if self._applies(d, of, e, spec)]
            key = tuple(sorted(d.data_file.file_path for d in own))
            groups.setdefault(key, ([], [d.data_file for d in own]))[0].append(e.data_file)
        parts = [self._filtered(self._without(files, own, schema) if own else self._read(files, schema), where) for files, own in groups.values()]
        out = parts[0] if parts else self._filtered(self._read([], schema), where)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _applies(self, delete: Entry, delete_spec: int, data: Entry, spec: int) -> bool:
        d, f = delete.data_file, data.data_file
        equality = d.content == FileContent.EQUALITY_DELETES
        if (delete.sequence_number or 0) < (data.sequence_number or 0) + equality:
            return False
        if equality and next(s for s in self.metadata.partition_specs if s.spec_id == delete_spec).is_empty():
            return True
        return delete_spec == spec and d.partition == f.partition

    def _without(self, files: list[DataFile], deletes: list[DataFile], schema: Schema) -> DataFrame:
        taken = {f.name.lower() for f in schema.fields}
        path, place = (next(c for n in range(len(taken) + 1) if (c := f"{stem}{n or ''}") not in taken) for stem in ("_path", "_place"))
        rows = self._read(files, schema, path, place)
        at = [d for d in deletes if d.content == FileContent.POSITION_DELETES]
        if at:
            gone = self._read(at, _POSITIONS).select(plain_path(F.col("file_path")).alias(path), F.col("pos").alias(place)).distinct()
            rows = rows.join(gone, [path, place], "left_anti")
        rows = rows.drop(path, place)
        by_keys: dict[tuple, list[DataFile]] = {}
        for d in deletes:
            if d.content == FileContent.EQUALITY_DELETES:
                by_keys.setdefault(tuple(sorted(d.equality_ids or ())), []).append(d)
        top = {f.id: f for f in schema.fields}
        for ids, own in by_keys.items():
            if not ids or any(i not in top for i in ids):
                raise Unsupported(f"an equality delete by fields {ids}, which are not all columns of the schema")
            keys = self._read(own, Schema(0, tuple(top[i] for i in ids))).distinct()
            mine = {top[i].name: f"{path}{i}" for i in ids}
            keys = keys.withColumnsRenamed(mine)
            same = [F.col(f"`{name}`").eqNullSafe(F.col(f"`{theirs}`")) for name, theirs in mine.items()]
            rows = rows.join(keys, same, "left_anti")
        return rows

    def _read(self, files: list[DataFile], schema: Schema, path: str = "", place: str = "") -> DataFrame:
        """Rows of files of any readable format; with ``path`` and ``place``, columns of these names that tell where each is from.

        Parquet files are read by field id, where they have ids; for that a session setting is turned on, which matters
        to reads with a schema of ids alone. ORC files are read by name.
        """
        self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        struct = schema.to_spark()
        nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in struct])
        plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in struct])
        by_format: dict[str, list[DataFile]] = {}
        for f in files:
            by_format.setdefault(f.file_format.upper(), []).append(f)
        parts = []
        for kind, own in by_format.items():
            if kind == "PARQUET":
                with_ids, without = self._by_ids(own)
                parts += [self.spark.read.schema(s).parquet(*paths) for s, paths in ((nullable, with_ids), (plain, without)) if paths]
            elif kind == "ORC" and not place:
                parts.append(self.spark.read.schema(plain).orc([f.file_path for f in own]))
            else:
                raise Unsupported(f"data files of format {kind}" + " with position deletes" * bool(place))
        if place:
            parts = [p.select("*", plain_path(F.col("_metadata.file_path"), True).alias(path), F.col("_metadata.row_index").alias(place)) for p in parts]
        out = parts[0] if parts else self.spark.createDataFrame([], nullable)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _by_ids(self, files: list[DataFile]) -> tuple[list[str], list[str]]:
        """Paths of files with field ids and without. Those written here have column sizes and ids; others' footers tell."""
        known = [f.file_path for f in files if f.column_sizes]

        def has_ids(path: str) -> bool:
            fs, p = open_uri(path)
            names = pq.read_schema(p, filesystem=fs)
            return any(b"PARQUET:field_id" in (f.metadata or {}) for f in names)

        other = [f.file_path for f in files if not f.column_sizes]
        with ThreadPoolExecutor(16) as pool:
            flags = list(pool.map(has_ids, other))
        return known + [p for p, x in zip(other, flags, strict=True) if x], [p for p, x in zip(other, flags, strict=True) if not x]

    def plan(self, snapshot_id: int | None = None, where: Iterable[Condition] = ()) -> list[tuple[DataFile, int]]:
        """The live data files that may hold rows that meet all conditions."""
        return [(e.data_file, spec) for e, spec in self._planned(snapshot_id, where)]

    def _planned(self, snapshot_id: int | None, where: Iterable[Condition]) -> list[tuple[Entry, int]]:
        live = [(e, spec) for e, spec in self._live(snapshot_id) if e.data_file.content == FileContent.DATA]
        conditions = list(where)
        if not conditions:
            return live
        specs = {s.spec_id: s.bind(self.metadata.schema_for_spec(s)) for s in self.metadata.partition_specs}
        by_name = {f.name: f for f in self.current_schema().fields}
        for name, op, _ in conditions:
            if name.split(".")[0] not in by_name or op not in OPERATORS:
                raise SchemaError(f"no column {name} or no condition {op}")
        return [(e, spec) for e, spec in live if all(_may_hold(e.data_file, specs[spec], by_name, c) for c in conditions)]

    # Changes

    def new_transaction(self) -> Transaction:
        return Transaction(self)

    def write(self, df: DataFrame, **how) -> list[DataFile]:
        """Data files of df's rows, not committed."""
        return write_rows(df, self.location, self.current_schema(), self.current_partition_spec(), self.metadata.sort_order(), **how)

    def append(self, df: DataFrame, properties: dict[str, str] | None = None, **how) -> None:
        self.new_transaction().add_operation(AppendFiles(self.write(df, **how), properties or {})).commit()

    def overwrite(self, df: DataFrame, **how) -> None:
        """Replace all rows."""
        self.new_transaction().add_operation(OverwriteFiles(self.write(df, **how), everything=True)).commit()

    def add_files(self, files: list[DataFile]) -> None:
        """Register files that exist already, wherever they are."""
        self.new_transaction().append_files(files).commit()


#: Columns of position delete files (fixed values of the table format).
_POSITIONS = Schema(0, (Field(2147483546, "file_path", False, Primitive("string")), Field(2147483545, "pos", False, Primitive("long"))))


def plain_path(c: Column, encoded: bool = False) -> Column:
    """A file's URI in one form; Spark's own are percent-encoded."""
    if encoded:
        c = F.url_decode(F.regexp_replace(c, r"\+", "%2B"))
    c = F.when(c.startswith("/"), F.concat(F.lit("file:"), c)).otherwise(c)
    return F.regexp_replace(c, "^file:/+", "file:///")


def _may_hold(f: DataFile, bound: list, by_name: dict, condition: Condition) -> bool:
    name, op, value = condition
    field = by_name.get(name)
    if field is None or not isinstance(field.type, Primitive):
        return True
    for p, _, source in bound:
        if p.source_id != field.id or p.transform.name == "void":
            continue
        own = f.partition.get(p.name)
        if op in ("is-null", "not-null"):
            if (own is None) != (op == "is-null"):
                return False
            continue
        if own is None:
            return False
        of = lambda v, p=p, source=source: p.transform.apply(v, source)
        if p.transform.name == "bucket" and op not in ("=", "in"):
            continue
        low, high = (own, own)
        if p.transform.name == "identity":
            ok = _range_meets(low, high, op, value)
        else:
            # The transforms keep order, if not strictly: compare transformed values, never excluding equals.
            loose = {"<": "<=", ">": ">="}.get(op, op)
            ok = _range_meets(low, high, loose, [of(v) for v in value] if op == "in" else of(value))
        if not ok:
            return False
    nulls, n = (f.null_value_counts or {}).get(field.id), (f.value_counts or {}).get(field.id)
    if nulls is not None and op == "is-null":
        return nulls > 0
    if nulls is not None and nulls == n:
        return False
    low, high = ((b or {}).get(field.id) for b in (f.lower_bounds, f.upper_bounds))
    if low is None or high is None or op in ("is-null", "not-null"):
        return True
    return _range_meets(values.from_bytes(low, field.type), values.from_bytes(high, field.type), op, value)


def _range_meets(low: Any, high: Any, op: str, value: Any) -> bool:
    if op == "in":
        return any(low <= v <= high for v in value)
    return {"=": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[op] if op in ("=", "<", "<=", ">", ">=") else True


class TableLoader:
    """Opens or creates a table at a location."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.url = spark, url
        self.schema: Schema | None = None
        self.spec: PartitionSpec | None = None
        self.order: SortOrder | None = None
        self.properties: dict = {}
        self.options: dict = {}

    def with_schema(self, schema: Schema) -> TableLoader:
        self.schema = schema
        return self

    def with_partition_spec(self, spec: PartitionSpec) -> TableLoader:
        self.spec = spec
        return self

    def with_sort_order(self, order: SortOrder) -> TableLoader:
        self.order = order
        return self

    def with_properties(self, properties: dict[str, str]) -> TableLoader:
        self.properties |= properties
        return self

    def with_storage_options(self, options: dict[str, str]) -> TableLoader:
        """Hadoop settings of the storage."""
        self.options |= options
        return self

    def with_env_options(self) -> TableLoader:
        """Credentials and region from the environment's usual variables."""
        names = {"AWS_ACCESS_KEY_ID": "fs.s3a.access.key", "AWS_SECRET_ACCESS_KEY": "fs.s3a.secret.key", "AWS_DEFAULT_REGION": "fs.s3a.endpoint.region"}
        return self.with_storage_options({ours: os.environ[theirs] for theirs, ours in names.items() if theirs in os.environ})

    def _table(self) -> Table:
        conf = self.spark._jsc.hadoopConfiguration()
        for k, v in self.options.items():
            conf.set(k, v)
        return Table(self.spark, self.url)

    def load(self) -> Table:
        table = self._table()
        table.refresh()
        return table

    def create(self) -> Table:
        if self.schema is None:
            raise SchemaError("a new table needs a schema")
        table = self._table()
        table.create(self.schema, self.spec or PartitionSpec.unpartitioned(), self.properties, self.order)
        return table

    def load_or_create(self) -> Table:
        try:
            return self.load()
        except MetadataNotFound:
            return self.create()


def table_like(spark: SparkSession, url: str, df: DataFrame, partition: Callable | None = None, **properties: str) -> Table:
    """A new table with df's columns, partitioned by what ``partition`` does with a spec builder; no rows."""
    schema = Schema.from_spark(df.schema)
    schema = replace(schema, fields=tuple(replace(f, required=False) for f in schema.fields))
    spec = partition(PartitionSpec.builder(0, schema)).build() if partition else PartitionSpec.unpartitioned()
    return TableLoader(spark, url).with_schema(schema).with_partition_spec(spec).with_properties(properties).create()
