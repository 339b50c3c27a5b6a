"""Rows to data files: partitioned Parquet writing in tasks, one open file at a time."""

from __future__ import annotations

import datetime as dt
import json
import random
import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArrowError, SchemaError
from ..model import values
from ..model.manifests import DataFile
from ..model.metadata import SortOrder
from ..model.partitioning import PartitionSpec
from ..model.types import Field, ListType, MapType, Primitive, Schema, StructType, Type
from ..sources.storage import data_path, open_uri

#: Rows of a data file and of a row group at most.
FILE_ROWS, GROUP_ROWS = 5_000_000, 262_144
#: How data files are encoded unless the caller says otherwise.
PLAIN = {"compression": "NONE", "use_dictionary": False}
_RESULT = "path string, rows long, bytes long, partition string, sizes map<int,long>, counts map<int,long>, nulls map<int,long>, low map<int,binary>, high map<int,binary>"


def operation_id() -> str:
    return "".join(random.choices(string.ascii_letters + string.digits, k=8))


def arrow_type(t: Type) -> pa.DataType:
    if isinstance(t, StructType):
        return pa.struct([arrow_field(f) for f in t.fields])
    if isinstance(t, ListType):
        return pa.list_(arrow_field(Field(t.element_id, "element", t.element_required, t.element)))
    if isinstance(t, MapType):
        return pa.map_(arrow_field(Field(t.key_id, "key", True, t.key)), arrow_field(Field(t.value_id, "value", t.value_required, t.value)))
    plain = {
        "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "date": pa.date32(),
        "time": pa.time64("us"), "timestamp": pa.timestamp("us"), "timestamptz": pa.timestamp("us", "UTC"), "string": pa.string(),
        "uuid": pa.binary(16), "binary": pa.binary(),
    }
    if t.name == "decimal":
        return pa.decimal128(t.precision, t.scale)
    return pa.binary(t.length) if t.name == "fixed" else plain[t.name]


def arrow_field(f: Field) -> pa.Field:
    return pa.field(f.name, arrow_type(f.type), not f.required, {"PARQUET:field_id": str(f.id)})


def arrow_schema(schema: Schema) -> pa.Schema:
    """The schema of data files, with field ids at every level."""
    return pa.schema([arrow_field(f) for f in schema.fields])


def statistics(meta: pq.FileMetaData, schema: Schema) -> dict:
    """From a file's footer, for top-level primitive fields by id: bytes, values, nulls, least and greatest value."""
    out: dict = {"sizes": {}, "counts": {}, "nulls": {}, "low": {}, "high": {}}
    place = {meta.schema.column(i).path: i for i in range(len(meta.schema))}
    for f in schema.fields:
        i = place.get(f.name)
        if i is None or not isinstance(f.type, Primitive):
            continue
        chunks = [meta.row_group(g).column(i) for g in range(meta.num_row_groups)]
        out["sizes"][f.id] = sum(c.total_compressed_size for c in chunks)
        out["counts"][f.id] = sum(c.num_values for c in chunks)
        stats = [c.statistics for c in chunks]
        if any(s is None or not s.has_null_count for s in stats):
            continue
        out["nulls"][f.id] = sum(s.null_count for s in stats)
        known = [s for s in stats if s.has_min_max]
        if known and len(known) == sum(s.null_count < s.num_values + s.null_count for s in stats):
            low, high = min(s.min for s in known), max(s.max for s in known)
            if f.type.name not in ("decimal", "uuid", "fixed") and low == low and high == high:
                out["low"][f.id], out["high"][f.id] = values.to_bytes(low, f.type), values.to_bytes(high, f.type)
    return out


def conform(df: DataFrame, schema: Schema) -> DataFrame:
    """df's columns in the table's order and types; raises where they are not the table's, or, in tasks, for null in a required one."""
    names = [f.name for f in schema.fields]
    missing, extra = [f.name for f in schema.fields if f.name not in df.columns and f.required], set(df.columns) - set(names)
    if missing or extra:
        raise SchemaError(f"columns don't match the table's: missing {missing}, unknown {sorted(extra)}")
    out = []
    for f in schema.fields:
        want = f.type.to_spark()
        if f.name not in df.columns:
            out.append(F.lit(None).cast(want).alias(f.name))
            continue
        c, have = F.col(f"`{f.name}`"), df.schema[f.name].dataType
        if have != want:
            _check_widening(have, want, f.name)
            c = c.cast(want)
        if f.required:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"null in required field {f.name}"))).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _check_widening(have: T.DataType, want: T.DataType, name: str) -> None:
    ranks = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    both = [next((i for i, t in enumerate(ranks) if isinstance(x, t)), None) for x in (have, want)]
    if None not in both and both[0] <= both[1]:
        return
    if isinstance(have, T.FloatType) and isinstance(want, T.DoubleType):
        return
    if isinstance(have, T.DecimalType) and isinstance(want, T.DecimalType) and have.scale == want.scale and have.precision <= want.precision:
        return
    if isinstance(have, (T.ArrayType, T.MapType, T.StructType)) and have.typeName() == want.typeName():
        return  # nullability of what is inside
    raise SchemaError(f"column {name} is {have.simpleString()}; the table has {want.simpleString()}")


def write_rows(
    df: DataFrame, location: str, schema: Schema, spec: PartitionSpec, sort_order: SortOrder | None = None,
    options: dict | None = None, file_rows: int = FILE_ROWS,
) -> list[DataFile]:
    """Write the rows as data files under the table's location; nothing is committed.

    Rows are rebalanced by partition tuple and sorted by it, so a task has one open file at a time and each tuple goes to
    one task, or to several where it is large (AQE splits large parts of a rebalance, and joins small ones); a file ends
    with the tuple or after ``file_rows``. Files have names of their own, so failed and repeated tasks leave files that
    nothing refers to. Partition values are taken in UTC, whatever the session's time zone, which is as before afterwards.
    """
    conf = df.sparkSession.conf
    zone = conf.get("spark.sql.session.timeZone")
    conf.set("spark.sql.session.timeZone", "UTC")
    try:
        return _write_rows(df, location, schema, spec, sort_order, options, file_rows)
    finally:
        conf.set("spark.sql.session.timeZone", zone)


def _write_rows(
    df: DataFrame, location: str, schema: Schema, spec: PartitionSpec, sort_order: SortOrder | None, options: dict | None, file_rows: int
) -> list[DataFile]:
    rows = conform(df, schema)
    parts = spec.columns(schema)
    keys = [f"__p{i}" for i in range(len(parts))]
    order = _order(sort_order, schema)
    if parts:
        rows = rows.select("*", *[c.alias(k) for k, c in zip(keys, parts, strict=True)])
        rows = rows.hint("rebalance", *[F.col(k) for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], *order)
    elif order:
        rows = rows.sortWithinPartitions(*order)
    names, stamp, op = [f.name for f in spec.fields], dt.datetime.now(dt.UTC).strftime("%Y%m%d_%H%M%S"), operation_id()
    kinds = list(spec.as_struct_type(schema).fields)
    target, how = arrow_schema(schema), PLAIN | (options or {})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = uri = current = None
        held: list[pa.RecordBatch] = []
        done, n, pending = [], 0, 0

        def flush() -> None:
            nonlocal pending
            if held:
                out.write_table(pa.Table.from_batches(held))
                held.clear()
                pending = 0

        def close() -> None:
            nonlocal out, n
            flush()
            out.close()
            fs, path = open_uri(uri)
            meta = pq.read_metadata(path, filesystem=fs)
            stats = statistics(meta, schema)
            done.append({"path": uri, "rows": meta.num_rows, "bytes": fs.get_file_info(path).size, "partition": json.dumps([values.to_json(v, f.type) for v, f in zip(current, kinds, strict=True)]), **stats})
            out, n = None, 0

        for batch in batches:
            k = len(target)
            tuples = batch.columns[k:]
            body = _cast(batch, target)
            edges = [0]
            if tuples and batch.num_rows:
                marks = [t.to_pylist() for t in tuples]
                edges += [i for i in range(1, batch.num_rows) if any(m[i] != m[i - 1] for m in marks)]
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if a == b:
                    continue
                own = tuple(t[a].as_py() for t in tuples)
                while a < b:
                    if out is not None and (own != current or n >= file_rows):
                        close()
                    if out is None:
                        current = own
                        name = f"{stamp}_{len(done):05x}_{op}-{uuid.uuid4()}.parquet"
                        uri = f"{location}/{data_path(name, spec.path(dict(zip(names, own, strict=True)), schema))}"
                        fs, path = open_uri(uri)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = pq.ParquetWriter(path, target, filesystem=fs, **how)
                    step = min(b - a, file_rows - n)
                    held.append(body.slice(a, step))
                    a, n, pending = a + step, n + step, pending + step
                    if pending >= GROUP_ROWS:
                        flush()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([_as_maps(d) for d in done], schema=_ARROW_RESULT)

    got = rows.mapInArrow(write, _RESULT).collect()
    files = []
    for r in got:
        tuple_ = {f.name: values.from_json(j, f.type) for f, j in zip(kinds, json.loads(r["partition"]), strict=True)}
        files.append(DataFile(
            r["path"], r["rows"], r["bytes"], tuple_, column_sizes=dict(r["sizes"]), value_counts=dict(r["counts"]), null_value_counts=dict(r["nulls"]),
            lower_bounds={k: bytes(v) for k, v in r["low"].items()}, upper_bounds={k: bytes(v) for k, v in r["high"].items()},
            sort_order_id=sort_order.order_id if order else None,
        ))
    return sorted(files, key=lambda f: f.file_path)


_ARROW_RESULT = pa.schema([
    ("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()), ("partition", pa.string()),
    *[(k, pa.map_(pa.int32(), pa.int64())) for k in ("sizes", "counts", "nulls")], *[(k, pa.map_(pa.int32(), pa.binary())) for k in ("low", "high")],
])


def _as_maps(d: dict) -> dict:
    return {k: list(v.items()) if isinstance(v, dict) else v for k, v in d.items()}


def _cast(batch: pa.RecordBatch, target: pa.Schema) -> pa.RecordBatch:
    try:
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, target, strict=False)], schema=target)
    except pa.ArrowInvalid as e:
        raise ArrowError(f"rows don't fit the table's schema: {e}") from e


def _order(order: SortOrder | None, schema: Schema) -> list:
    out = []
    by_id = schema.all_fields_by_id()
    for f in order.fields if order else ():
        c = F.col(f"`{by_id[f.source_id].name}`")
        if f.direction == "asc":
            out.append(c.asc_nulls_first() if f.null_order == "nulls-first" else c.asc_nulls_last())
        else:
            out.append(c.desc_nulls_first() if f.null_order == "nulls-first" else c.desc_nulls_last())
    return out
