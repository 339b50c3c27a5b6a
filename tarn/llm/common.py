"""What the operators of this subpackage share: the shared folder, lineage cuts, word rules, fixed-size bitmaps."""

from __future__ import annotations

import contextlib
import math
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
#: bytes.split() without an argument splits at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Folders made for sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share.

    Where the session names no such folder, one is made, in local mode (as in tests) only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
        base = _LOCAL[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; the session's setting is then as it was."""
    before = spark.conf.get(SWEPT, "false")
    spark.conf.set(SWEPT, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEPT, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later stages then need none of its lineage or shuffles."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["cut_path"] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once everything made of them is itself written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["cut_path"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession, size: str = "8m") -> None:
    """For an application's start: Arrow batches that go to Python hold ``size`` bytes, unless the session says otherwise.

    Operators work with any setting; Spark's own, 64 MB, takes that much in each of an executor's JVM and workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, size)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches (of 64 MB at most, by Spark's own setting) in slices whose Python objects are few at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def worker_cache() -> dict:
    """What a Python worker keeps from task to task. (Functions come to it by value, each time with globals of their own.)"""
    return sys.modules.setdefault("_tarn_worker_cache", types.ModuleType("_tarn_worker_cache")).__dict__


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under this library's own names: whatever else df holds can't clash."""
    return df.select(*[column(theirs).alias(ours) for ours, theirs in columns.items()])


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for null; one pass of the regular expression, no array of words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marks, GAP, "")).cast("long")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that begin with these and that df does not have."""
    taken = {c.lower() for c in df.columns}
    return [next(c for n in range(len(taken) + 1) if (c := f"{stem}{n or ''}").lower() not in taken) for stem in stems]


def column(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bits of a membership bitmap: about 16 for each key, in these bounds; so that the broadcast (a long and an int a word
#: of 64 bits) never exceeds some 20 MB. With more keys than bits it lets more rows through, never fewer: what is left to
#: do is then a plain join by shuffle.
BITMAP_BITS = (1 << 16, 1 << 25)


def parted(df: DataFrame, key: str, keys: DataFrame, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be in keys (one column) - all that are, and few others - and the rest, unshuffled.

    keys, a written table, is folded into a bitmap, which is what gets broadcast. All columns of df stay, whatever their
    names.
    """
    if bits is None:
        bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (16 * keys.count()).bit_length()))
    bit, word, found, flag = fresh(df, "_bit", "_word", "_found", "_flag")
    place = F.pmod(F.xxhash64(column(keys.columns[0])), F.lit(bits))
    words = (
        keys.select(place.alias("b"))
        .groupBy(F.expr("b div 64").alias(word))
        .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias(found))
    )
    probed = df.withColumn(bit, F.pmod(F.xxhash64(column(key)), F.lit(bits))).withColumn(word, F.expr(f"{bit} div 64"))
    maybe = F.expr(f"coalesce(shiftrightunsigned({found}, cast({bit} % 64 as int)) & 1L = 1L, false)")
    probed = probed.join(F.broadcast(words), word, "left").withColumn(flag, maybe)
    rows = [column(c) for c in df.columns]
    return probed.filter(flag).select(*rows), probed.filter(f"not {flag}").select(*rows)


def maybe_in(df: DataFrame, key: str, keys: DataFrame, bits: int | None = None) -> DataFrame:
    """The rows of df whose key may be in keys: all that are, and few others."""
    return parted(df, key, keys, bits)[0]


def without(docs: DataFrame, key: str, dropped: DataFrame, kept: DataFrame) -> DataFrame:
    """docs without the rows whose key is in dropped and not in kept (one column each, written tables); all columns stay.

    Only rows whose key may be in dropped are shuffled.
    """
    maybe, rest = parted(docs, key, dropped)
    (mine,) = fresh(docs, "_kept")
    again = kept.select(column(kept.columns[0]).alias(mine)).distinct()
    return rest.unionByName(maybe.join(again, column(key).eqNullSafe(F.col(mine)), "left_semi"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that nothing is learned from; a null id: no."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Classes whose counts may be broadcast (at most a few MB); beyond, they are joined by shuffle.
FEW_CLASSES = 10_000


def sample_by_class(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each class, those whose key's hash is lowest; the same ones at every run.

    A first filter by hash leaves about 4 * most rows a class, so that the ranking sees few rows of a large class.
    """
    spark = rows.sparkSession
    counts = cut(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(label, "_label"), "classes")
    few = spark.createDataFrame(counts.take(FEW_CLASSES), counts.schema) if counts.count() <= FEW_CLASSES else None
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(key)), 33)
    near = rows.withColumn("_spot", spot).join(counts if few is None else F.broadcast(few), F.col(label) == F.col("_label"))
    near = near.filter(F.col("_spot") * F.col("_n") <= F.lit(float(1 << 31)) * (4.0 * most))
    nth = F.row_number().over(Window.partitionBy(label).orderBy("_spot", key))
    return near.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_spot", "_n", "_label", "_nth")


def range_splits(df: DataFrame, key: str, n: int) -> list:
    """n - 1 keys at about equal ranks (numbers; nulls don't count). Reads the key alone."""
    if n < 2:
        return []
    got = df.select(F.col(key).alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 1 / (20 * n))
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    return sorted({int(x) if whole else x for x in got})


def range_of(key: Column, splits: list) -> Column:
    """The number of the range that a key is in: how many splits are below it; 0 for null.

    Found in two steps of about the square root of the splits each.
    """
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    heads = F.array(*[F.lit(x) for x in splits[::step]])
    everything = F.array(*[F.lit(x) for x in splits])
    coarse = F.greatest(F.size(F.filter(heads, lambda x: x < key)) - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.slice(everything, coarse + 1, step), lambda x: x < key))
    return F.coalesce(coarse + fine, F.lit(0)).cast("int")


def in_ranges(df: DataFrame, key: str, n: int, *then: str) -> DataFrame:
    """df in at most n partitions, of rising key (null first), each sorted by key and what follows.

    Unlike repartitionByRange, which samples what it deals out, this never computes df twice.
    """
    splits = range_splits(df, key, n)
    at = df.withColumn("_range", range_of(F.col(key), splits))
    return at.repartitionById(len(splits) + 1, F.col("_range")).sortWithinPartitions(F.col(key).asc_nulls_first(), *then).drop("_range")
