"""Exact dedup by skew-safe combining, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, column, cut, fresh, keyed, parted

SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Which rows stay when texts that are equal up to runs of white space are kept once.

    Three stages, each of which compares whole normalised texts, not digests alone:

    1. every task combines the equal texts that it reads (the partial side of the first aggregation);
    2. what is left meets in groups of (digest, salt, text), the salt being the task's number modulo ``salts``, so
       that even a text which is a third of all rows comes to each group at most once from each task;
    3. the winners of a text's salts, ``salts`` rows at most, are combined.

    The winners go back to the rows by digest and salt. Where two different texts share a digest, by text as well.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs; other columns of docs are
    ignored. A null text counts as empty. A null id never wins against another id; a group of nulls has keep_id null.
    Where the winning row itself is repeated (same id, same text), one of the repeats is kept. An empty table gives an
    empty result.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), GAP, " ").alias("text")
    )
    rows = rows.withColumn("digest", F.sha2("text", 256))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    )
    combined = salted.groupBy("digest", "text").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = cut(combined.select("digest", "keep_id", "group_size"), "exact-dedup")
    on = ["digest"]
    if not winners.groupBy("digest").count().filter("count > 1").isEmpty():
        winners, on = combined, ["digest", "text"]
    # Repeats of one row are folded and unfolded again, so that one of them can be marked.
    repeats = rows.groupBy(*on, "doc_id").agg(F.count(F.lit(1)).cast("int").alias("repeats"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    # A digest of a thousandth of all rows or more is hot. There are at most a thousand of them, a bound for what is
    # broadcast; their rows meet the winner in ``salts`` groups.
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") * 1000 >= total
    hot = winners.filter(is_hot).select(F.col("digest").alias("_digest")).distinct()
    repeats = repeats.join(F.broadcast(hot), F.col("digest") == F.col("_digest"), "left")
    repeats = repeats.withColumn("salt", F.when(F.col("_digest").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(0).cast("int"))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (
        repeats.join(winners.withColumn("salt", F.explode(every)), [*on, "salt"])
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        .select("doc_id", "keep_id", "group_size", first.alias("kept"), F.col("digest").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay.

    A row goes if its id was dropped and not kept with another text; of rows that repeat id and text one stays.
    """
    found = cut(exact_dedup(docs, id_col, text_col), "exact-dedup-found")
    maybe, rest = parted(docs, id_col, found.filter("not kept").select("doc_id"))
    mine, theirs = fresh(docs, "_kept_id", "_kept_text")
    kept = found.filter("kept").select(F.col("doc_id").alias(mine), F.col("text_sha256").alias(theirs))
    met = maybe.dropDuplicates([id_col, text_col])
    digest = F.sha2(F.regexp_replace(F.coalesce(column(text_col), F.lit("")), GAP, " "), 256)
    met = met.join(kept, column(id_col).eqNullSafe(F.col(mine)) & (digest == F.col(theirs)), "left_semi")
    return rest.unionByName(met)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
