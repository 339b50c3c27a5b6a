"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, cut, fresh, n_words

#: Words of a block.
BLOCK = 256
#: The golden ratio's fraction in units of 2**-32 (fixed value); slot i's point is i * GOLDEN mod 2**32.
GOLDEN, UNIT = 2654435769, 1 << 32
#: Rows that one task sorts at once, about; and slots that it numbers.
SORTED, CHUNK = 4_000, 1 << 16
#: Cells of the unit interval by which points find their source.
CELLS = 1 << 12


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: float, most: float) -> list[float]:
    """Each source's target: share * (all sizes) by weight, none above most * its size, the excess reshared by weight.

    The shares rise together, as level * weight, until a source meets its cap; so they are min(cap, level * weight).
    """
    total = sum(n for _, n in sizes)
    caps = [most * n for _, n in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, weight = share * total, sum(w)
    level = 0.0
    for i in sorted(range(len(sizes)), key=lambda i: (Fraction(caps[i]) / w[i], i)):
        level = left / weight
        if level * w[i] <= caps[i]:
            break
        left -= caps[i]
        weight -= w[i]
    return [min(c, level * x) for c, x in zip(caps, w, strict=True)]


def _positions(rows: DataFrame, sizes: list[tuple[str | None, int, int]]) -> DataFrame:
    """Each row's place in its source's shuffled stream: at, the words before it.

    The order is that of md5(id). Sources are cut into ranges of it with about SORTED rows each, so that a source of any
    size is sorted and summed in many tasks; the ranges' own sums are a small table.
    """
    spark = rows.sparkSession
    most = max([n for _, _, n in sizes], default=1)
    bits = min(31, max(0, math.ceil(math.log2(max(1, most / SORTED)))))
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), 32 - bits))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("of_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("of_range").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("order", "size")
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn(
        "ahead", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    sums = sums.withColumnsRenamed({"source": "_source", "range": "_range"})
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))
    return rows.join(sums, on).withColumn("at", F.col("base") + F.col("ahead")).drop("_source", "_range")


def _schedule(spark: SparkSession, goals: list[int], block: int) -> DataFrame:
    """Slots of the mix (slot, number of source, rank of the slot within its source).

    Slot i takes the source into whose part of the unit interval, parts being the goals' shares, point i of the golden
    ratio's sequence falls. A source's slots end when its goal is met; those that it still lacks then come last.
    """
    total = sum(goals)
    schema = "cell int, low long, high long, number int"
    cells, edge = [], 0
    for i, goal in enumerate(goals):
        low, edge = (edge, edge + goal)
        low, high = low * UNIT // max(1, total), edge * UNIT // max(1, total)
        width = UNIT // CELLS
        cells += [(c, low, high, i) for c in range(low // width, (high - 1) // width + 1)] if high > low else []
    n = -(-total // block)
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(UNIT))
    slots = spark.range(n).select("id", point.alias("point")).withColumn("cell", (F.expr(f"point div {UNIT // CELLS}")).cast("int"))
    slots = slots.join(spark.createDataFrame(cells, schema), "cell").filter("point >= low and point < high").select("id", "number")
    slots = slots.withColumn("chunk", F.expr(f"id div {CHUNK}"))
    counts = slots.groupBy("number", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("number", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("id")) - 1
    ranked = slots.withColumn("nth", nth).join(counts, ["number", "chunk"])
    ranked = ranked.select(F.col("id").alias("slot"), "number", (F.col("base") + F.col("nth")).alias("rank"))
    need = [(i, -(-goal // block)) for i, goal in enumerate(goals)]
    need = spark.createDataFrame(need, "number int, blocks long")
    had = ranked.groupBy("number").agg(F.count(F.lit(1)).alias("had"))
    lacking = need.join(had, "number", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < blocks")
    lacking = lacking.withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)))
    late = lacking.select((F.lit(n) + F.col("rank") * F.lit(len(goals)) + F.col("number")).alias("slot"), "number", "rank")
    return ranked.join(need, "number").filter("rank < blocks").select("slot", "number", "rank").unionByName(late)


def mix(
    docs: DataFrame,
    size: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
    order_key: Column | None = None,
) -> DataFrame:
    """The pieces of documents that a mix of the sources takes, in the order of its slots.

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``share`` times the size of all
    documents, each at most ``most`` times its own size (see targets()). A source's documents, shuffled by md5 of the id (or of ``order_key``),
    form one stream of words, repeated as often as its target needs, and cut into blocks of ``block`` words; slot after
    slot the schedule takes the next block of the source that its point names. The last block of a source is cut short,
    so that each source gives exactly floor(target) words.

    Sizes are words (or the expression ``size``, never negative). Null texts and sizes count 0; such documents have no
    pieces but a row with slot null, so each row of docs has at least one row. Rows of equal ids are rows of their own.
    On the driver: one number a source. Other columns of docs are ignored; an empty table gives an empty result.

    Returns row (number of the document's row: source, place), doc_id, source, size, source_size, target, slot, from
    and words (the piece's place in the document and its length), pass (0 the first time round).
    """
    spark = docs.sparkSession
    words = n_words(F.col(f"`{text_col}`")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    key = F.col(f"`{id_col}`") if order_key is None else order_key
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words.alias("size"), key.alias("key"))
    rows = cut(rows, "mix-sizes")
    per = rows.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    sizes = sorted(((r[0], r[1], r[2]) for r in per), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    aims = targets([x[:2] for x in sizes], weights, share, most)
    goals = [math.floor(t) for t in aims]
    known = [(s, i, n, t, g) for i, ((s, n, _), t, g) in enumerate(zip(sizes, aims, goals, strict=True))]
    known = spark.createDataFrame(known, "_source string, number int, source_size long, target double, goal long")
    placed = _positions(rows, sizes)
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # A pass of the stream starts at pass * source_size; what lies before the goal is taken, in pieces that end with blocks.
    passes = F.when((F.col("size") > 0) & (F.col("at") < F.col("goal")), F.expr("sequence(0, cast((goal - 1 - at) div source_size as int))"))
    p = placed.withColumn("pass", F.explode_outer(passes)).withColumn("begin", F.expr("at + pass * source_size"))
    p = p.withColumn("end", F.expr("least(begin + size, goal)"))
    p = p.withColumn("rank", F.explode_outer(F.when(F.col("begin").isNotNull(), F.expr(f"sequence(begin div {block}, (end - 1) div {block})"))))
    p = p.withColumn("low", F.expr(f"greatest(begin, rank * {block})")).withColumn("high", F.expr(f"least(end, (rank + 1) * {block})"))
    slots = _schedule(spark, goals, block)
    p = p.join(slots, ["number", "rank"], "left")
    return p.select(
        F.struct("number", "range", "nth").alias("row"), "doc_id", "source", "size", "source_size", "target",
        "slot", F.expr("low - begin").alias("from"), F.when(F.col("slot").isNotNull(), F.col("high") - F.col("low")).alias("words"), "pass",
    )


def taken(pieces: DataFrame) -> DataFrame:
    """The words taken of each row of the mixed documents."""
    same = ["row", "doc_id", "source", "size", "source_size", "target"]
    return pieces.groupBy(*same).agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken")).drop("row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it: its words taken over its size, rounded; else it goes.

    So a source's whole documents come near its target. Documents without words go. Rows that repeat id and text are
    taken equally often.
    """
    key = F.xxhash64(column(text_col))
    ids = docs.select(F.struct(column(id_col).alias("id"), key.alias("key")).alias("doc_id"), column(text_col).alias("text"), column(source_col).alias("source"))
    times = taken(mix(ids, order_key=F.col("doc_id.id"), **how)).filter("size > 0").groupBy("doc_id").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    mine, theirs, often, nth = fresh(docs, "_id", "_key", "_times", "_nth")
    times = times.filter("times > 0").select(F.col("doc_id.id").alias(mine), F.col("doc_id.key").alias(theirs), F.col("times").alias(often))
    met = docs.join(times, column(id_col).eqNullSafe(F.col(mine)) & (key == F.col(theirs)))
    return met.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*[column(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken(pieces).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM s
), o AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, number) AS step
  FROM w
), l AS (
  SELECT coalesce(min_by(level, step) FILTER (level * weight <= cap), max_by(level, step)) AS level FROM o
), t AS (
  SELECT source, source_size, least(cap, (SELECT level FROM l) * weight) AS target FROM w
), p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(pos + size, goal) - pos)
            + greatest(0, least(source_size + pos + size, goal) - (source_size + pos)) AS BIGINT) AS taken
FROM p
"""
