"""Substring dedup: passages that repeat anywhere in the corpus, by backward search in a compressed FM-index per shard."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, keyed, maybe_in, parted, small
from .fm_index import FMIndex, repeated_span

#: Words of a window, and of the anchor that decides where a window is looked up.
WINDOW, ANCHOR = 35, 8
#: Words of a shard's index, about; an anchor seen more often than HOT times is split by window.
SHARD, HOT = 250_000, 64
#: Groups that a very common anchor's runs are dealt to.
SALTS = 32
#: Words of a text whose windows are dealt with at once.
BLOCK = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xFF51AFD7ED558CCD)


def anchor_runs(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a text's windows that share their anchor: its hash, the first window, and how many.

    A window's anchor is the least hash of its sequences of ``anchor`` words, the leftmost of equals, so equal windows have
    equal anchors at equal places, wherever they are.
    """
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    parts = []
    many = len(words) - window + 1
    for a in range(0, many, BLOCK):
        b = min(many, a + BLOCK)
        g = _shingles(h[a : b + window - 1], anchor)
        least = (g & ~np.uint64(0x3FFFFF)) | np.arange(len(g), dtype=np.uint64)
        span, width = window - anchor + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & np.uint64(0x3FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        parts.append((g[at[first]].view(np.int64), (first + a).astype(np.int32), np.diff(np.r_[first, len(at)]).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _text_keys(rows: DataFrame) -> DataFrame:
    """rows with k1 and k2, 128 bits of the text that stand for it."""
    return rows.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("second"), F.col("text"), F.length("text")))


def _runs(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, columns = [], ([], [], [])
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                n.append(len(words))
                for column, values in zip(columns, anchor_runs(words, window, anchor), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64())]
                + [pa.array(c, pa.list_(t)) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)],
                names=["doc_id", "k1", "k2", "n_words", "anchors", "starts", "counts"],
            )

    schema = f"doc_id {kind}, k1 long, k2 long, n_words long, anchors array<long>, starts array<int>, counts array<int>"
    return rows.select("doc_id", "text", "k1", "k2").mapInArrow(run, schema)


def _pieces(texts: DataFrame, window: int, shards: int) -> DataFrame:
    """The text of each run that is to be looked up, or, where its anchor is hot, of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "start", "shard", "r1", "r2", "piece"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in small(batches):
            out, held = [], 0
            for k1, k2, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for r in runs:
                    a, n = r["start"], r["count"]
                    spans = [(i, i + window) for i in range(a, a + n)] if r["hot"] else [(a, a + n + window - 1)]
                    for low, high in spans:
                        piece = b" ".join(words[low:high])
                        r1, r2 = struct.unpack("<qq", xxhash.xxh3_128_digest(piece))
                        out.append((k1, k2, low, (r1 if r["hot"] else r["anchor"]) % shards, r1, r2, piece))
                        held += len(piece)
                if held >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return texts.select("k1", "k2", "text", "runs").mapInArrow(run, "k1 long, k2 long, start int, shard int, r1 long, r2 long, piece binary")


def _spans(pieces: DataFrame, window: int) -> DataFrame:
    """r1, r2, low, high: of each distinct piece, the words from its first to its last repeated window.

    Equal pieces are counted before they are shuffled; a shard's index holds each at most twice.
    """
    distinct = pieces.groupBy("shard", "r1", "r2", "piece").agg(F.count(F.lit(1)).alias("n"))

    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        sequences = [
            np.array([number.setdefault(w, len(number) + 1) for w in piece.split(b" ")], np.int64) for piece in table.column("piece").to_pylist()
        ]
        twice = [s for s, n in zip(sequences, table.column("n").to_pylist(), strict=True) if n > 1]
        index = FMIndex(sequences + twice, max(map(len, sequences), default=1))
        low, high = repeated_span(index, sequences, window)
        some = high > 0
        return pa.table({
            "r1": table.column("r1").filter(pa.array(some)), "r2": table.column("r2").filter(pa.array(some)),
            "low": pa.array(low[some].astype(np.int32)), "high": pa.array(high[some].astype(np.int32)),
        })

    return distinct.groupBy("shard").applyInArrow(run, "r1 long, r2 long, low int, high int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Where each distinct text repeats, itself or another: (k1, k2, spans: words [low, high)), and all rows' keys.

    1. Every text is cut into runs of windows with a common anchor. Equal windows have equal anchors, so a window whose
       anchor occurs once occurs once.
    2. The runs of anchors that occur more often go, as text, to the shard of their anchor (windows of hot anchors to
       shards of their own hash, so that no anchor fills a shard), equal pieces counted once before the shuffle.
    3. Each shard builds an FM-index of its pieces and streams them through it by backward search; every occurrence of
       a window is in the one shard, so what occurs twice there repeats in the corpus, and nothing else does.

    Of equal texts one stands for all; it is one span as a whole, if a window long.
    """
    rows = _text_keys(keyed(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))))
    runs = cut(_runs(rows, window, anchor), "substring-runs")
    texts = runs.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n"))
    texts = cut(texts, "substring-texts")
    reps = texts.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}).drop("n")
    is_rep = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    once = runs.join(reps.select("_k1", "_k2", "rep"), is_rep).select("k1", "k2", F.explode(F.arrays_zip("anchors", "starts", "counts")).alias("r"))
    once = once.select("k1", "k2", F.col("r.anchors").alias("anchor"), F.col("r.starts").alias("start"), F.col("r.counts").alias("count"))
    often = anchors = cut(once.groupBy("anchor").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1"), "substring-anchors")
    # Anchors of a thousandth of all such runs or more: a thousand at most, a bound for what is broadcast. Their runs are
    # dealt to SALTS groups.
    total = often.agg(F.sum("seen")).first()[0] or 0
    common = F.col("seen") * 1000 >= total
    crowds = often.filter(common).select(F.col("anchor").alias("_anchor"))
    once = once.join(F.broadcast(crowds), F.col("anchor") == F.col("_anchor"), "left")
    once = once.withColumn("salt", F.when(F.col("_anchor").isNotNull(), F.pmod(F.xxhash64("k1", "start"), F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(common, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    often = often.withColumn("salt", F.explode(every)).select("anchor", "salt", (F.col("seen") > HOT).alias("hot"))
    wanted = once.join(often, ["anchor", "salt"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "start", "count", "hot")).alias("runs"))
    wanted = cut(wanted, "substring-wanted")
    total = wanted.agg(F.sum(F.expr(f"aggregate(runs, 0L, (s, r) -> s + r.count + {window - 1})"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    need = wanted.join(texts.select("k1", "k2", "rep"), ["k1", "k2"]).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    near = maybe_in(rows, "k1", wanted.select("k1"))
    found = near.join(need, is_rep).select("k1", "k2", "text", "runs")
    pieces = cut(_pieces(found, window, shards), "substring-pieces")
    spans = _spans(pieces, window)
    where = pieces.select("k1", "k2", "start", "r1", "r2").join(spans, ["r1", "r2"])
    where = where.select("k1", "k2", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).alias("s"))
    whole = texts.filter(f"copies > 1 and n >= {window}").select("k1", "k2", F.struct(F.lit(0).alias("low"), F.col("n").cast("int").alias("high")).alias("s"))
    spans = cut(where.unionByName(whole).groupBy("k1", "k2").agg(F.collect_set("s").alias("spans")), "substring-spans")
    drop(runs, texts, anchors, wanted, pieces)
    return spans, rows


def drop_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by one space) of each row of docs.

    A word goes if a window of ``window`` words that covers it occurs, as a sequence, at another place as well, in the same
    document or another. Words are taken from whole texts as they are; a null text has none; texts shorter than a window
    stay whole. Repeated rows are copies of each other. All windows are judged on the input. Other columns are ignored.
    """
    spans, rows = repeated_spans(docs, window, anchor, id_col, text_col)
    maybe, clean = parted(rows, "k1", spans.select("k1"))
    none = F.lit(None).cast("array<struct<low:int,high:int>>")
    clean = clean.select("doc_id", "text", none.alias("spans"))
    hit = maybe.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, texts, found = batch.columns
            n, removed, kept = [], [], []
            for text, spans in zip(texts.to_pylist(), found.to_pylist(), strict=True):
                words = words_of(text)
                n.append(len(words))
                if spans:
                    gone = np.zeros(len(words), bool)
                    for s in spans:
                        gone[s["low"] : s["high"]] = True
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return clean.unionByName(hit).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(g)) AS c FROM s) WHERE c > 1
), t AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM r
), x AS (
  SELECT doc_id, list(p) AS ps FROM t GROUP BY doc_id
), k AS (
  SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w)
  WHERE (doc_id, p) NOT IN (SELECT (doc_id, p) FROM t)
), j AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(j.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(j.kept, '')) AS kept_sha256
FROM w LEFT JOIN j USING (doc_id)
"""
