"""Document fingerprints: improbable-feature digests. The rarest byte windows of a text, in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, partitions, range_of, range_splits, small

#: Bytes of a feature; features that one neighbourhood ranks; neighbourhoods in which a feature must be the rarest.
FEATURE, AROUND, WINS = 64, 64, 16
#: Texts of fewer bytes than SHORT have no full neighbourhood; all their windows of TINY bytes are features.
SHORT, TINY = FEATURE + AROUND, 16
#: Entropy levels; those below LOWEST (nearly constant bytes) are never features.
LEVELS, LOWEST = 1000, 100
#: A filter's bits, bits set by a feature, features after which the next filter of the chain begins.
BITS, PROBES, FULL = 2048, 5, 160
#: Overlap that counts as none, as a share of the way from the expected to the greatest possible overlap.
CUTOFF = 0.1
#: Bytes worked on at once; longer texts are worked on in overlapping blocks.
BLOCK = 1 << 18
NONE = 1023

#: c * log2(c) in fixed point, so that running sums are exact.
_SCALE = 1 << 16
_F = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, FEATURE + 1)], np.int32)
_STEP = np.diff(_F)
_MOST = int(_F[FEATURE])


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """The level of each FEATURE-byte window's entropy, by its start.

    From one window to the next a byte leaves and one comes; the change of the sum of c * log2(c) follows from how often
    each occurs in the FEATURE - 1 bytes between.
    """
    n = len(x)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    same = np.empty(n, bool)
    for k in range(1, FEATURE):
        np.equal(x[k:], x[:-k], out=same[: n - k])
        as_int = same[: n - k].view(np.uint8)
        before[k:] += as_int
        after[: n - k] += as_int
    first = int(_F[np.bincount(x[:FEATURE], minlength=256)].sum())
    change = _STEP[before[FEATURE:]] - _STEP[after[: n - FEATURE]]
    total = np.empty(n - FEATURE + 1, np.int32)
    total[0] = first
    np.cumsum(change, out=total[1:])
    total[1:] += first
    return ((_MOST - total).astype(np.int64) * LEVELS // (_MOST + 1)).astype(np.int32)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one array behind a run of zeros; each text's start; whether a feature of one text starts there."""
    x = np.frombuffer(b"\0" * FEATURE + b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    start = FEATURE + np.cumsum(size) - size
    edge = np.zeros(len(x) + 1, np.int32)
    np.add.at(edge, start, (size >= FEATURE).astype(np.int32))
    np.add.at(edge, start + np.maximum(0, size - FEATURE + 1), -(size >= FEATURE).astype(np.int32))
    return x, start, np.cumsum(edge[: max(0, len(x) - FEATURE + 1)]) > 0


def _blocks(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of a long text with what lies around them: from where in the block features count, how many, the bytes."""
    around = AROUND + FEATURE
    for a in range(0, len(text), BLOCK):
        low = max(0, a - around)
        yield a - low, BLOCK, text[low : a + BLOCK + around + FEATURE]


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy level."""
    counts = np.zeros(LEVELS, np.int64)
    short = [t for t in texts if len(t) <= BLOCK]
    for group in _grouped(short):
        x, _, valid = joined([short[i] for i in group])
        if len(valid):
            counts += np.bincount(entropy_levels(x)[valid], minlength=LEVELS)
    for t in texts:
        if len(t) > BLOCK:
            for skip, many, part in _blocks(t):
                if len(part) >= FEATURE:
                    counts += np.bincount(entropy_levels(np.frombuffer(part, np.uint8))[skip : skip + many], minlength=LEVELS)
    return counts


def _grouped(texts: list[bytes]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size >= BLOCK:
            yield group
            group, size = [], 0
    if group:
        yield group


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Each level's rank by rarity: 0 for the level that the fewest windows have (ties: the higher entropy first)."""
    ranks = np.full(LEVELS, NONE, np.int32)
    usable = np.arange(LOWEST, LEVELS)
    order = usable[np.lexsort((-usable, counts[LOWEST:]))]
    ranks[order] = np.minimum(np.arange(len(order)), NONE - 1)
    return ranks


def _hashes(x: np.ndarray, at: np.ndarray | slice, width: int = FEATURE) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes at each place."""
    rows = np.lib.stride_tricks.sliding_window_view(x, width)[at]
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _selected(x: np.ndarray, valid: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the features that are the rarest (leftmost of equals) of at least WINS neighbourhoods."""
    rank = np.where(valid, ranks[entropy_levels(x)], NONE).astype(np.int32)
    m = (rank << 20) | np.arange(len(rank), dtype=np.int32)
    width = 1
    while width < AROUND:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    wins = np.bincount((m & 0xFFFFF)[(m >> 20) < NONE], minlength=len(rank))
    return np.flatnonzero(wins >= WINS)


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's selected features, in their order. See SHORT; a text of fewer than TINY bytes is one feature."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    plain = [i for i, t in enumerate(texts) if SHORT <= len(t) <= BLOCK]
    for group in _grouped([texts[i] for i in plain]):
        own = [plain[g] for g in group]
        x, start, valid = joined([texts[i] for i in own])
        x = np.concatenate([x, np.zeros(FEATURE + AROUND, np.uint8)])
        at = _selected(x, np.concatenate([valid, np.zeros(len(x) - FEATURE + 1 - len(valid), bool)]), ranks)
        h, cut_at = _hashes(x, at), np.searchsorted(at, start)
        for k, i in enumerate(own):
            out[i] = h[cut_at[k] : cut_at[k + 1] if k + 1 < len(own) else None]
    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            found = []
            for skip, many, part in _blocks(t):
                x, _, valid = joined([part])
                x = np.concatenate([x, np.zeros(FEATURE + AROUND, np.uint8)])
                at = _selected(x, np.concatenate([valid, np.zeros(len(x) - FEATURE + 1 - len(valid), bool)]), ranks)
                at = at[(at >= FEATURE + skip) & (at < FEATURE + skip + many)]
                found.append(_hashes(x, at))
            out[i] = np.concatenate(found)
        elif TINY <= len(t) < SHORT:
            out[i] = _hashes(np.frombuffer(t, np.uint8), slice(None), TINY)
        if t and not len(out[i]):
            out[i] = np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), "<u8")
    return out


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of filters, one row of bits each; a feature that repeats is inserted once."""
    _, first = np.unique(hashes, return_index=True)
    h = hashes[np.sort(first)]
    chain = np.zeros((-(-len(h) // FULL), BITS), bool)
    of = np.arange(len(h)) // FULL
    for k in range(PROBES):
        chain[of, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return chain


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(base64.b64decode(fingerprint), np.uint8)).reshape(-1, BITS).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how far the overlap of each filter of the smaller chain with its best match exceeds what chance gives.

    The mean over filters, weighted by their bits. Two empty chains are alike (1), an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (len(a), int(a.sum())) > (len(b), int(b.sum())):
        a, b = b, a
    n, m = a.sum(1).astype(np.float32)[:, None], b.sum(1).astype(np.float32)[None]
    both = a.astype(np.float32) @ b.T.astype(np.float32)
    chance, most = n * m / BITS, np.minimum(n, m)
    low = chance + CUTOFF * (most - chance)
    near = np.clip((both - low) / np.maximum(most - low, 1e-6), 0, 1).max(1)
    return float(min(1.0, (near * n[:, 0]).sum() / n.sum()))


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The ranks of the entropy levels by their counts over every window of every whole text of docs.

    LEVELS numbers come to the driver. They may be kept and given to fingerprint() to compare with other corpora.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for batch in small(batches):
            counts += level_counts([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist() if t])
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["level", "n"])

    counts = np.zeros(LEVELS, np.int64)
    for level, n in keyed(docs, text=text_col).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n")).collect():
        counts[level] = n
    return ranks_of(counts)


def fingerprint(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row of docs (null text: empty, whose fingerprint is the empty string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            prints = [as_text(filters(h)) for h in features(texts, ranks)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    rows = keyed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _with_last_of_range_before(rows: DataFrame) -> DataFrame:
    """rows in ranges of rising doc_id, sorted; ahead of each the greatest row of the range before, marked ahead.

    Before the first range lies the last. Only ids are looked at to find the ranges and their ends (one id a range
    comes to the driver); texts are shuffled once.
    """
    splits = range_splits(rows, "doc_id", partitions(rows.sparkSession))
    rows = rows.withColumn("range", range_of(F.col("doc_id"), splits))
    ends = dict(map(tuple, rows.select("range", "doc_id").groupBy("range").agg(F.max("doc_id")).collect()))
    used = sorted(ends)
    following = dict(zip(used, used[1:] + used[:1], strict=True))
    kind = rows.schema["doc_id"].dataType

    def by_range(values: dict) -> Column:
        return F.element_at(F.array(*[F.lit(values.get(r)) for r in range(len(splits) + 1)]), F.col("range") + 1)

    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("ahead"))
    next_one = F.struct(by_range(following).cast("int").alias("to"), F.lit(True).alias("ahead"))
    last = F.col("doc_id").eqNullSafe(by_range(ends).cast(kind))
    dealt = rows.withColumn("copy", F.explode(F.when(last, F.array(own, next_one)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "copy.to", "copy.ahead").repartitionById(len(splits) + 1, F.col("to"))
    return dealt.sortWithinPartitions(F.col("ahead").desc(), F.col("doc_id").asc_nulls_first(), "text").drop("to")


def compare_edits(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against an edited copy of itself and against the document after it in descending order of id.

    The edit replaces the last third of the code points (rounded down) by as many first ones (or all) of that next
    document; after the last document comes the first. A null text counts as empty. Null ids come last, rows of equal
    ids in descending order of text. The only row of a table is its own next. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, chain = "", np.zeros((0, BITS), bool)  # of the row before: in descending order, the next
        for batch in small(batches):
            rows, texts = [], []
            for i, t, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = t or ""
                if ahead:
                    text, chain = t, None
                    continue
                k = len(t) // 3
                edited = t[: len(t) - k] + text[:k]
                data = edited.encode("utf-8", "surrogatepass")
                rows.append((i, len(t), hashlib.sha256(data).hexdigest()))
                texts += [t.encode("utf-8", "surrogatepass"), data]
                if chain is None:
                    chain = filters(features([text.encode("utf-8", "surrogatepass")], ranks)[0])
                text = t
            chains = [filters(h) for h in features(texts, ranks)]
            out = []
            for (i, n, sha), own, edit in zip(rows, chains[::2], chains[1::2], strict=True):
                out.append((i, n, sha, as_text(own), as_text(edit), likeness(own, edit), likeness(own, chain)))
                chain = own
            if out:
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = keyed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_last_of_range_before(rows).mapInArrow(run, schema)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare_edits(docs, rarity(docs))
