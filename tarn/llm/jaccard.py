"""N-gram Jaccard join: universe partition, pigeonhole over hashed segments, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, keyed, maybe_in, small, without
from .components import components

#: Sets, and of a set the tokens of least hash, from which the allocation is estimated; they steer costs alone.
SAMPLE, LOWEST = 1_000, 1_024
#: What a false candidate costs, in signatures.
CANDIDATE = 50.0
#: Partitions of the universe that a set tries before it offers its empty segments.
TURNS = 8
#: Sets that a task remembers to have offered.
REMEMBERED = 100_000
#: Bits of a set's sketch: bit b is the parity of its tokens whose hash is b, so two sketches differ in no more bits than
#: the sets do in tokens. As columns, one for each 64 bits.
SKETCH = 512
_SKETCH = [f"s{i}" for i in range(SKETCH // 64)]
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = 0) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted; of fewer than ``width`` words, one of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, (seed * 0x9E3779B97F4A7C15 + n) & (2**64 - 1), np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _A
        out ^= out >> np.uint64(31)
    return np.unique(_mixed(out))


def shingle_set(words: list[bytes], width: int) -> frozenset:
    """The distinct shingles themselves."""
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[k:] for k in range(width)), strict=False))


def similar(both: int, either: int, num: int, den: int) -> bool:
    return den * both >= num * either


class Scheme:
    """How the sets of a band of sizes [low, high) meet each other and larger ones.

    Two linked sets differ in at most min(sizes) * (den - num) / num tokens, and in (sum of sizes) * (den - num) /
    (den + num). The universe is cut by hash into segments. A segment of weight 1 is compared whole: it agrees if no token
    differs; one of weight 2 up to one deletion: it agrees if at most one differs. So segments that disagree weigh no more
    than the sets differ. A set offers segments, in the scheme's order, until they weigh ``need``: one and ``slack`` more
    than it can differ from any partner. Of the segments that both sets of a linked pair offer, those that agree weigh more
    than ``slack``. If one of them holds tokens to compare, the sets share a signature. Else both are *bare* in more than
    ``slack``, and both offer signatures under the next partition of the universe as well (see signatures()).

    doubles: the segments of weight 2; order: all segments, the first to offer first. Both by estimated cost.
    """

    def __init__(self, num: int, den: int, low: int, high: int, doubles: int = 0):
        self.num, self.den, self.low, self.high = num, den, low, high
        self.most = (high - 1) * (den - num) // num
        self.slack = self._least_slack(doubles) if self.most else 0
        total = self.most + 1 + self.slack
        self.doubles = min(doubles, total // 2)
        self.segments = total - self.doubles
        self.double = np.zeros(self.segments, bool)
        self.double[: self.doubles] = True
        self.arrange(np.arange(self.segments))

    def _least_slack(self, doubles: int) -> int:
        """The slack that makes the fewest signatures, those of further partitions included."""
        size = (self.low + self.high) / 2
        best, out = math.inf, 0
        for slack in range(4 * self.most + 9):
            m = max(1, self.most + 1 + slack - doubles)
            p = math.exp(-size / m)
            mean, deviation = m * p, math.sqrt(m * p * (1 - p)) + 1e-9
            poor = 0.5 * math.erfc((slack + 0.5 - mean) / deviation / math.sqrt(2))
            cost = (self.most + 1 + slack) / max(1e-9, 1 - poor)
            if cost < best:
                best, out = cost, slack
            elif self.most + 1 + slack > best:
                break
        return out

    def arrange(self, order: np.ndarray) -> None:
        self.place = np.empty(self.segments, np.int64)
        self.place[order] = np.arange(self.segments)
        self.weight = np.cumsum(1 + self.double[order])

    def need(self, size: int) -> int:
        """What the segments must weigh that a set of this size offers to the band's sets; 0: it has no partner there."""
        gap = self.den - self.num
        if size < self.high:
            return size * gap // self.num + 1 + self.slack
        small = min(self.high - 1, size)
        if size * self.num > small * self.den:
            return 0
        return min(small * gap // self.num, (small + size) * gap // (self.num + self.den)) + 1 + self.slack


def stretch(num: int, den: int) -> int:
    """The exponent of den / num by which bands grow: wider bands mean fewer signatures and emptier segments."""
    return 1 if num < 6 * (den - num) else 2


def band_edges(num: int, den: int, largest: int) -> tuple[int, ...]:
    """Sizes at which bands begin: a linked pair's sizes are in one band or in two neighbouring ones."""
    edges = [1]
    while edges[-1] <= largest:
        edge = edges[-1]
        for _ in range(stretch(num, den)):
            edge = edge * den // num + 1
        edges.append(edge)
    return tuple(edges)


class Schemes:
    """The scheme of each band; those that were not planned have no doubles and their segments in natural order."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.own = num, den, {}
        self.edges = np.array(band_edges(num, den, 1 << 40) if num < den else (1,))

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def of(self, band: int) -> Scheme:
        if band not in self.own:
            self.own[band] = Scheme(self.num, self.den, *(int(x) for x in self.edges[band : band + 2]))
        return self.own[band]

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """All of a set's: under its band's scheme and under that of the band below. Where only equal sets link, none."""
        if self.num == self.den:
            return np.zeros(0, np.uint64)
        band = self.band(len(h))
        return np.concatenate([signatures(h, self.of(j), j) for j in (band, band - 1) if j >= 0])


def _turned(h: np.ndarray, turn: int) -> np.ndarray:
    """The set under another hash, sorted."""
    return h if turn == 0 else np.sort(_mixed(h + np.uint64((turn * int(_A)) & (2**64 - 1))))


def _segment(h: np.ndarray, m: int) -> np.ndarray:
    """Segments are equal ranges of hash values, so each is a run of the sorted tokens."""
    return ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


def signatures(h: np.ndarray, scheme: Scheme, number: int) -> np.ndarray:
    """A set's signatures (its token hashes sorted) under a scheme; a segment's signature is a sum of hashes.

    Segments without a token to compare have none. A set that is bare in more than the scheme's slack tries further
    partitions of the universe, TURNS in all; so do its partners that could only agree with it where both are bare. Only
    a set that is bare under all of them offers its bare segments by number.
    """
    need = scheme.need(len(h))
    if not need:
        return np.zeros(0, np.uint64)
    upto = int(np.searchsorted(scheme.weight, need, "left")) + 1
    out = []
    for turn in range(TURNS):
        t = _turned(h, turn)
        segment = _segment(t, scheme.segments)
        tokens = _mixed(t ^ _C)
        start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        own = segment[start].astype(np.int64)
        size = np.diff(np.r_[start, len(t)])
        total = np.add.reduceat(tokens, start)
        offered = scheme.place[own] < upto
        deletes = scheme.double[own] & offered
        base = np.uint64((number << 36) + (turn << 32) + 1)
        salt = _mixed(own.astype(np.uint64) + base)
        out.append(_mixed(total ^ salt)[offered])
        if deletes.any():
            spread = np.repeat(deletes & (size > 1), size)
            out.append(_mixed((np.repeat(total, size) - tokens)[spread] ^ np.repeat(salt, size)[spread]))
        alone = deletes & (size == 1)
        bare = int(scheme.weight[min(upto, scheme.segments) - 1]) - int((1 + scheme.double[own])[offered].sum()) + 2 * int(alone.sum())
        if bare <= scheme.slack:
            break
        if turn == TURNS - 1:
            first = np.flatnonzero(scheme.place < upto)
            empty = np.concatenate([np.setdiff1d(first, own), own[alone]]).astype(np.uint64)
            out.append(_mixed(_mixed(empty + base)))
    return np.unique(np.concatenate(out))


def _agreeing(sets: list[np.ndarray], m: int, deletions: bool) -> np.ndarray:
    """For each of m segments, the pairs of sets that agree in it, and hold a token there; NaN: a segment not seen whole."""
    seg, sums, upto = [], [], m
    for h, whole in sets:
        segment = _segment(h, m)
        if not whole:
            upto = min(upto, int(segment[-1]))
        tokens = _mixed(h ^ _C)
        start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        total = np.add.reduceat(tokens, start)
        own = segment[start]
        if deletions:
            size = np.diff(np.r_[start, len(h)])
            several = np.repeat(size > 1, size)
            own = np.concatenate([own, segment[several]])
            total = np.concatenate([total, (np.repeat(total, size) - tokens)[several]])
        seg.append(own), sums.append(total)
    both = np.stack([np.concatenate(seg), np.concatenate(sums)], 1)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    edge = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(1)])
    n = np.diff(np.r_[edge, len(both)]).astype(float)
    out = np.bincount(both[edge, 0].astype(np.int64), n * (n - 1) / 2, minlength=m)[:m]
    out[upto:] = np.nan
    return out


def _apart(sets: list[tuple[int, np.ndarray]], num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """Without those that may be linked with one before: what a false candidate costs is to be told from unlinked sets."""
    out, seen, sizes = [], np.zeros((0, SKETCH // 64), np.uint64), np.zeros(0, np.int64)
    for n, h in sets:
        mine = _sketch(h).view(np.uint64)
        differ = np.bitwise_count(seen ^ mine).sum(1, dtype=np.int64)
        if not (differ * (den + num) <= (np.minimum(sizes, LOWEST) + min(n, LOWEST)) * (den - num)).any():
            out.append((n, h))
            seen, sizes = np.vstack([seen, mine]), np.r_[sizes, n]
    return out


def plan_schemes(num: int, den: int, sets: list[tuple[int, np.ndarray]], rows: int) -> Schemes:
    """Each band's allocation: of several numbers of doubles, that of least estimated cost a set.

    sets: of each sampled row the size of its set, and the LOWEST tokens of least hash; rows: how many rows there are.
    For each segment, the sample's buckets give how likely two sets agree in it, whole or up to a deletion (at least what
    the share of common tokens lets expect). Segments become doubles where that adds least, and the segments whose buckets
    are fullest are offered last, which is to say mostly not at all. A signature costs 1, a false candidate CANDIDATE.
    """
    schemes = Schemes(num, den)
    if num == den or not sets:
        return schemes
    sampled = len(sets)
    by_band: dict[int, list] = {}
    for n, h in _apart(sorted(sets, key=lambda x: (x[0], x[1].tobytes())), num, den):
        for band in {schemes.band(n), max(0, schemes.band(n) - 1)}:
            if schemes.of(band).need(n):
                by_band.setdefault(band, []).append((n, h))
    for band, own in by_band.items():
        if len(own) < 8 or not schemes.of(band).most:
            continue
        others = rows * len(own) / sampled
        pairs = len(own) * (len(own) - 1) / 2
        _, df = np.unique(np.concatenate([h for _, h in own]), return_counts=True)
        share = float((df * (df - 1)).sum() / ((len(own) - 1) * df.sum()))
        whole = [(h, len(h) == n) for n, h in own]
        size = sum(n for n, _ in own) / len(own)
        total = schemes.of(band).most + 1
        best, chosen = math.inf, None
        for doubles in sorted({total * k // 16 for k in (0, 1, 2, 4, 6, 8)}):
            scheme = Scheme(num, den, *(int(x) for x in schemes.edges[band : band + 2]), doubles)
            m, tokens = scheme.segments, size / scheme.segments
            rate = []
            for deletions, by_share in ((False, share**tokens), (True, (1 + tokens) * share ** max(0.0, tokens - 1))):
                seen = _agreeing(whole, m, deletions) / pairs
                mean = np.nanmean(seen) if np.isfinite(seen).any() else 0.0
                rate.append(np.maximum(np.where(np.isnan(seen), mean, seen), min(1.0, by_share)))
            single = 1 + CANDIDATE * others * rate[0]
            double = 1 + tokens + CANDIDATE * others * rate[1]
            scheme.double[:] = False
            scheme.double[np.argsort(double - single, kind="stable")[: scheme.doubles]] = True
            costs = np.where(scheme.double, double, single)
            order = np.argsort(costs / (1 + scheme.double), kind="stable")
            scheme.arrange(order)
            upto = int(np.searchsorted(scheme.weight, scheme.need((scheme.low + scheme.high) // 2), "left")) + 1
            if (cost := costs[order][:upto].sum()) < best:
                best, chosen = cost, scheme
        schemes.own[band] = chosen
    return schemes


def _node(h: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit hash as two signed numbers; the second names the set."""
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return tuple(int(np.uint64(x).astype(np.int64)) for x in (d >> 64, d & (2**64 - 1)))


def _sketch(h: np.ndarray) -> np.ndarray:
    parity = np.bincount((h >> np.uint64(23)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")


def long_sketch(h: np.ndarray, num: int, den: int) -> bytes | None:
    """A sketch as long as tells unlinked sets of this size apart: four times the bits in which linked ones may differ.

    Their number is a power of two, so that the longer of two sketches folds to the length of the other. None where that
    is no more than the short sketch has.
    """
    least = 8 * len(h) * (den - num) // (den + num)
    if least <= SKETCH:
        return None
    bits = 1 << (least - 1).bit_length()
    parity = np.bincount((h >> np.uint64(23)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The bits in which two long sketches differ, at most the tokens in which the sets do."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _sets(rows: DataFrame, width: int, num: int, den: int, seed: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, high, node, sketch, more = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(words_of(text), width, seed)
                a, b = _node(h)
                n.append(len(h)), high.append(a), node.append(b), sketch.append(_sketch(h)), more.append(long_sketch(h, num, den))
            bits = np.stack(sketch) if sketch else np.zeros((0, len(_SKETCH)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(node, pa.int64())]
                + [pa.array(np.ascontiguousarray(c)) for c in bits.T]
                + [pa.array(more, pa.binary())],
                names=["doc_id", "n_shingles", "high", "node", *_SKETCH, "sketch"],
            )

    schema = f"doc_id {kind}, n_shingles long, high long, node long, " + ", ".join(f"{c} long" for c in _SKETCH) + ", sketch binary"
    return rows.mapInArrow(run, schema)


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Whether sets of two aliased rows may be similar, by size and sketch: true for all that are."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (F.greatest(n, m) * num <= F.least(n, m) * den) & (differ * (den + num) <= (n + m) * (den - num))


def _sampled(rows: DataFrame, width: int, seed: int, sample: int) -> tuple[list[tuple[int, np.ndarray]], int]:
    """Sizes, and tokens of least hash, of the sets of about ``sample`` rows drawn by hash (twice as many at most); how many rows there are."""
    n = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_hashes(words_of(t), width, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(h) for h in sets], pa.int64()), pa.array([h[:LOWEST].tobytes() for h in sets], pa.binary())], names=["n", "low"])

    spot = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", "text"), 33)
    drawn = rows.filter(spot * F.lit(n) <= F.lit(float(1 << 31)) * sample).limit(2 * sample).select("text")
    got = drawn.mapInArrow(run, "n long, low binary").filter("n > 0").collect()
    return [(r[0], np.frombuffer(bytes(r[1]), np.uint64)) for r in got], n


def _offers(rows: DataFrame, width: int, seed: int, schemes: Schemes) -> DataFrame:
    """sig, node: what each set offers; of equal sets, the first ones in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        sigs, nodes, held = [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], names=["sig", "node"])
        for batch in small(batches):
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(words_of(text), width, seed)
                node = _node(h)[1] if len(h) else None
                if node is None or node in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(node)
                s = schemes.signatures(h)
                sigs.append(s.view(np.int64)), nodes.append(np.full(len(s), node, np.int64))
                held += len(s)
                if held >= 1 << 16:
                    yield made()
                    sigs, nodes, held = [], [], 0
        if sigs:
            yield made()

    return rows.select("text").mapInArrow(run, "sig long, node long")


def bucketed(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows sorted by both, without repeats: where each row's bucket begins, and its number of rows."""
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[start, len(sig)])
    return np.repeat(start, size), np.repeat(size, size)


def _met(offers: DataFrame) -> DataFrame:
    """sig, centre, node, several: nodes that share a signature with another, and the least node that does.

    Buckets of two are one row (their second node, sig 0); of buckets of three and more, each node is one. Offers are
    sorted by signature and streamed, so no bucket is held as a whole, however large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the last bucket so far: its first two rows and its last, and whether each was given out.
        sig, node, given = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

        def rows(take: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            several = size[take] > 2
            return pa.RecordBatch.from_arrays(
                [pa.array(np.where(several, sig[take], 0)), pa.array(node[first[take]]), pa.array(node[take]), pa.array(several)],
                names=["sig", "centre", "node", "several"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.concatenate([sig, batch.column("sig").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            given = np.concatenate([given, np.zeros(batch.num_rows, bool)])
            new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
            sig, node, given = sig[new], node[new], given[new]
            first, size = bucketed(sig, node)
            last = first == first[-1]
            take = ~given & np.where(size > 2, True, (size == 2) & (np.arange(len(sig)) > first) & ~last)
            if take.any():
                yield rows(take, first, size)
            given = given | take
            keep = np.flatnonzero(last)
            keep = np.unique(np.r_[keep[:2], keep[-1:]])
            sig, node, given = sig[keep], node[keep], given[keep]
        if len(sig):
            first, size = bucketed(sig, node)
            take = ~given & (size == 2) & (np.arange(len(sig)) > first)
            if take.any():
                yield rows(take, first, size)

    return offers.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "sig long, centre long, node long, several boolean")


def _likely(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (u, v) that the long sketches do not rule out, none of which is linked.

    The short sketches of large sets rule out little, and such pairs grow faster than the rows: their texts would be too
    much to send for each pair.
    """
    a, b = (nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n_u", "n_v", "sketch_u", "sketch_v"))
            may = [not p or not q or differing(p, q) * (den + num) <= (i + j) * (den - num) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(may, pa.bool_()))

    return pairs.join(b, "v").join(a, "u").select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(run, "u long, v long")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of pairs (u, v) whose sets, of the shingles themselves, are similar."""
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(b, "v").join(a, "u").select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, frozenset()
        for batch in small(batches, 64):
            out = []
            for u, v, text_u, text_v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != last:
                    last, left = u, shingle_set(words_of(text_u), width)
                right = shingle_set(words_of(text_v), width)
                common = len(left & right)
                if common and similar(common, len(left) + len(right) - common, num, den):
                    out.append((u, v))
            u, v = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long").distinct()


def jaccard_classes(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: classes of documents linked by shingle sets with Jaccard >= num / den.

    Equal sets are one node from the start. A node offers signatures (see Scheme), allotted by what a sample of about
    ``sample`` rows costs, which steers time and never results; nodes that share one are a bucket.
    Each bucket's least node is compared with its others, exactly, on the texts' own shingles. Nodes of a bucket that are
    then in different components are compared too, all but those of its largest component with each node elsewhere. Before
    texts are fetched, sizes and sketches rule out pairs that differ in too many tokens; that never loses a link and keeps
    a bucket of near copies just below the threshold from becoming rows. Sketches grow with the sets, so texts are sent
    only for pairs of which few are unlinked. So every pair that shares a signature ends
    compared, ruled out or in one component.

    Whole texts; A-Z are lower-cased. A null or wordless text has 0 shingles and is linked with nothing; its component
    is its own id. component_id is the least id of the component, nulls left aside. Rows of equal ids are rows of their
    own. Other columns are ignored; an empty table gives an empty result. A set is named by 64 of the 128 bits by which
    sets are told apart; should two sets ever share a name, all names are drawn anew.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col)
    for seed in range(8):
        sets = cut(_sets(rows, width, num, den, seed), "jaccard-sets")
        nodes = cut(
            sets.filter("n_shingles > 0").groupBy("node", "high", "n_shingles", *_SKETCH, "sketch").agg(F.min("doc_id").alias("rep")), "jaccard-nodes"
        )
        if nodes.groupBy("node").count().filter("count > 1").isEmpty():
            break
        drop(sets, nodes)
    else:
        raise RuntimeError("64-bit names of sets collide under every seed: too many sets")
    schemes = plan_schemes(num, den, *_sampled(rows, width, seed, sample))
    met = cut(_met(_offers(rows, width, seed, schemes)), "jaccard-met")

    sketched = nodes.select("node", "n_shingles", *_SKETCH)
    stars = met.filter("node <> centre").select("centre", "node").distinct()
    stars = stars.join(sketched.alias("b"), "node").select("centre", F.struct("b.node", "b.n_shingles", *[f"b.{c}" for c in _SKETCH]).alias("b"))
    stars = stars.join(sketched.alias("a"), F.col("centre") == F.col("a.node")).filter(_may_link("a", "b", num, den))
    links = _verified(stars.select(F.col("centre").alias("u"), F.col("b.node").alias("v")), rows, nodes, width, num, den, seed)
    comps = components(links)

    placed = met.filter("several").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("sig")
    mixed = cut(placed.join(mixed, "sig", "left_semi"), "jaccard-placed")
    sizes = mixed.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("sig").agg(F.max(F.struct("n", "comp")).alias("main")).select("sig", F.col("main.comp").alias("main"))
    placed = cut(mixed.join(main, "sig").join(sketched, "node"), "jaccard-placed")
    a, b = placed.filter("comp <> main").alias("a"), placed.alias("b")
    # Of two rows outside the main component the pair comes once; pairs with the centre were compared before.
    once = (F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    new = (F.col("a.node") != F.col("a.centre")) & (F.col("b.node") != F.col("b.centre"))
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.comp") != F.col("b.comp")) & once & new & _may_link("a", "b", num, den))
    more = _verified(pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct(), rows, nodes, width, num, den, seed)
    drop(met, mixed, placed)
    if not more.isEmpty():
        drop(comps)
        comps = components(links.unionByName(more))
    drop(links, more)
    least = comps.join(nodes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
    of_node = comps.join(least, "comp").select("node", "least")
    of_node = nodes.select("node", "rep").join(of_node, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    some, none = sets.filter("n_shingles > 0"), sets.filter("n_shingles = 0")
    return (
        some.join(of_node, "node").select("doc_id", "n_shingles", "component_id")
        .unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, num: int, den: int, seed: int) -> DataFrame:
    """Those of pairs (u, v) of nodes that are linked, as a table. Only their texts are fetched, one for each node."""
    met = cut(pairs, "jaccard-pairs")
    pairs = cut(_likely(met, nodes, num, den), "jaccard-likely")
    named = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    named = cut(named.join(nodes, "node").select("node", "rep"), "jaccard-named")
    texts = cut(_texts(rows, named, width, seed), "jaccard-texts")
    links = cut(_linked(pairs, texts, width, num, den), "jaccard-links")
    drop(met, pairs, named, texts)
    return links


def _texts(rows: DataFrame, named: DataFrame, width: int, seed: int) -> DataFrame:
    """A text of each named node: that of its least document."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            nodes = [_node(shingle_hashes(words_of(t), width, seed))[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(nodes, pa.int64())], names=["doc_id", "text", "node"])

    few = maybe_in(rows, "doc_id", named.select("rep")).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, node long")
    named = named.withColumnRenamed("node", "_node")
    met = few.join(named, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return met.select("node", "text").dropDuplicates(["node"])


def one_of_each_class(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id") -> DataFrame:
    """docs with one document of each class, that of the least id; all columns stay.

    Rows of equal ids go only if each of them is to go.
    """
    found = cut(jaccard_classes(docs, width, num, den, id_col), "jaccard-classes")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return without(docs, id_col, found.filter(~stays).select("doc_id"), found.filter(stays).select("doc_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(3, len(ws)) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), e AS (
  SELECT u, v FROM l UNION SELECT v, u FROM l
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reached
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
