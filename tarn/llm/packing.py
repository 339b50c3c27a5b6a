"""Best-fit packing into sequences of several permitted lengths, chosen jointly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words

#: Permitted sequence lengths, and what a sequence costs besides its length.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096, 8192), 64
#: Pieces that one task packs, about.
SHARD = 50_000


class _Sizes:
    """A multiset of sizes that finds the largest one within a limit; present sizes are the bits of one integer."""

    def __init__(self, sizes: np.ndarray, most: int):
        self.counts = np.bincount(sizes, minlength=most + 1).tolist()
        self.bits = sum(1 << s for s, n in enumerate(self.counts) if n)

    def remove(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.bits ^= 1 << size

    def fill(self, room: int) -> int:
        """How much of ``room`` the largest fitting sizes fill, one after another; nothing is removed."""
        total, below = 0, room
        while room > 0:
            size = (self.bits & ((2 << min(room, below)) - 1)).bit_length() - 1
            if size <= 0:
                break
            n = min(self.counts[size], room // size)
            total, room, below = total + n * size, room - n * size, size - 1
        return total


def pack_sizes(sizes: np.ndarray, capacities: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin, and final capacity of the bin for each of sizes, which fall and are at most the greatest capacity.

    A piece goes to the open bin with the least room that holds it. Where none does, a bin is opened, of the capacity
    whose cost (length + overhead) a token is least when the largest remaining pieces that fit fill it. At the end each
    bin gets the smallest capacity that holds its contents.
    """
    caps = sorted(capacities)
    left = _Sizes(sizes, caps[-1])
    open_bits, by_room = 0, [[] for _ in range(caps[-1] + 1)]
    used: list[int] = []
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        left.remove(size)
        fits = open_bits >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                open_bits ^= 1 << room
        else:
            _, room = min(((c + overhead) / (size + left.fill(c - size)), c) for c in caps if c >= size)
            b = len(used)
            used.append(0)
        bins[k], places[k] = b, used[b]
        used[b] += size
        room -= size
        if room:
            if not by_room[room]:
                open_bits |= 1 << room
            by_room[room].append(b)
    final = np.array(caps)[np.searchsorted(caps, np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return bins, places, final[bins] if len(sizes) else bins


def pack(
    docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD,
) -> DataFrame:
    """Where each document's tokens go: doc_id, piece, begin, size, bin_id, capacity, place.

    A document has words + 1 tokens (an end mark), or ``size``; longer ones than the greatest capacity are cut into pieces
    of that and a rest. Pieces are dealt to shards of about ``shard`` by a hash of id and text, so that shards depend on
    the rows alone and no key or group of copies fills one; each shard is packed by itself in one task, a few
    numbers a piece. Null texts have size 1, null or negative sizes count 0; a document of size 0 has one piece without a bin.
    Ids may be of any type that sorts. Rows of equal ids are packed each by itself. Other columns are ignored; an empty table gives an empty result.
    """
    most = max(capacities)
    length = n_words(F.col(f"`{text_col}`")) + 1 if size is None else F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    n = max(1, -(-docs.count() // shard))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), length.alias("total"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("hash")
    )
    pieces = rows.withColumn("piece", F.explode(F.expr(f"sequence(0, cast(greatest(total - 1, 0) div {most} as int))")))
    pieces = pieces.select(
        F.pmod(F.xxhash64("hash", "piece"), F.lit(n)).cast("int").alias("shard"), "doc_id", "piece",
        F.expr(f"cast(piece as long) * {most}").alias("begin"), F.expr(f"least(total - cast(piece as long) * {most}, {most})").alias("size"), "hash",
    )

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("hash", "ascending")])
        sizes = t.column("size").to_numpy()
        some = int((sizes > 0).sum())
        bins, places, caps = pack_sizes(sizes[:some], capacities, overhead)
        base = (t.column("shard")[0].as_py() << 32) if len(t) else 0
        none = [None] * (len(t) - some)
        return pa.table({
            "doc_id": t.column("doc_id"), "piece": t.column("piece"), "begin": t.column("begin"), "size": t.column("size"),
            "bin_id": pa.array([*(bins + base).tolist(), *none], pa.int64()), "capacity": pa.array([*caps.tolist(), *none], pa.int32()),
            "place": pa.array([*places.tolist(), *none], pa.int64()),
        })

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, begin long, size long, bin_id long, capacity int, place long"
    return pieces.groupBy("shard").applyInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
