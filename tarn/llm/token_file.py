"""Token-ID output: shards of a binary file, each a Re-Pair grammar with its rules' expansion lengths.

A shard, all numbers little-endian:

    8 bytes   magic, b"TARNRP1\\0"
    6 x u64   documents, tokens, terminals (ids below are tokens), rules, symbols, width (bits of a symbol)
    i64 x documents   document ids       u8 x documents   1 where the id is null
    u32 x documents   tokens of each document
    u32 x 2 rules     the pair that nonterminal terminals + k stands for (earlier symbols only)
    u32 x rules       how many tokens it expands to
    width x symbols   the sequence, bit-packed, first bit highest

Token i of a shard is found from the running sum of its symbols' expansion lengths; only the symbols that cover a range
are expanded.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_ranges, keyed, partitions, shared_dir, small, worker_cache
from .shared_files import create, new_file, read_range

MAGIC = b"TARNRP1\0"
HEAD, HEAD_BYTES = "<8s6Q", struct.calcsize("<8s6Q")
#: Tokens of a shard: it ends with the document that reaches them.
SHARD = 1 << 19
#: A round replaces the pairs seen at least LEAST times, and at least an EIGHTH as often as the commonest; at most PAIRS.
#: Rounds follow until no pair is seen LEAST times: a rule takes 96 bits and each use saves a symbol, so that fewer uses
#: of symbols of up to 19 bits don't pay for it.
LEAST, EIGHTH, PAIRS = 6, 8, 8192
#: Units and other words whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of text that are encoded at once (or one text).
AT_ONCE = 8 << 20
END = 1
#: Characters for which case folding and normal forms depend on nothing else: ASCII without controls, letters of Latin-1.
SIMPLE = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
#: What the vocabulary's pattern parts such characters, in lower case, into: runs of the bytes of letters or of other signs,
#: single digits (fixed pattern). Two controls, which simple text has not, are units of their own: a text's end, and the
#: place of a word that is not simple.
GAP, LETTER, SINGLE, SIGN = range(4)
TEXT_END, OTHER = b"\0", b"\1"
KIND = np.zeros(256, np.uint8)
KIND[ord("!") : 128] = SIGN
KIND[ord("0") : ord("9") + 1] = KIND[:2] = SINGLE
KIND[ord("a") : ord("z") + 1] = KIND[128:] = LETTER

#: The settings of a vocabulary file for which parting by KIND is right (fixed values); all others get whole texts.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def repair(tokens: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grammar of a sequence of ids below ``terminals``: symbols, pairs (k, 2) and expansion lengths.

    Each round counts all adjacent pairs, takes the frequent ones (most frequent first) and replaces them together; where
    chosen pairs overlap, every second one from the left. A pair that this leaves with fewer than two uses is no rule.
    After a round that took every pair seen LEAST times, only pairs with one of its symbols, and what it left of its own
    pairs, can be seen as often (other counts only fall), so that the next round counts these alone.
    """
    s, rules, lengths = tokens.astype(np.uint32), [], [np.ones(terminals, np.uint32)]
    n, places = terminals, None
    while len(s) > 1:
        left, right = (s[:-1], s[1:]) if places is None else (s.take(places), s.take(places + 1))
        # Two symbols in as few bits as hold them; the shift leaves a product's first 17 bits.
        word, half, odd, shift = (np.uint32, 16, 0x9E3779B1, 15) if n <= 1 << 16 else (np.uint64, 32, 0x9E3779B97F4A7C15, 47)
        key = left.astype(word)
        key <<= word(half)
        key |= right
        if not len(key):
            break
        ordered = np.sort(key)
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[edge, len(ordered)])
        least = max(LEAST, int(count.max()) // EIGHTH)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        complete = least == LEAST and len(often) <= PAIRS
        if len(often) > PAIRS:
            often = often[np.argsort(-count[often], kind="stable")[:PAIRS]]
        pairs = np.sort(ordered[edge[often]])
        slot = lambda k: ((k * word(odd)) >> word(shift)).astype(np.int64)  # noqa: E731,B023
        # A slot names one of its pairs; only keys that differ from it are searched for.
        table = np.full(1 << 17, -1, np.int32)
        table[slot(pairs)] = np.arange(len(pairs))
        which = table.take(slot(key))
        at = np.flatnonzero(which >= 0)
        which, found = which[at], key[at]
        missed = np.flatnonzero(pairs.take(which) != found)
        which[missed] = np.minimum(np.searchsorted(pairs, found[missed]), len(pairs) - 1)
        real = np.ones(len(at), bool)
        real[missed] = pairs.take(which[missed]) == found[missed]
        at, which = at[real], which[real]
        own = at = at if places is None else places[at]
        # Of positions in a row, the even ones.
        start = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        offset = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
        even = np.flatnonzero((offset & 1) == 0)
        at, which = at[even], which[even]
        used = np.bincount(which, minlength=len(pairs))
        number = np.cumsum(used >= 2) - 1
        ok = used[which] >= 2
        at, which = at[ok], which[ok]
        if not len(at):
            break
        chosen = pairs[used >= 2]
        left, right = (chosen >> word(half)).astype(np.uint32), (chosen & word((1 << half) - 1)).astype(np.uint32)
        rules.append(np.column_stack([left, right]))
        known = np.concatenate(lengths)
        lengths.append(known[left] + known[right])
        s[at] = n + number[which]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s.take(np.flatnonzero(keep))
        if complete:
            new = s >= n
            maybe = new[:-1] | new[1:]
            own = np.cumsum(keep)[own] - 1
            maybe[own[own < len(maybe)]] = True
            places = np.flatnonzero(maybe)
        else:
            places = None
        n += len(chosen)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return s, pairs, np.concatenate(lengths)[terminals:]


def expand(symbols: np.ndarray, pairs: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for. The rules' lengths say where each one goes, so every use of a rule is met once."""
    size = np.concatenate([np.ones(terminals, np.int64), lengths.astype(np.int64)])
    n = size[symbols]
    s, at = symbols, np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    while len(s):
        rule = s >= terminals
        out[at[~rule]] = s[~rule]
        s, at = s[rule], at[rule]
        left, right = pairs[s - terminals].T
        s, at = np.concatenate([left, right]), np.concatenate([at, at + size[left]])
    return out


def encode_shard(ids: list[int | None], counts: list[int], tokens: np.ndarray, terminals: int) -> bytes:
    symbols, pairs, lengths = repair(tokens, terminals)
    width = max(1, int(terminals + len(pairs) - 1).bit_length())
    size = -(-width // 8)
    packed = symbols.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - size :]
    if width % 8:
        packed = np.packbits(np.unpackbits(packed, axis=1)[:, -width % 8 :])
    return b"".join([
        struct.pack(HEAD, MAGIC, len(ids), len(tokens), terminals, len(pairs), len(symbols), width),
        np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(),
        np.array(counts, "<u4").tobytes(), pairs.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), packed.tobytes(),
    ])


@dataclass
class Shard:
    """A shard's parts; documents and ranges of tokens are decoded on demand."""

    ids: list[int | None]
    counts: np.ndarray
    terminals: int
    pairs: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> Shard:
        magic, docs, _, terminals, rules, symbols, width = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD_BYTES

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
        pairs, lengths = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        size = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, offset=at)
        if width % 8:
            bits = np.zeros((symbols, 8 * size), np.uint8)
            bits[:, -width % 8 :] = np.unpackbits(packed, count=symbols * width).reshape(symbols, width)
            packed = np.packbits(bits, axis=1)
        whole = np.zeros((symbols, 4), np.uint8)
        whole[:, 4 - size :] = packed.reshape(symbols, size)
        s = whole.view(">u4").ravel().astype(np.uint32)
        return cls([None if z else int(i) for i, z in zip(ids, null, strict=True)], counts, terminals, pairs, lengths, s)

    def ends(self) -> np.ndarray:
        """The running sum of the symbols' expansion lengths."""
        one = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.terminals
        one[rule] = self.lengths[self.symbols[rule] - self.terminals]
        return np.cumsum(one)

    def tokens(self, low: int, high: int, ends: np.ndarray | None = None) -> np.ndarray:
        """Tokens low to high - 1, from the symbols that cover them alone."""
        ends = self.ends() if ends is None else ends
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
        skip = low - (int(ends[a - 1]) if a else 0)
        return expand(self.symbols[a:b], self.pairs, self.lengths, self.terminals)[skip : skip + high - low]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, place in the shard, and token ids."""
        everything, at = expand(self.symbols, self.pairs, self.lengths, self.terminals), 0
        for i, n in zip(self.ids, self.counts.tolist(), strict=True):
            yield i, at, everything[at : at + n]
            at += n


def _units(data: np.ndarray) -> pa.BinaryArray:
    """The units of simple text in lower case, whose last byte is TEXT_END."""
    kind = KIND.take(data)
    start = np.empty(len(data), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == SINGLE
    # 's, 't, 'm, 'd, 're, 've and 'll are units where the apostrophe is no part of a longer run of signs.
    at = np.flatnonzero(data == ord("'"))
    at = at[(kind[at - 1] != SIGN) & (kind[at + 1] == LETTER)]
    one, two = data[at + 1], data[at + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = start[at[long] + 3] = True
    there = kind != GAP
    data = data[there]
    offsets = np.append(np.flatnonzero(start[there]), len(data)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class WordEncoder:
    """Ids of whole texts, unit by unit: no token of this kind of vocabulary spans the units of its pattern.

    A vocabulary file with other settings gets each text whole, by the library's own encoding.

    Simple text is parted into units, many texts at once; each distinct unit is looked up once, and a new one goes to the
    vocabulary's own model. Other text goes to the tokenizer as it is, word by word (its pattern drops white space and
    never matches across it). Ids are remembered: one number for each unit or word, the place of its ids.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(model)
        known = file.get("normalizer") == NORMALIZER and file.get("pre_tokenizer") == PRE_TOKENIZER
        self.parted = known and all("<|" in t["content"] for t in file.get("added_tokens") or [])
        self.terminals = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        # The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.units: dict[bytes, int] = {}
        self.words: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.units.clear(), self.words.clear()
        # The ids of entry k are ids[edges[k] : edges[k + 1]]; entry 0 is a text's end, 1 the place of another word.
        self.ids, self.edges = array("I", [END]), array("q", [0, 1, 1])
        self.units |= {TEXT_END: 0, OTHER: 1}

    @classmethod
    def of(cls, model: str) -> WordEncoder:
        """The worker's own encoder of this vocabulary, with what it has learned in earlier tasks."""
        key = f"encoder-{zlib.crc32(model.encode())}"
        cache = worker_cache()
        if key not in cache:
            cache[key] = cls(model)
        return cache[key]

    def _add(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.edges.append(len(self.ids))
        return len(self.edges) - 2

    def _unit(self, unit: bytes) -> int:
        shown = unit.decode() if unit.isascii() else "".join([self.byte_chars[b] for b in unit])
        entry = self.units[unit] = self._add([t.id for t in self.model.tokenize(shown)])
        return entry

    def _other(self, word: str) -> int:
        entry = self.words.get(word)
        if entry is None:
            entry = self.words[word] = self._add(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return entry

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text and END."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and END."""
        if not self.parted:
            return [np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END], "<u4") for t in texts]
        if not texts:
            return []
        if len(self.edges) > REMEMBERED or len(self.words) > REMEMBERED // 4:
            self._forget()
        simple, others = [], []
        for text in texts:
            if "<|" in text or not SIMPLE.fullmatch(text):
                words = text.replace("\n", " ").split(" ")
                for k, word in enumerate(words):
                    if "<|" in word or not SIMPLE.fullmatch(word):
                        words[k] = OTHER.decode()
                        others.append(self._other(word))
                text = " ".join(words)
            simple.append(text)
        end = TEXT_END.decode()
        units = _units(np.frombuffer((end.join(simple) + end).lower().encode(), np.uint8)).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.units.get, distinct))
        for k in [k for k, at in enumerate(found) if at is None]:
            found[k] = self._unit(distinct[k])
        entry = np.array(found, np.int64).take(units.indices.to_numpy())
        closes = entry == 0
        if others:
            entry[entry == 1] = others
        edges = np.frombuffer(self.edges, np.int64)
        first = edges.take(entry)
        count = edges.take(entry + 1) - first
        stop = np.cumsum(count)
        place = np.repeat(first - stop + count, count)
        place += np.arange(len(place))
        ids = np.frombuffer(self.ids, np.uint32).take(place).astype("<u4", copy=False)
        return np.split(ids, stop[closes][:-1])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """A batch's ids and texts (null: empty), AT_ONCE bytes of text or one row at a time."""
    begin = held = 0
    for k, n in enumerate([*pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 0]):
        if k == batch.num_rows or k > begin and held + n > AT_ONCE:
            ids, texts = (batch.column(c).slice(begin, k - begin) for c in (0, 1))
            yield ids.to_pylist(), pc.fill_null(texts, "").to_numpy(zero_copy_only=False).tolist()
            begin, held = k, 0
        held += n


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write the ids in ascending order of the (whole-number) id; returns the manifest.

    A null text is empty: the end id alone. A null id comes first; rows of equal ids are ordered by text. An empty table
    writes no file. Other columns are ignored. ``tokenizer`` is the vocabulary file's path on the driver; its content
    goes to the tasks.

    The manifest, a table in the shared folder, has for each shard: part (number of the range of ids), nth, path, offset,
    bytes, docs, tokens, and before (the part's tokens before it).
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    model = Path(tokenizer).read_text(encoding="utf-8")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, rows = None, None, []
        ids, counts, parts, size = [], [], [], 0
        at = before = 0

        def flush() -> None:
            nonlocal at, before, out, size
            if out is None:
                rows.append((new_file(folder, "part", ".tok"),))
                out = create(rows[0][0])
            data = encode_shard(ids, counts, np.concatenate(parts), encoder.terminals)
            out.write(data)
            rows.append((at, len(data), len(ids), size, before))
            at, before, size = at + len(data), before + size, 0
            ids.clear(), counts.clear(), parts.clear()

        part = 0
        for batch in batches:
            encoder = encoder or WordEncoder.of(model)
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for some, texts in _slices(batch):
                for i, tokens in zip(some, encoder.encode_all(texts), strict=True):
                    ids.append(i), counts.append(len(tokens)), parts.append(tokens)
                    size += len(tokens)
                    if size >= SHARD:
                        flush()
        if ids:
            flush()
        if out is not None:
            out.close()
            (path,), *shards = rows
            yield pa.RecordBatch.from_pylist([
                {"part": part, "nth": k, "path": path, "offset": o, "bytes": b, "docs": d, "tokens": t, "before": f}
                for k, (o, b, d, t, f) in enumerate(shards)
            ], schema=MANIFEST)

    rows = in_ranges(keyed(docs, doc_id=id_col, text=text_col), "doc_id", partitions(spark), "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    names = "part int, nth int, path string, offset long, bytes long, docs long, tokens long, before long"
    return cut(rows.mapInArrow(write, names), "token-manifest")


MANIFEST = pa.schema([
    ("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("offset", pa.int64()),
    ("bytes", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("before", pa.int64()),
])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (the ids of all documents before it) and ids of each document in the files that a manifest names."""
    return _read(manifest, lambda i, start, t: {"doc_id": i, "start": start, "ids": t.astype(np.int64)}, "doc_id long, start long, ids array<long>")


def token_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files that a manifest names."""
    return _read(
        manifest,
        lambda i, start, t: {"doc_id": i, "start": start, "n_tokens": len(t), "ids_crc32": zlib.crc32(t.astype("<u4").tobytes())},
        "doc_id long, start long, n_tokens long, ids_crc32 long",
    )


def _read(manifest: DataFrame, row, schema: str) -> DataFrame:
    spark = manifest.sparkSession
    # On the driver: one number for each range of ids.
    parts = sorted(map(tuple, manifest.groupBy("part").agg(F.sum("tokens"), F.count(F.lit(1))).collect()))
    base, total, shards = {}, 0, 0
    for part, tokens, n in parts:
        base[part], total, shards = total, total + tokens, shards + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for r in batch.to_pylist():
                shard = Shard.parse(read_range(r["path"], r["offset"], r["bytes"]))
                start = base[r["part"]] + r["before"]
                rows, held = [], 0
                for i, at, t in shard.documents():
                    rows.append(row(i, start + at, t))
                    held += len(t)
                    if held >= SHARD // 4:
                        yield pa.RecordBatch.from_pylist(rows)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    spread = manifest.repartition(max(1, min(partitions(spark), shards)))
    return spread.mapInArrow(read, schema)


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digests(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))
