"""Language ID by string kernels: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest ridge regression."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, keyed, sample_by_class, small

#: Slots of the presence vector for byte n-grams of length 1, 2, 3 and 4; longer spectra share slots by hash.
SLOTS = (256, 4096, 8192, 4096)
WIDTH = sum(SLOTS)
#: Bounds of what is learned from, a language: documents and, of those, landmarks.
SAMPLE, LANDMARKS = 400, 24
RIDGE = 1e-3
#: Documents scored by one matrix product.
TOGETHER = 64
LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters becomes a space; bytes of longer UTF-8 sequences stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Odd multiplier of the n-gram hash (fixed value).
_MIX = np.uint32(2654435761)


def presence(text: str, into: np.ndarray) -> None:
    """Set the slots of text's n-grams (of its lower-case UTF-8) in a vector of zeros of length WIDTH."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN), np.uint8).astype(np.uint32)
    code, base = b, 0
    for n, slots in enumerate(SLOTS, 1):
        if n > len(b):
            break
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        # The product's highest bits depend on all bytes of an n-gram; slots is a power of two.
        into[base + (code if slots == 256 else (code * _MIX) >> np.uint32(33 - slots.bit_length()))] = 1
        base += slots


@dataclass(frozen=True)
class KernelModel:
    """classes; landmarks as packed presence bits; for each landmark its weight in each class's regression."""

    classes: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray

    @staticmethod
    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Shared n-grams over the geometric mean of both counts; 0 where there are none."""
        norm = np.sqrt(np.maximum(1, x.sum(1, dtype=np.float32)))[:, None] * np.sqrt(np.maximum(1, y.sum(1, dtype=np.float32)))[None]
        return (x @ y.T) / norm

    @classmethod
    def fit(cls, bits: list[bytes], labels: list[str]) -> KernelModel:
        """bits: packed presence vectors of the sample; the first LANDMARKS of each class are its landmarks."""
        classes = tuple(sorted(set(labels)))
        if not classes:
            return cls((), np.zeros((0, WIDTH // 8), np.uint8), np.zeros((0, 0), np.float32))
        packed = np.stack([np.frombuffer(b, np.uint8) for b in bits])
        x = np.unpackbits(packed, axis=1)[:, :WIDTH].astype(np.float32)
        y = np.array(labels)
        picked = np.concatenate([np.flatnonzero(y == c)[:LANDMARKS] for c in classes])
        mm = cls.kernel(x[picked], x[picked]).astype(np.float64)
        values, vectors = np.linalg.eigh(mm)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = cls.kernel(x, x[picked]) @ root
        target = np.where(y[:, None] == np.array(classes)[None], 1.0, -1.0)
        # Each class's rows weigh the same in sum, however many there are.
        row = np.array([1 / (y == c).sum() for c in classes])[np.searchsorted(classes, y)][:, None]
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        gram = phi1.T @ (row * phi1) + RIDGE * np.eye(phi1.shape[1])
        w = np.linalg.solve(gram, phi1.T @ (row * target))
        return cls(classes, packed[picked], np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32))

    def scorer(self):
        landmarks = np.unpackbits(self.landmarks, axis=1)[:, :WIDTH].astype(np.float32)

        def score(x: np.ndarray) -> np.ndarray:
            return self.kernel(x, landmarks) @ self.weights[:-1] + self.weights[-1]

        return score


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        bits = []
        for text in batch.column("text").to_pylist():
            one = np.zeros(WIDTH, np.uint8)
            presence(text or "", one)
            bits.append(np.packbits(one).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(bits, pa.binary())], names=["lang", "bits"])


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> KernelModel:
    """Learn from at most ``sample`` rows a language outside the held-out fold (and with a language and a letter).

    Whole texts are read; only their presence bits, WIDTH / 8 bytes a row, come to the driver.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col, lang=lang_col).filter(~held_out()).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    few = sample_by_class(rows.select("doc_id", "lang"), "lang", "doc_id", sample).select("doc_id", "lang")
    few = {(r[0], r[1]) for r in few.collect()}
    ids = [i for i, _ in few]
    # Bounded: sample ids a language.
    got = rows.filter(F.col("doc_id").isin(ids)).select("lang", "text").mapInArrow(_packed, "lang string, bits binary").collect() if ids else []
    got = sorted(((r[0], bytes(r[1])) for r in got), key=lambda r: (zlib.crc32(r[1]), r))
    return KernelModel.fit([b for _, b in got], [c for c, _ in got])


def annotate(docs: DataFrame, model: KernelModel, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs, all columns, with each whole text's language and the score (0 to 1) of that language's regression.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to the first class in
    code point order. The two new names must not be taken.
    """
    if taken := {lang_as, score_as} & set(docs.columns):
        raise ValueError(f"docs has columns of these names: {sorted(taken)}")
    place = docs.columns.index(text_col)
    names = [*docs.columns, lang_as, score_as]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer() if model.classes else None
        x = np.zeros((TOGETHER, WIDTH), np.float32)
        for batch in small(batches):
            texts = batch.column(place).to_pylist()
            lang, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if score and t and LETTER.search(t)]
            for k in range(0, len(known), TOGETHER):
                part = known[k : k + TOGETHER]
                x[:] = 0
                for row, i in enumerate(part):
                    presence(texts[i], x[row])
                out = score(x[: len(part)])
                best = out.argmax(1)
                for row, i in enumerate(part):
                    lang[i] = model.classes[best[row]]
                    scores[i] = float(min(1.0, max(0.0, (out[row, best[row]] + 1) / 2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(scores, pa.float64())], names=names)

    # A name with a dot in it is nothing that mapInArrow takes.
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())]))


def identify(docs: DataFrame, model: KernelModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (see annotate()); other columns are ignored."""
    rows = keyed(docs, doc_id=id_col, text=text_col).select("doc_id", held_out().alias("held_out"), "text")
    return annotate(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_language_model(docs))
