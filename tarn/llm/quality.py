"""Quality by compression: Zstandard dictionaries of good and of bad text, and how much better one compresses than the other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, keyed, sample_by_class, small

#: Labelled documents of a class that are learned from at most: DICTIONARY for its dictionary, CALIBRATION for the score.
DICTIONARY, CALIBRATION = 1_500, 1_500
DICT_BYTES, LEVEL = 112_640, 3
#: Bytes of a training sample; long texts are cut into several, none is left out.
PIECE = 2_000
#: At or above this a document counts as good.
THRESHOLD = 0.3
RIDGE = 1e-4


def _features(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """The difference of both compressed sizes, normalised by the text's bytes and by the larger; the smaller a byte, as log."""
    data = (text or "").encode("utf-8", "surrogatepass")
    g, b = len(good.compress(data)), len(bad.compress(data))
    return (g - b) / (len(data) + 1), (g - b) / max(g, b), float(np.log(min(g, b) / (len(data) + 1)))


@dataclass(frozen=True)
class CompressionModel:
    """Both dictionaries and the logistic calibration; no dictionary: every score is ``prior``."""

    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def one(data: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        return one(self.good), one(self.bad)

    @staticmethod
    def terms(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -8, 8)
        pairs = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
        return np.column_stack([np.ones(len(z)), z, *pairs])

    def score(self, x: np.ndarray) -> np.ndarray:
        t = self.terms(x, np.array(self.mean), np.array(self.scale)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(t, -30, 30)))

    def calibrated(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> CompressionModel:
        """With a logistic regression of label y on features x, by Newton steps halved until the loss falls."""
        mean, scale = x.mean(0), x.std(0) + 1e-9
        t = self.terms(x, mean, scale)
        ridge = RIDGE * np.r_[0, np.ones(t.shape[1] - 1)]

        def loss(w: np.ndarray) -> float:
            return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (t @ w))).sum() + len(y) * (ridge * w * w).sum() / 2)

        w, last = np.zeros(t.shape[1]), np.inf
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
            hessian = (t * (weight * p * (1 - p) + 1e-9)[:, None]).T @ t + len(y) * np.diag(ridge + 1e-9)
            step = np.linalg.solve(hessian, t.T @ (weight * (p - y)) + len(y) * ridge * w)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w, before, last = w - step, last, loss(w - step)
            if before - last < 1e-9:
                break
        return CompressionModel(self.good, self.bad, tuple(mean), tuple(scale), tuple(w), self.prior)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or, of too little text for training, the text itself as a raw one."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [d[i : i + PIECE] for d in data for i in range(0, len(d), PIECE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(data)[-DICT_BYTES:]


def fit_quality_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    dictionary: int = DICTIONARY, calibration: int = CALIBRATION,
) -> CompressionModel:
    """Learn from labelled rows outside the held-out fold: ``dictionary`` + ``calibration`` documents a class at most.

    Documents with null, other or contradictory labels are left out. With one class only every score is that class.
    """
    known = keyed(labels, doc_id=id_col, label=label_col).filter("label in (0, 1) and doc_id is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_high")).filter("label = _high").drop("_high")
    few = sorted((r[0], r[1]) for r in sample_by_class(known, "label", "doc_id", dictionary + calibration).collect())
    of = dict(few)
    classes = set(of.values())
    if len(classes) < 2:
        return CompressionModel(prior=float(classes.pop()) if classes else 0.5)
    for_dictionary, nth = {}, {0: 0, 1: 0}
    for i, label in few:
        nth[label] += 1
        share = dictionary / (dictionary + calibration)
        if int(nth[label] * share) > int((nth[label] - 1) * share):
            for_dictionary[i] = label
    rows = keyed(docs, doc_id=id_col, text=text_col)
    got = rows.filter(F.col("doc_id").isin(list(for_dictionary))).collect()
    texts = {c: sorted(r[1] or "" for r in got if of[r[0]] == c) for c in (0, 1)}
    model = CompressionModel(_dictionary(texts[1]), _dictionary(texts[0]))
    rest = [i for i in of if i not in for_dictionary]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors()
        for batch in small(batches):
            x = [_features(t, *both) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(map(tuple, rows.filter(F.col("doc_id").isin(rest)).mapInArrow(measured, f"doc_id {kind}, x array<double>").collect()))
    y = np.array([of[i] for i, _ in got])
    if len(set(y.tolist())) < 2:
        return CompressionModel(prior=0.5)
    return model.calibrated(np.array([x for _, x in got]), y, np.ones(len(y)))


def score_quality(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Each whole document's score (0 to 1, higher: likelier good) and predicted (1 from ``threshold`` on).

    A null text counts as empty; an empty text has the score that the two empty frames give. One row for each row of
    docs, equal texts with equal scores; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors() if model.weights else None
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            if both and texts:
                scores = model.score(np.array([_features(t, *both) for t in texts]))
            else:
                scores = np.full(len(texts), model.prior)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = keyed(docs, doc_id=id_col, text=text_col).select("doc_id", held_out().alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, fit_quality_model(docs, labels))
