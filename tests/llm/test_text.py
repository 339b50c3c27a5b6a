"""Fingerprints, quality, language."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import fingerprint as fp
from tarn.llm import language_id as lid
from tarn.llm.language_id import KernelModel, annotate, fit_language_model, identify
from tarn.llm.quality import CompressionModel, fit_quality_model, score_quality

from .helpers import ODD, clashing, documents, prose, with_repeats


def brute_features(text: bytes, ranks: np.ndarray) -> list[int]:
    """Starts of selected features, by definition."""
    n = len(text) - fp.FEATURE + 1
    level = [(fp._MOST - sum(int(fp._F[c]) for c in Counter(text[i : i + fp.FEATURE]).values())) * fp.LEVELS // (fp._MOST + 1) for i in range(n)]
    rank = [int(ranks[x]) for x in level]
    wins = Counter()
    for a in range(-fp.AROUND + 1, n):
        around = [(rank[i], i) for i in range(max(0, a), min(n, a + fp.AROUND)) if rank[i] < fp.NONE]
        if around:
            wins[min(around)[1]] += 1
    return sorted(i for i, k in wins.items() if k >= fp.WINS)


def test_features_against_brute_force(monkeypatch):
    texts = [prose(i, 80).encode() for i in range(4)] + [b"a" * 300, b"der " * 100]
    ranks = fp.ranks_of(fp.level_counts(texts))
    want = []
    for t in texts:
        at = np.array(brute_features(t, ranks), np.int64)
        want.append(fp._hashes(np.frombuffer(t, np.uint8), at).tolist() or np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), "<u8").tolist())
    assert [f.tolist() for f in fp.features(texts, ranks)] == want
    monkeypatch.setattr(fp, "BLOCK", 200)  # now most texts are worked on in blocks
    assert [f.tolist() for f in fp.features(texts, ranks)] == want
    assert (fp.ranks_of(fp.level_counts(texts)) == ranks).all()


def test_likeness():
    texts = [prose(i, 400).encode() for i in range(2)]
    ranks = fp.ranks_of(fp.level_counts(texts))
    a, b = (fp.filters(f) for f in fp.features(texts, ranks))
    third = len(texts[0]) // 3
    (c,) = (fp.filters(f) for f in fp.features([texts[0][:-third] + texts[1][:third]], ranks))
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) < 0.05 and 0.4 < fp.likeness(a, c) < 0.85
    assert fp.likeness(a, c) == fp.likeness(c, a) and (fp.from_text(fp.as_text(a)) == a).all()
    empty = fp.filters(np.zeros(0, np.uint64))
    assert fp.likeness(empty, empty) == 1 and fp.likeness(a, empty) == 0


def test_compare_edits(spark):
    texts = ODD + [prose(i % 7, 10 + i * 3) for i in range(40)]
    df = clashing(spark, texts).repartition(5)
    ranks = fp.rarity(df)
    got = sorted(fp.compare_edits(df, ranks).collect(), key=lambda r: -r["doc_id"])
    alone = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(df, ranks).collect()}
    order = [(i, t or "") for i, t in reversed(list(enumerate(texts)))]
    for k, ((i, t), r) in enumerate(zip(order, got, strict=True)):
        following = order[(k + 1) % len(order)]
        edited = t[: len(t) - len(t) // 3] + following[1][: len(t) // 3]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other = fp.from_text(r["fingerprint"]), fp.from_text(alone[following[0]])
        assert r["fingerprint"] == alone[i] and abs(r["near_next"] - fp.likeness(own, other)) < 1e-12
    assert len({r["fingerprint"] for r in got}) == len({t or "" for t in texts})
    again = sorted(fp.compare_edits(df.repartition(2), ranks).collect(), key=lambda r: -r["doc_id"])
    assert again == got


def test_compare_edits_edges(spark):
    df = documents(spark, ["abc"])
    ranks = fp.rarity(df)
    assert fp.compare_edits(df, ranks).first()["near_next"] == 1
    assert fp.compare_edits(df.limit(0), ranks).collect() == []
    assert len(fp.compare_edits(with_repeats(documents(spark, ["a", "b"])), ranks).collect()) == 5


SOUNDS = {"aa": ["le", "que", "ment", "eau"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["th", "ing", "and", "er"]}


def in_language(lang: str, seed: int, n: int = 60) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SOUNDS[lang], k=r.randint(1, 3))) for _ in range(n))


def test_language(spark):
    langs = [list(SOUNDS)[i % 3] for i in range(240)]
    texts = [in_language(x, i, 3 + i % 50) for i, x in enumerate(langs)]
    df = documents(spark, texts + ODD, lang=langs + ["aa"] * len(ODD))
    model = fit_language_model(df)
    got = {r["doc_id"]: r for r in identify(df, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(240))
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.95 * len(held)
    assert all(got[240 + k]["lang_pred"] == "und" and got[240 + k]["score"] == 0 for k in (0, 1, 2, 8))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # What is held out has no say.
    other = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    assert fit_language_model(other).classes == model.classes
    assert sorted(map(str, identify(other, fit_language_model(other)).collect())) == sorted(map(str, got.values()))


def test_all_bytes_of_an_n_gram_count():
    """n-grams that differ in one byte only, whichever it is, spread over the slots."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert all(s & (s - 1) == 0 for s in lid.SLOTS)
    for n in (2, 3, 4):
        for at in range(n):
            for rest in ("hen", "ion"):
                seen = set()
                for c in letters:
                    into = np.zeros(lid.WIDTH, np.uint8)
                    lid.presence((rest[:at] + c + rest[at:])[:n], into)
                    base = sum(lid.SLOTS[: n - 1])
                    (slot,) = np.flatnonzero(into[base : base + lid.SLOTS[n - 1]])
                    seen.add(int(slot))
                assert len(seen) >= 24, (n, at, rest)


def test_language_edges(spark):
    df = documents(spark, ODD, lang=[None] * len(ODD))
    nothing = fit_language_model(df)
    assert nothing.classes == () and {r["lang_pred"] for r in identify(df, nothing).collect()} == {"und"}
    assert identify(df.limit(0), nothing).collect() == [] and len(identify(with_repeats(df), nothing).collect()) == len(ODD) + 3
    assert annotate(df, nothing).columns == [*df.columns, "lang_pred", "score"]
    x = np.eye(4, dtype=np.float32)
    assert np.allclose(KernelModel.kernel(x, x), x)


def labelled(spark, n=500):
    texts = [prose(i, 40) if i % 4 else (" | ".join(prose(i, 40).upper().split()) + "!!") for i in range(n)]
    docs = documents(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in score_quality(docs, fit_quality_model(docs, labels)).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == int(i % 4 > 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.values())
    assert len(got) == docs.count()
    # What is held out has no say, nor have null, odd and contradictory labels.
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    noise = spark.createDataFrame([(500, None, 0), (501, 7, 0), (502, 0, 0), (502, 1, 0), (None, 1, 0)], labels.schema)
    assert fit_quality_model(docs, wrong.unionByName(noise)) == fit_quality_model(docs, labels)


def test_quality_edges(spark):
    docs, labels = labelled(spark, 12)
    assert fit_quality_model(docs, labels.limit(0)) == CompressionModel(prior=0.5)
    ones = fit_quality_model(docs, labels.filter("quality = 1"))
    assert {(r["score"], r["predicted"]) for r in score_quality(docs, ones).collect()} == {(1.0, 1)}
    assert score_quality(docs.limit(0), ones).collect() == [] and len(score_quality(with_repeats(docs), ones).collect()) == docs.count() + 3
