"""Near duplicates, components, repeated passages, and the pipeline."""

from __future__ import annotations

import gc
import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import jaccard as jc
from tarn.llm import substring_dedup as sd
from tarn.llm.common import SWEPT, cut
from tarn.llm.components import components
from tarn.llm.fm_index import FMIndex, repeated_span
from tarn.llm.mixing import targets

from .helpers import ODD, clashing, documents, prose, with_repeats


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"edit{r.random()}" if r.random() < share else w for w in text.split())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingles(t, width):
    w = words(t)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_classes(texts, width, num, den):
    sets = [shingles(t, width) for t in texts]
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


def corpus():
    """Groups of near copies around the threshold, chains, copies, short texts, a shared passage."""
    texts = list(ODD)
    for g in range(12):
        base = prose(g, 20 + 25 * g)
        texts += [base, base.upper(), *(edited(base, k, 0.004 * (k + 1)) for k in range(6))]
    chain = prose(99, 300).split()
    for _ in range(8):
        chain = chain[6:] + prose(len(texts), 6).split()
        texts.append(" ".join(chain))
    passage = prose(98, 40)
    texts += [f"{prose(200 + i, 30)} {passage} {prose(300 + i, 30)}" for i in range(10)]
    texts += [" ".join("abcdefghijklmnop"[i : i + 10]) for i in range(5)]
    return texts


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 60)])
def test_classes_against_brute_force(spark, width, num):
    texts = corpus()
    got = sorted(tuple(r) for r in jc.jaccard_classes(clashing(spark, texts), width, num, 100).collect())
    assert got == brute_classes(texts, width, num, 100)


def test_late_rounds_find_what_stars_miss(spark, monkeypatch):
    """With every signature equal, all sets are one bucket: only the rounds can link them."""
    monkeypatch.setattr(jc, "signatures", lambda h, scheme, number: np.array([number], np.uint64))
    texts = [t for g in range(6) for t in (prose(g, 60), edited(prose(g, 60), 1, 0.01), edited(prose(g, 60), 2, 0.01))]
    got = sorted(tuple(r) for r in jc.jaccard_classes(documents(spark, texts), 3, 80, 100).collect())
    assert got == brute_classes(texts, 3, 80, 100)


def test_class_edges(spark):
    df = documents(spark, ["a b c d", "e"])
    assert jc.jaccard_classes(df.limit(0)).collect() == []
    got = jc.jaccard_classes(with_repeats(df)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in got) == [(-1, 0), (-1, 0), (0, 0), (0, 0), (1, 1)]
    kept = jc.one_of_each_class(documents(spark, corpus()))
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_classes(corpus(), 5, 80, 100)}


def linked_sets(n, data, num, den):
    """Two random sets, linked or nearly."""
    r = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    most = len(a) * (den - num) // num
    cut, more = sorted((r.integers(0, most + 1), r.integers(0, most + 1)))
    b = np.unique(np.concatenate([r.permutation(a)[cut:], r.integers(0, 2**64, more - cut, dtype=np.uint64)]))
    return r, a, b


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.data(), st.sampled_from([(90, 100), (80, 100), (60, 100), (95, 100)]), st.floats(0, 0.5), st.integers(1, 3))
def test_linked_sets_share_a_signature(n, data, threshold, share, turns):
    """The pigeonhole: whatever the allocation and the segments' order, and wherever it stops, no link is lost."""
    num, den = threshold
    r, a, b = linked_sets(n, data, num, den)
    common = len(np.intersect1d(a, b))
    if not len(b) or not jc.similar(common, len(a) + len(b) - common, num, den):
        return
    schemes = jc.Schemes(num, den)
    for k in {schemes.band(len(s)) - i for s in (a, b) for i in (0, 1)}:
        if k >= 0:
            low, high = (int(x) for x in schemes.edges[k : k + 2])
            scheme = jc.Scheme(num, den, low, high, int(share * high))
            scheme.double = r.permutation(scheme.double)
            scheme.arrange(r.permutation(scheme.segments))
            schemes.own[k] = scheme
    before, jc.TURNS = jc.TURNS, turns
    try:
        assert set(schemes.signatures(a).tolist()) & set(schemes.signatures(b).tolist())
    finally:
        jc.TURNS = before


@pytest.mark.parametrize("num", [90, 80, 60])
def test_unrelated_sets_hardly_meet(num):
    """Candidates of random sets of many sizes grow no faster than the sets do."""
    r = np.random.default_rng(num)
    sets = [np.unique(r.integers(0, 2**64, int(n), dtype=np.uint64)) for n in r.integers(4, 400, 6000)]
    schemes = jc.Schemes(num, 100)
    met = []
    for some in (sets[:2000], sets):
        sigs, n = np.unique(np.concatenate([schemes.signatures(h) for h in some]), return_counts=True)
        met.append(int((n * (n - 1) // 2).sum()))
    assert met[1] <= 3 * met[0] + 60


def test_allocation_turns_to_deletions_with_more_rows():
    """Few sets: whole segments, which are fewer signatures; very many that share tokens: some up to a deletion."""
    r = np.random.default_rng(3)
    common = r.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(common)[:120], r.integers(0, 2**64, 180, dtype=np.uint64)])) for _ in range(300)]
    sample = [(len(h), h) for h in sets]
    counts = [sum(s.doubles for s in jc.plan_schemes(90, 100, sample, rows).own.values()) for rows in (300, 3_000_000_000)]
    assert counts[0] < counts[1]


def test_crowded_segments_come_last():
    r = np.random.default_rng(4)
    crowd = np.sort(r.integers(2**60, 2**60 + 2**56, 30, dtype=np.uint64))
    sets = [np.unique(np.concatenate([crowd, r.integers(2**62, 2**64 - 1, 270, dtype=np.uint64)])) for _ in range(100)]
    schemes = jc.plan_schemes(80, 100, [(len(h), h) for h in sets], 1_000_000)
    scheme = schemes.of(schemes.band(len(sets[0])))
    full = int(jc._segment(crowd[:1], scheme.segments)[0])
    assert scheme.place[full] >= scheme.segments - 3


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_sketches_differ_in_no_more_bits_than_sets(both, a, b):
    x, y = (np.array(sorted(both | s), np.uint64) for s in (a, b))
    differ = int(np.bitwise_count((jc._sketch(x) ^ jc._sketch(y)).view(np.uint64)).sum())
    assert differ <= len((both | a) ^ (both | b))


def test_sketches_rule_out_by_bits_with_the_highest_set(spark):
    """In Spark too, each bit counts once, the sign bit among them."""
    rows = []
    for k, bits in enumerate([(0, 0), (-1, -1), (-(2**63), -(2**63)), (2**63 - 1, 0)]):
        rows.append((k, 100, *[bits[i % 2] for i in range(8)]))
    df = spark.createDataFrame(rows, "node long, n_shingles long, " + ", ".join(f"{c} long" for c in jc._SKETCH))
    met = df.alias("a").join(df.alias("b"), jc._may_link("a", "b", 80, 100)).select("a.node", "b.node").collect()
    number = lambda r: [x & (2**64 - 1) for x in r[2:]]
    want = {(x[0], y[0]) for x in rows for y in rows if sum((p ^ q).bit_count() for p, q in zip(number(x), number(y), strict=True)) * 180 <= 200 * 20}
    assert {tuple(r) for r in met} == want and 4 < len(want) < 16


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2000), st.integers(0, 2000), st.integers(0, 2000), st.integers(0, 10**6), st.sampled_from([1, 50, 80, 99]))
def test_long_sketches_differ_in_no_more_bits_than_sets(both, a, b, seed, num):
    drawn = np.unique(np.random.default_rng(seed).integers(0, 2**64, both + a + b, dtype=np.uint64))
    drawn = np.random.default_rng(seed).permutation(drawn)
    x, y = np.sort(drawn[: both + a]), np.sort(np.r_[drawn[:both], drawn[both + a :]])
    p, q = jc.long_sketch(x, num, 100), jc.long_sketch(y, num, 100)
    if p and q:
        assert jc.differing(p, q) == jc.differing(q, p) <= len(np.setxor1d(x, y))


def test_texts_of_long_unlinked_sets_are_not_sent(spark, monkeypatch):
    """With every signature equal, all sets meet; only linked ones may come to where pairs carry texts."""
    monkeypatch.setattr(jc, "signatures", lambda h, scheme, number: np.array([number], np.uint64))
    sent, linked = [], jc._linked
    monkeypatch.setattr(jc, "_linked", lambda pairs, *a: sent.extend(tuple(r) for r in pairs.collect()) or linked(pairs, *a))
    texts = [prose(g, 3000) for g in range(8)] + [edited(prose(g, 3000), g, 0.002) for g in range(4)]
    got = sorted(tuple(r) for r in jc.jaccard_classes(documents(spark, texts), 5, 80, 100).collect())
    assert got == brute_classes(texts, 5, 80, 100)
    assert len({c for _, _, c in got}) == 8 and len(sent) == 4


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}


def test_a_cut_leaves_no_shuffle_files(spark):
    gc.collect()
    before, setting = shuffle_files(spark), spark.conf.get(SWEPT)
    table = cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(SWEPT) == setting
    assert sorted(tuple(r) for r in table.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 5)), max_size=40), st.integers(1, 7))
def test_streamed_buckets(offers, step):
    """However the stream is cut into batches: second nodes of pairs, all nodes of larger buckets, each once."""
    import pyarrow as pa

    class Frame:
        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, schema):
            s = sorted(offers)
            batches = [pa.table({"sig": pa.array([x for x, _ in s[i : i + step]], pa.int64()), "node": pa.array([y for _, y in s[i : i + step]], pa.int64())}) for i in range(0, len(s), step)]
            return [tuple(r.values()) for t in run(b.combine_chunks().to_batches()[0] for b in batches) for r in t.to_pylist()]

    buckets = {}
    for sig, node in set(offers):
        buckets.setdefault(sig, set()).add(node)
    want = [(sig, min(b), n, True) for sig, b in buckets.items() if len(b) > 2 for n in b]
    want += [(0, min(b), max(b), False) for b in buckets.values() if len(b) == 2]
    assert sorted(jc._met(Frame())) == sorted(want)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)] + [(-5, 300), (7, 7)]
    least = {}
    for _ in range(300):
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least.get(u, u), least.get(v, v))
    got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == least


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_counts(sequences, pattern):
    index = FMIndex([np.array(s) for s in sequences], max(map(len, sequences)))
    low, high = np.zeros(1, np.int64), np.array([index.n])
    for c in reversed(pattern):
        if c >= len(index.first) - 1:
            low, high = np.zeros(1), np.zeros(1)
            break
        low, high = index.extend(np.array([c]), low, high)
    want = sum(s[i : i + len(pattern)] == pattern for s in sequences for i in range(len(s)))
    assert max(0, int(high[0] - low[0])) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), min_size=1, max_size=9), min_size=1, max_size=8))
def test_spans_are_of_repeated_windows(sequences):
    window = 5
    count = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    s = [np.array(x) for x in sequences]
    low, high = repeated_span(FMIndex(s, 9), s, window)
    for x, a, b in zip(sequences, low, high, strict=True):
        hits = [i for i in range(len(x) - window + 1) if count[tuple(x[i : i + window])] > 1]
        assert (a, b) == ((hits[0], hits[-1] + window) if hits else (0, 0))


def brute_kept(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {p for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def passages():
    """Passages that repeat in a document, in two, in many (hot anchors), at both ends, and copies."""
    texts = list(ODD)
    for g in range(6):
        p = prose(g, 30 + 9 * g)
        texts += [f"{prose(50 + 10 * g + k, 40)} {p} {prose(500 + 10 * g + k, 30)}" for k in range(2 + g)]
    hot = prose(77, 60)
    texts += [f"{prose(1000 + k, k % 50)} {hot} {prose(2000 + k, k % 30)}" for k in range(100)]
    texts += [prose(5, 200)] * 3 + [f"{prose(88, 50)} {prose(3, 20)} {prose(88, 50)}", prose(2, 80).replace(" ", "\n"), prose(2, 80)]
    return texts


@pytest.mark.parametrize(("window", "hot"), [(35, 64), (35, 2), (12, 64)])
def test_repeats_against_brute_force(spark, monkeypatch, window, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SHARD", 3000)
    texts = passages()
    got = sorted(tuple(r) for r in sd.drop_repeats(clashing(spark, texts).drop("size"), window, 8).collect())
    assert [r[1:] for r in got] == brute_kept(texts, window)


def test_repeat_edges(spark):
    df = documents(spark, [prose(1, 50), prose(2, 50)])
    assert sd.drop_repeats(df.limit(0)).collect() == []
    got = sd.drop_repeats(with_repeats(df)).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 50, 50, 50, 50]
    short = sd.drop_repeats(documents(spark, ["a b", "a b"])).collect()
    assert all(r["n_removed"] == 0 and r["kept"] == "a b" for r in short)


def test_long_texts_are_cut_into_blocks(monkeypatch):
    w = [x.encode() for x in prose(3, 3000, 50).split()]
    whole = sd.anchor_runs(w, 35, 8)
    monkeypatch.setattr(sd, "BLOCK", 100)
    parts = sd.anchor_runs(w, 35, 8)
    spread = [np.repeat(a, n).tolist() for a, _, n in (whole, parts)]
    assert spread[0] == spread[1] and sum(parts[2]) == len(w) - 34


INNER = [
    "maybe", "_bit", "_word", "_found", "_flag", "_b", "_w", "_bits", "_kept", "_kept_id", "_kept_text", "_id", "_key", "_times", "_nth", "_lang", "_score",
    "_digest", "salt", "keep_id", "digest", "node", "rep", "size", "range", "number", "k.1", "two words",
]


def test_row_keeping_functions_keep_columns_of_any_name(spark, tmp_path):
    """Columns with the names that operators use inside stay, with their values."""
    from tarn.llm.exact_dedup import drop_copies
    from tarn.llm.mixing import mixed_documents

    texts = [prose(k % 5, 40) for k in range(12)] + ["a b", None]
    docs = documents(spark, texts, **{f"c{i}": [f"v{i}"] * len(texts) for i in range(len(INNER))})
    docs = docs.toDF(*docs.columns[: -len(INNER)], *INNER)
    for f in (drop_copies, jc.one_of_each_class, mixed_documents, lambda d: corpus_pipeline.language(spark, d, "")):
        out = f(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r)[-len(INNER) :] == tuple(f"v{i}" for i in range(len(INNER))) for r in rows)


def test_pipeline(spark, tmp_path):
    """Each stage against a brute-force version, on what the stage before left."""
    texts = [t for t in corpus() if t is None or len(t) < 4000] + [prose(5, 100), prose(5, 100), "12 34", None]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
    ids = {n: sorted(r["doc_id"] for r in rows) for n, rows in seen.items()}
    assert ids["language_id"] == [i for i, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)]
    groups = {}
    for i in ids["language_id"]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert ids["exact_dedup"] == sorted(groups.values())
    left = ids["exact_dedup"]
    assert ids["near_dedup"] == sorted({left[c] for _, _, c in brute_classes([texts[i] for i in left], 5, 80, 100)})
    size = {i: len(words(texts[i])) for i in ids["near_dedup"]}
    source = {r["doc_id"]: r["source"] for r in seen["near_dedup"]}
    order = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    of = {s: sum(n for i, n in size.items() if source[i] == s) for s in order}
    aims = dict(zip(order, targets(list(of.items()), (3, 1, 2), 1.5, 2.0), strict=True))
    stream = {s: sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in size if source[i] == s) for s in order}
    times = Counter()
    for s, own in stream.items():
        at, taken = 0, Counter()
        for turn in range(2):
            for _, i in own:
                taken[i] += max(0, min(size[i], int(aims[s]) - at))
                at += size[i]
        times.update({i: int(n / size[i] + 0.5) for i, n in taken.items()})
    assert ids["mixing"] == sorted(i for i, n in times.items() for _ in range(n))
    packed = Counter()
    for r in seen["packing"]:
        packed[r["doc_id"]] += r["size"]
    assert packed == {i: n * (size[i] + 1) for i, n in times.items() if n}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])
