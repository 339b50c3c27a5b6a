"""Exact dedup, mixing, packing."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import exact_dedup as module
from tarn.llm.exact_dedup import drop_copies, exact_dedup
from tarn.llm.mixing import mix, mixed_documents, taken, targets
from tarn.llm.packing import CAPACITIES, OVERHEAD, pack, pack_sizes

from .helpers import ODD, clashing, documents, prose, with_repeats


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_against_brute_force(spark):
    texts = ODD + [prose(i % 4, 30) for i in range(20)]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(normal(t), []).append(i)
    got = {r["doc_id"]: r for r in exact_dedup(clashing(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = groups[normal(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(g), len(g), i == min(g))
    plan = exact_dedup(documents(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_dedup_nulls_and_repeats(spark):
    df = with_repeats(documents(spark, ["a b", "a  b", "c"]))
    got = exact_dedup(df).collect()
    assert len(got) == 6 and sum(r["kept"] for r in got) == 2
    nulls = documents(spark, ["z", "z"]).withColumn("doc_id", F.lit(None).cast("long"))
    got = exact_dedup(nulls).collect()
    assert [r["keep_id"] for r in got] == [None, None] and sum(r["kept"] for r in got) == 1
    assert exact_dedup(documents(spark, ["a"]).limit(0)).collect() == []
    assert sorted(r["doc_id"] for r in drop_copies(df).collect()) == [0, 2]
    assert drop_copies(df).columns == df.columns


def test_exact_dedup_compares_contents(spark, monkeypatch):
    """Where digests collide, whole texts still tell rows apart."""
    monkeypatch.setattr(module.F, "sha2", lambda c, n: F.lit("same"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(documents(spark, ["a", "b", "a"])).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (0, 2)}


def test_targets_are_the_fixed_point():
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 0), (None, 300)]
    got = targets(sizes, (3, 1, 2), 1.5, 2.0)
    weights = dict(zip("abcde", (3, 1, 2, 3, 1), strict=True))
    want, left = {}, dict(zip("abcde", [2.0 * n for _, n in sizes], strict=True))
    budget = 1.5 * 1810
    while True:  # reshare until none is above
        level = budget / sum(weights[k] for k in left)
        over = [k for k in left if level * weights[k] > left[k]]
        if not over:
            want |= {k: level * weights[k] for k in left}
            break
        for k in over:
            budget -= left[k]
            want[k] = left.pop(k)
    assert got == pytest.approx([want[k] for k in "abcde"])


def test_mixing(spark):
    texts = ODD + [prose(i, 5 + i * 7 % 200) for i in range(120)]
    df = clashing(spark, texts).drop("size")
    pieces = mix(df, block=16)
    rows = taken(pieces).collect()
    assert len(rows) == len(texts) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and own[0]["source_size"] == sum(r["size"] for r in own)
    slots = [r for r in pieces.collect() if r["slot"] is not None]
    filled = Counter()
    for r in slots:
        filled[r["slot"]] += r["words"]
        assert 0 < r["words"] <= 16 and 0 <= r["from"] and r["from"] + r["words"] <= r["size"]
    assert all(n <= 16 for n in filled.values()) and len({(r["slot"], r["source"]) for r in slots}) == len(filled)
    assert sorted(map(str, taken(mix(df.repartition(7), block=16)).collect())) == sorted(map(str, rows))
    # Low discrepancy: any stretch of slots holds each source about as often as its share.
    order = [s for _, s in sorted({(r["slot"], str(r["source"])) for r in slots})]
    share = Counter(order)
    half = Counter(order[: len(order) // 2])
    assert all(abs(half[s] - share[s] / 2) <= 4 for s in share)


def test_mixing_edges(spark):
    df = documents(spark, ["a b c", None])
    assert mix(df.limit(0)).collect() == []
    rows = taken(mix(with_repeats(df))).collect()
    assert len(rows) == 5
    assert {r["doc_id"] for r in mixed_documents(df).collect()} == {0} and mixed_documents(df).columns == df.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_packing_invariants(sizes):
    s = np.array(sorted(sizes, reverse=True), np.int64)
    bins, places, caps = pack_sizes(s, (20, 50, 100), 4)
    for b in set(bins.tolist()):
        own = sorted((p, n) for p, n, x in zip(places.tolist(), s.tolist(), bins.tolist(), strict=True) if x == b)
        total, cap = sum(n for _, n in own), caps[bins == b][0]
        assert [p for p, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert total <= cap and not any(c >= total for c in (20, 50, 100) if c < cap)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_packing_is_near_the_optimum(sizes):
    """Against all ways to part the sizes into bins."""

    def cost(total):
        return min(c + 2 for c in (5, 10, 20) if c >= total)

    best = [float("inf")]

    def place(k, bins):
        if k == len(sizes):
            best[0] = min(best[0], sum(map(cost, bins)))
            return
        for i, b in enumerate(bins):
            if b + sizes[k] <= 20:
                place(k + 1, [*bins[:i], b + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    bins, _, caps = pack_sizes(np.array(sorted(sizes, reverse=True), np.int64), (5, 10, 20), 2)
    got = sum(int(caps[bins == b][0]) + 2 for b in set(bins.tolist()))
    assert got <= 1.7 * best[0]


def test_pack(spark):
    texts = ODD + [prose(i, i * 90) for i in range(60)] + [prose(7, 20_000)]
    rows = pack(with_repeats(clashing(spark, texts)), shard=20).collect()
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["bin_id"], []).append(r)
    assert all(sum(r["size"] for r in b) <= b[0]["capacity"] and b[0]["capacity"] in CAPACITIES for b in by_bin.values())
    long = sorted((r["piece"], r["begin"], r["size"]) for r in rows if r["doc_id"] == len(texts) - 1)
    assert long == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 20_001 - 16384)]
    assert {r["doc_id"] for r in rows} == {*range(len(texts)), None} and OVERHEAD > 0
    none = pack(documents(spark, ["a", None]), size=F.lit(0)).collect()
    assert [(r["size"], r["bin_id"]) for r in none] == [(0, None)] * 2
    assert pack(documents(spark, ["a"]).limit(0)).collect() == []
