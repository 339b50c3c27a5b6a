from __future__ import annotations

import random

#: Texts that operators must stand: null, empty, blanks, odd characters, one word, copies, copies up to white space.
ODD = [None, "", " \t\n", "a", "é ñ 漢字  x", "two words", "two  words", "two words", "123 !!! ...", "x" * 5000, "der " * 400]


def documents(spark, texts, **columns):
    """documents with these texts, ids 0, 1, …; further columns (lang, source and those with clashing names)."""
    n = len(texts)
    cols = {"lang": ["en"] * n, "source": [f"s{i % 3}" if i % 7 else None for i in range(n)], "n_chars": [len(t or "") for t in texts]} | columns
    rows = [(i, t, *(c[i] for c in cols.values())) for i, t in enumerate(texts)]
    kinds = {"n_chars": "long", "digest": "string", "keep_id": "string", "node": "string", "k1": "string", "size": "string", "range": "string"}
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols))


def clashing(spark, texts):
    """documents with extra columns whose names operators use inside."""
    n = len(texts)
    return documents(spark, texts, **{c: ["?"] * n for c in ("digest", "keep_id", "node", "k1", "size", "range")})


def with_repeats(df):
    """Also a null id, twice, and the first row once more."""
    spark = df.sparkSession
    more = spark.createDataFrame([r.asDict() | {"doc_id": None} for r in df.limit(1).collect()] * 2 + [r.asDict() for r in df.limit(1).collect()], df.schema)
    return df.unionByName(more)


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(words))
