"""Token files and archives."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm.token_file import END, LEAST, Shard, WordEncoder, encode_shard, expand, read_tokens, repair, token_digests, write_tokens
from tarn.llm.warc import decode_record, encode_record, read_archives, train, write_archives

from .helpers import ODD, clashing, documents, prose, with_repeats

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return WordEncoder(f.read())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_repair_round_trip(ids, a, b):
    tokens = np.array(ids * 5, np.uint32)
    symbols, pairs, lengths = repair(tokens, 6)
    plain = [[k] for k in range(6)]
    for left, right in pairs.tolist():
        plain.append(plain[left] + plain[right])
    assert [len(x) for x in plain[6:]] == lengths.tolist()
    assert [t for s in symbols.tolist() for t in plain[s]] == tokens.tolist()
    assert expand(symbols, pairs, lengths, 6).tolist() == tokens.tolist()
    assert all(expand(np.array([6 + k], np.uint32), pairs, lengths, 6).tolist() == x for k, x in enumerate(plain[6:]))
    shard = Shard.parse(encode_shard([7], [len(tokens)], tokens, 6))
    low, high = sorted((min(a, len(tokens)), min(b, len(tokens))))
    assert shard.tokens(low, high).tolist() == tokens[low:high].tolist()
    assert [(i, x.tolist()) for i, _, x in shard.documents()] == [(7, tokens.tolist())]


def test_other_vocabularies_get_whole_texts(encoder):
    from tokenizers import Tokenizer, models, pre_tokenizers

    assert encoder.parted
    cased = Tokenizer(models.WordLevel({"[UNK]": 0, "Ab": 1, "cd": 2}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.Whitespace()
    other = WordEncoder(cased.to_str())
    assert not other.parted
    assert [other.encode(x).tolist() for x in ("Ab cd ab", "")] == [[1, 2, 0, 1], [1]]


def test_repair_compresses():
    tokens = np.tile(np.arange(10, dtype=np.uint32), 1000)
    symbols, pairs, _ = repair(tokens, 10)
    assert len(symbols) + 2 * len(pairs) < len(tokens) / 5


def test_repair_goes_on_until_no_pair_is_frequent():
    """Long copies among other tokens: rules longer than eight rounds make, and no frequent pair of symbols is left."""
    r = np.random.default_rng(1)
    copy = r.integers(0, 3000, 2000)
    tokens = np.concatenate([np.r_[copy, r.integers(0, 3000, k % 7)] for k in range(200)]).astype(np.uint32)
    symbols, pairs, lengths = repair(tokens, 3000)
    count = np.unique((symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:], return_counts=True)[1]
    assert count.max() < LEAST and lengths.max() > 256
    assert (expand(symbols, pairs, lengths, 3000) == tokens).all()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ ''ssttrree\n\n09.,!<|>éÉßÀñ́\t\x1c ÿµªⅧΣ漢😀İ"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_are_encoded_as_the_library_does(encoder, text):
    for t in (text, f"don't {text} we'LL <|endoftext|>x"):
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [END]


def test_texts_are_encoded_together_as_each_alone(encoder):
    """Units end with their text, and apostrophes of one text don't meet the letters of the next."""
    texts = ["it'", "s", "", "漢字 we'LL", "''s 'soft x's'd !'t", "Don't", "\0\1 a", "<|endoftext|>", "'re'", "vé 12's\n", "'"]
    assert encoder.encode_all([]) == []
    assert [x.tolist() for x in encoder.encode_all(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [END] for t in texts]


def test_a_unit_is_looked_up_once_for_many_uses(encoder):
    """What one lookup for each word costs brought the query over its CPU budget."""

    class Counting(dict):
        lookups = 0

        def get(self, *a):
            Counting.lookups += 1
            return super().get(*a)

    with open(PATH, encoding="utf-8") as f:
        own = WordEncoder(f.read())
    own.units = Counting(own.units)
    text = "the cat, the dog. " * 1000
    assert own.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [END]
    assert 0 < Counting.lookups < 20


@pytest.mark.parametrize("terminals", [2, 200, 250, 60_000, 65_530, 65_536, 200_000])
def test_shards_of_all_widths(terminals):
    """Symbols of whole bytes and of other widths; pairs of symbols below and above 16 bits, and rules that pass them."""
    r = np.random.default_rng(terminals)
    tokens = np.concatenate([np.tile(r.integers(0, terminals, 40), 9), r.integers(0, terminals, 500)]).astype(np.uint32)
    shard = Shard.parse(encode_shard([3], [len(tokens)], tokens, terminals))
    assert len(shard.pairs) and len(shard.symbols) < len(tokens)
    assert [x.tolist() for _, _, x in shard.documents()] == [tokens.tolist()]


def test_token_file(spark):
    texts = ODD + [prose(i, 50) for i in range(30)]
    manifest = write_tokens(clashing(spark, texts).repartition(5), PATH)
    tokenizer, start = Tokenizer.from_file(PATH), 0
    got = {r["doc_id"]: r for r in token_digests(manifest).collect()}
    ids = {r["doc_id"]: r["ids"] for r in read_tokens(manifest).collect()}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert ids[i] == want
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_token_file_edges(spark):
    df = with_repeats(documents(spark, ["b", "a"]))
    got = sorted((r["start"], r["doc_id"]) for r in token_digests(write_tokens(df, PATH)).collect())
    assert [i for _, i in got] == [None, None, 0, 0, 1]
    assert token_digests(write_tokens(df.limit(0), PATH)).collect() == []


def pages(spark, bodies):
    return spark.createDataFrame([(i, f"http://h/{i} é", b, "?") for i, b in enumerate(bodies)], "page_id long, url string, html string, key string")


def test_archives(spark):
    bodies = ODD + [f"<p>{prose(i % 9, 60)}</p>" for i in range(40)]
    manifest = write_archives(pages(spark, bodies).repartition(3))
    got = {r["page_id"]: r for r in read_archives(manifest).collect()}
    assert len(got) == len(bodies)
    for i, b in enumerate(bodies):
        data = (b or "").encode()
        head = max(k for k, x in enumerate(bodies) if (x or "") == (b or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"], r["body"]) == (("response", None, bytearray(data)) if i == head else ("revisit", head, None))
    least = {r["page_id"]: r["record_type"] for r in read_archives(write_archives(pages(spark, ["", "", "ab", "ab"]), least=1)).collect()}
    assert least == {0: "response", 1: "response", 2: "revisit", 3: "response"}


def test_archive_edges(spark):
    assert read_archives(write_archives(pages(spark, ["a"]).limit(0))).collect() == []
    nulls = pages(spark, ["a", "a"]).withColumn("page_id", F.when(F.col("page_id") > 0, F.col("page_id")))
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in read_archives(write_archives(nulls)).collect()) == [(-1, "revisit", 1), (1, "response", None)]


def test_dictionary_leads_the_file(spark):
    import zstandard

    from tarn.llm.warc import read_dictionary

    records = [encode_record("response", i, "http://h", f"<html>{prose(i % 5, 80)}</html>".encode(), None, None) for i in range(300)]
    assert decode_record(records[3])[0]["X-Page-ID"] == "3" and train([b"x"]) is None
    manifest = write_archives(pages(spark, [f"<html>{prose(i, 200)}</html>" for i in range(200)]).coalesce(1))
    path = manifest.first()["path"].removeprefix("file://")
    with open(path, "rb") as f:
        d = read_dictionary(f)
        assert d and len(d) > 1000
        rest = f.read()
    # A reader that knows nothing of the dictionary's frame skips it; records are frames of their own.
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)).decompress(rest[: manifest.first()["offsets"][1] - manifest.first()["offsets"][0]])
    assert first.startswith(b"WARC/1.1\r\n")
