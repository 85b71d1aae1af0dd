"""Token counts against the tokenizer library."""

import pickle

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citegrain.llm import bpe_counts, queries
from tests.llm.fixtures import documents, empty, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MERGES = bpe_counts.load(PATH)
COUNT = bpe_counts.counter(MERGES)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "  ", "\n\n", "'s", "don't", " 123", "日本語", "́", "🙂🙂", "aaaa"])), max_size=8).map("".join))
def test_any_text(text):
    assert COUNT(text) == library(text)


def test_every_code_point_is_cut_as_the_library_cuts():
    """In runs of 40 neighbours, after a letter, a number, a mark and white space."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        text = "".join(f"{'a1!\n'[c % 4]}{x}" for c, x in enumerate(points[at : at + 4000]))
        assert COUNT(text) == library(text), hex(ord(points[at]))


@pytest.mark.parametrize("text", [
    "a" * 30000, "ab" * 20000 + "b", " " * 5000 + "x", "é" * 4001, "<|endoftext|>" * 50, "x<|endoftext|> <|endoftext|", "\x00\x7f ﻿ z",
    "anti" * 3000 + " disestablishment",
])
def test_long_pieces_and_added_tokens(text):
    assert COUNT(text) == library(text)


def test_a_text_is_counted_alike_beyond_the_list_bound(monkeypatch):
    text = " ".join(f"word{i} it's\n\n {i * 7}" for i in range(900))
    want = COUNT(text)
    monkeypatch.setattr(bpe_counts, "LONG", 100)
    monkeypatch.setattr(bpe_counts, "REMEMBERED", 7)
    MERGES.known.clear()
    assert bpe_counts.counter(MERGES)(text) == want == library(text)


def test_merges_go_by_rank_then_place():
    merges = bpe_counts.Merges([(b"a", b"a"), (b"aa", b"a"), (b"b", b"c"), (b"a", b"b")], [])
    assert [merges.count(p) for p in (b"aaaa", b"aaa", b"abc", b"a", b"")] == [2, 1, 2, 1, 0]
    spelled_alike = bpe_counts.Merges([(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"x", b"bc"), (b"abc", b"d")], [])
    assert [spelled_alike.count(p) for p in (b"abcd", b"xbc", b"abc")] == [1, 1, 1]
    assert pickle.loads(pickle.dumps(spelled_alike)).count(b"abcd") == 1


def test_odd_rows_and_names(spark):
    docs = documents(spark).withColumnRenamed("rank", "n_tokens").withColumnRenamed("word", "counted_text")
    got = bpe_counts.with_token_counts(docs, PATH)
    assert got.columns == [*docs.columns, "_n_tokens"]
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and all(r["_n_tokens"] == library(r["text"]) and r["n_tokens"] == 2 for r in rows)
    assert bpe_counts.with_token_counts(empty(spark), PATH).count() == 0


def test_query_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), n := library(r["text"]), n > 1024) for r in docs)
    assert sorted(map(tuple, queries.op12_token_counts(spark, "/root/testdata/sf0.01").collect())) == want


def test_other_files_are_refused(tmp_path):
    other = tmp_path / "other.json"
    other.write_text('{"model": {"type": "Unigram"}, "pre_tokenizer": null}')
    with pytest.raises(ValueError):
        bpe_counts.load(str(other))
    with pytest.raises(ValueError):
        bpe_counts.load(public_tokenizers.path("word_bpe_49k.json"))
