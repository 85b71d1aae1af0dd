"""The trie of conversations against a plain walk over all prefixes."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from citegrain.llm import prefix_trie

ROW = "conv_id bigint, turn int, role string, text string, depth int, id1 string"


def digest(role, text):
    half = lambda s: hashlib.md5((s or "").encode()).hexdigest()
    return hashlib.md5((half(role) + half(text)).encode()).hexdigest()


def brute(rows, rebuild=True):
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), digest(role, text), role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]) if rebuild else tuple(own)
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below = [totals[k] for k in kids.get(node, [])]
        totals[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    ends = lambda node: ",".join(str(c) for c in sorted(members[node]) if whole[c] == node)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids.get(node, [])), *totals[node], hashlib.sha256(ends(node).encode()).hexdigest())
        for node, m in members.items()
    )


def got(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def built(spark, rows, **sizes):
    conv = F.col("conv_id")
    numbered = prefix_trie.numbered(spark.createDataFrame(rows, ROW), **({"part_rows": sizes["shard_rows"]} if sizes else {}))
    return prefix_trie.trie(prefix_trie.rebuilt(numbered, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6), **sizes)


def row(c, turn, role, text):
    return c, turn, role, text, 7, "x"


def conversations(seed, n):
    r = random.Random(seed)
    firsts = [("user", f"hello {i}") for i in range(3)]
    rows = []
    for i in range(n):
        c = r.choice([i, i + 100, i + 700])
        length = r.choice([0, 1, 2, 3, 6, 9])
        for t in range(length):
            role, text = firsts[r.choice([0, 0, 1, 2])] if t == 0 else (r.choice(["user", "assistant"]), f"{'é' * r.randrange(3)}{r.randrange(2)}")
            rows.append(row(c, t, role, text))
    return rows


def odd():
    return [
        row(None, 1, "user", "lost"), row(5, None, "user", "first"), row(5, 0, None, None), row(5, 0, "user", None), row(5, 3, "", ""), row(5, 3, "", ""),
        row(100, 1, "user", "🙂é"), row(100, 2, "assistant", "x" * 5000), row(101, 1, "user", "🙂é"), row(102, 7, "user", "only"), row(-3, 1, "user", "minus"),
        row(103, 1, "a", "b"), row(103, 2, "a", "b"), row(103, 2, "a", "b"), row(104, 2, "ab", ""), row(104, 3, "a", "b"), row(205, 1, "user", "turnless or not"),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = conversations(seed, 150) + odd()
    assert got(built(spark, rows)) == brute(rows)


@pytest.mark.parametrize("shard_rows", [7, 40])
def test_many_shards_and_levels(spark, shard_rows):
    """Shards far smaller than the trie: totals pass several levels of shard roots."""
    rows = conversations(3, 120) + odd()
    assert got(built(spark, rows, shard_rows=shard_rows)) == brute(rows)


def test_one_long_conversation_is_dealt_over_blocks(spark, monkeypatch):
    """A third of all rows are one conversation, another third rows that repeat in full."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [row(200, t, "user", f"t{t % 5}") for t in range(120)] + [row(201, 4, "user", "again")] * 120
    rows += conversations(4, 60)
    got_rows = got(built(spark, rows, shard_rows=50))
    assert got_rows == brute(rows)
    numbered = prefix_trie.numbered(spark.createDataFrame(rows, ROW), 50)
    assert numbered.groupBy("conv_id").count().agg(F.max("count")).first()[0] >= 120


def test_hot_nodes_and_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 5)
    rows = [row(c, 1, "user", "same") for c in range(1, 90)] + [row(c, 2, "user", f"own {c}") for c in range(1, 90, 2)]
    assert got(built(spark, rows)) == brute(rows)
    plain = prefix_trie.trie(prefix_trie.numbered(spark.createDataFrame(rows, ROW)))
    assert got(plain) == brute(rows, rebuild=False)


def test_no_group_holds_a_hot_conversation(spark):
    """Numbering and hashing: the most rows that any one window sees."""
    rows = [row(1, t, "user", "x") for t in range(30)]
    numbered = prefix_trie.numbered(spark.createDataFrame(rows, ROW), 10)
    plan = numbered._jdf.queryExecution().toString()
    assert "Parquet" in plan and sorted(r["pos"] for r in numbered.collect()) == list(range(1, 31))


def test_nothing(spark):
    assert built(spark, [row(None, 1, "user", "x")]).count() == 0
    assert built(spark, []).count() == 0


def test_forwarded_goes_up_in_reverse_level_order():
    rows = [(4, 3, 2, 2, 1, 10), (2, 2, 2, 1, 0, 5), (3, 2, 2, 1, 1, 2), (2, 1, 0, 0, 0, 1)]
    totals, out, beyond = prefix_trie.forwarded(rows)
    assert totals == [(1, 10), (1, 15), (1, 2), (2, 18)]
    assert dict(out) == {(0, 0): [2, 18]} and beyond == [(0, 0)] * 4
