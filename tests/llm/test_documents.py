"""Decontamination, mixing, sharding and SimHash against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from citegrain.llm import decontaminate, mixture, sharding, simhash
from citegrain.llm.common import letter_words, word_count
from tests.llm.fixtures import documents, empty, odd_rows, row, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


def test_words_follow_their_patterns(spark):
    got = documents(spark).select("text", letter_words(F.col("text")).alias("w"), word_count(F.col("text")).alias("n")).collect()
    for r in got:
        assert r["w"] == WORD.findall(lower(r["text"]))
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


def benchmark(spark, rows=None):
    rows = rows or [
        (1, words(1, 3000)[2000:2400]), (2, "ONE"), (3, "two, one"), (4, words(2, 10)), (5, words(2, 10)), (6, None),
        (7, ""), (None, words(3, 30)), (10, words(6, 25)), (8, "ümlaut äö i̇stanbul"), (1, words(7, 12)),
    ]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def hits(text, items):
    w, hit, found = WORD.findall(lower(text)), set(), set()
    for item, body in items:
        g = WORD.findall(lower(body))
        n = min(len(g), 10)
        grams = {tuple(g[i : i + n]) for i in range(len(g) - n + 1)} if g else set()
        for i in range(len(w) - n + 1) if grams else ():
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_windows_are_found_by_broadcast_and_by_shuffle(spark, bound):
    docs, items = documents(spark), benchmark(spark)
    windows = decontaminate.benchmark_windows(items)
    found = decontaminate.occurrences(docs, windows, bound)
    per = defaultdict(set)
    for r in found.collect():
        per[r["doc_id"], r["text_key"]].update(range(r["at"], r["at"] + len(r["gram"])))
    keys = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()
    body = [tuple(r) for r in items.collect()]
    for r in keys:
        assert len(per[r["doc_id"], r["k"]]) == hits(r["text"], body)[1]


def test_judged_documents(spark):
    body = [tuple(r) for r in benchmark(spark).collect()]
    got = rows_of(decontaminate.judged(documents(spark), benchmark(spark)))
    want = Counter()
    for r in odd_rows():
        n, hit, found = hits(r[1], body)
        want[r[0], n, hit, len(found), tuple(found), hit > 0] += 1
    assert got == want


def test_decontaminated_documents_and_spans(spark):
    docs, items = documents(spark), benchmark(spark)
    body = [tuple(r) for r in items.collect()]
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert rows_of(kept) == Counter(r for r in odd_rows() if not hits(r[1], body)[1])
    cut = decontaminate.without_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == len(odd_rows())
    left = {(r["doc_id"], r["n_chars"]): r["text"] for r in cut.collect()}
    assert left[12, len(words(6, 200))].split() == words(6, 200).split()[25:]
    assert left[3, 0] is None and left[6, 3] == ""


def test_nothing_in_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.judged(empty(spark), benchmark(spark)).count() == 0
    assert {r["n_hit"] for r in decontaminate.judged(documents(spark), none).collect()} == {0}
    assert decontaminate.without_contaminated(documents(spark), none).count() == len(odd_rows())
    assert mixture.mix(empty(spark)).count() == 0 and mixture.mixed_documents(empty(spark)).count() == 0
    assert sharding.assigned(empty(spark)).count() == 0 and sharding.sharded_documents(empty(spark)).count() == 0
    assert simhash.grouped(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


def water(sizes, weights, repeats=3):
    """Targets by sharing, stopping and sharing again."""
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in capped)
        share = sum(weights[s] for s in sizes if s not in capped)
        target = {s: repeats * sizes[s] if s in capped else rest * weights[s] / share for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > repeats * sizes[s]}
        if not over:
            return target
        capped |= over


def many(n=400):
    rows = [row(i, words(i, 5 + i * 7 % 60), f"s{i % 4}" if i % 3 else "hot") for i in range(n)]
    return rows + [row(n + i, words(n + i, 3), None) for i in range(4)] + [row(n + 10, words(5, 4), "Tiny")]


def test_mix_meets_targets(spark):
    docs = documents(spark, many())
    got = mixture.mix(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken, most = Counter(), max(r["size"] for r in got)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    assert rows_of(mixture.mix(docs.repartition(7))) == rows_of(mixture.mix(docs))
    out = mixture.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mix_is_the_queue_in_order(spark):
    """The histogram search ends at the same copy as a plain walk."""
    got = {r["doc_id"]: r for r in mixture.mix(documents(spark, many())).collect()}
    queues = defaultdict(list)
    for d, r in got.items():
        queues[r["source"]].append((hashlib.md5(f"0:{d}".encode()).hexdigest(), d))
    copies, order = [], sorted((s for s in queues if s is not None)) + [None]
    for s, q in queues.items():
        before = 0
        for _, d in sorted(q):
            before += got[d]["size"]
            copies += [((before + e * got[d]["source_size"]) / got[d]["target"], order.index(s), before, d) for e in range(3)]
    budget, want = sum(r["size"] for r in got.values()), Counter()
    for _, _, _, d in sorted(copies):
        if budget < got[d]["size"]:
            break
        budget -= got[d]["size"]
        want[d] += got[d]["size"]
    assert {d: r["taken"] for d, r in got.items() if r["taken"]} == dict(want)


def test_mix_search_refines(spark, monkeypatch):
    docs = documents(spark, many())
    want = rows_of(mixture.mix(docs))
    monkeypatch.setattr(mixture, "LAST_STEP_ROWS", 1)
    monkeypatch.setattr(mixture, "STEPS", 8)
    assert rows_of(mixture.mix(docs)) == want


def test_mix_of_odd_rows(spark):
    got = mixture.mix(documents(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows())
    assert all(r["taken"] == 0 for r in got if not r["size"])


def brute_splitters(rows, shards):
    """The best a cut between keys can do, for each splitter."""
    keys = Counter()
    for key, size in rows:
        keys[key] += size
    total, below, best = sum(keys.values()), 0, [None] * (shards - 1)
    for key in sorted(keys):
        for i in range(1, shards):
            off = abs(below - total * i / shards)
            best[i - 1] = off if best[i - 1] is None else min(best[i - 1], off)
        below += keys[key]
    return [min(b, abs(total - total * i / shards)) for i, b in enumerate(best, 1)], total


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_even(spark, hot):
    rows = many(300) + ([row(10_000 + i, "the same text again", "hot") for i in range(900)] if hot else [])
    got = sharding.assigned(documents(spark, rows), 8).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    keyed, per = [], Counter()
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        keyed.append((md5(text[r["doc_id"]]) + md5(str(r["doc_id"])), r["size"]))
        per[r["shard"]] += r["size"]
    best, total = brute_splitters(keyed, 8)
    ends, below = [], 0
    for shard in range(7):
        below += per[shard]
        ends.append(abs(below - total * (shard + 1) / 8))
    assert all(e <= max(b, sharding.WHOLE * total / 8) for e, b in zip(ends, best))
    for shard in per:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_one_row_repeated_by_a_third_is_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 64)
    rows = many(200) + [row(99_999, "again and again " * 5)] * 400
    for df in (sharding.assigned(documents(spark, rows), 8), sharding.sharded_documents(documents(spark, rows), 8)):
        name = "shard" if "slot" in df.columns else "_shard"
        sizes = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
        per = Counter()
        got = df.collect()
        for r in got:
            per[r[name]] += sizes[r["doc_id"]]
        assert len(got) == len(rows) and max(per.values()) <= 1.1 * sum(per.values()) / 8
    got = sharding.assigned(documents(spark, rows), 8).collect()
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_windows_of_repeated_rows_are_found_once(spark):
    """One document is a third of all rows; it is searched once, by either way of looking windows up."""
    text = f"{words(1, 20)} {words(900, 30)} {words(2, 20)}"
    rows = [row(5, text)] * 60 + [row(100 + i, words(i, 40)) for i in range(60)]
    bench = spark.createDataFrame([(1, words(900, 30)), (2, "short item"), (3, None)], "item_id bigint, text string")
    windows = decontaminate.benchmark_windows(bench)
    for bound in (1 << 20, 0):
        found = decontaminate.occurrences(documents(spark, rows), windows, bound).collect()
        assert sorted(r["at"] for r in found) == list(range(20, 41))
    got = decontaminate.judged(documents(spark, rows), bench).collect()
    assert len(got) == 120 and {(r["doc_id"], r["n_hit"]) for r in got if r["contaminated"]} == {(5, 30)}


def test_shards_of_odd_rows(spark):
    docs = documents(spark)
    got = sharding.assigned(docs, 8).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows())
    out = sharding.sharded_documents(docs, 8)
    assert out.columns == [*docs.columns, "_shard"]
    assert rows_of(out.drop("_shard")) == Counter(odd_rows())


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(fps, distance=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_groups_of_odd_rows(spark):
    rows = odd_rows()
    got = simhash.grouped(documents(spark)).collect()
    fps = [plain_simhash(r[1]) for r in rows]
    roots = union_find(fps)
    smallest = defaultdict(lambda: None)
    for r, root in zip(rows, roots):
        if r[0] is not None:
            smallest[root] = r[0] if smallest[root] is None else min(smallest[root], r[0])
    want = Counter((r[0], fp, smallest[root]) for r, fp, root in zip(rows, fps, roots))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    assert len(kept) == len(set(union_find([plain_simhash(r[1]) for r in odd_rows()])))
    assert {1, 3, 6, 7, 8, 10, 11, 12, 16} <= set(kept) and 2 not in kept


@pytest.mark.parametrize("crowd", [48, 1])
def test_links_join_all_within_distance(spark, crowd):
    import random

    r = random.Random(5)
    fps = set()
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.randrange(12)):
            fps.add(x)
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), crowd=crowd)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in links.collect())
    got = {n: root for n, root in simhash.components(links).collect()}
    mine, want = [got.get(x, x) for x in signed], union_find(fps)
    assert len(set(zip(mine, want))) == len(set(want)) == len(set(mine))


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = dict(simhash.components(path).collect())
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
