"""Toxicity, URL rules, sketches, language-model scores, transcripts and repeated passages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.llm import ngram_bloom, sketches, suffixes, toxicity, transcripts, url_rules
from citegrain.llm.queries import URL_RULES, raw_transcripts
from tests.llm.fixtures import documents, empty, odd_rows, row, words


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n == 2


def labelled(n=600):
    """Documents, one in five of them toxic by a few words, whose endings vary."""
    r, rows, labels = random.Random(3), [], []
    for i in range(n):
        body, bad = words(i, 20 + i % 90).split(), i % 5 == 0
        for _ in range(r.randrange(1, 4) if bad else 0):
            body.insert(r.randrange(len(body)), r.choice(["vilest", "grotty", "scabby"]) + r.choice(["", "a", "ox", "um"]))
        rows.append(row(i, " ".join(body)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    docs = documents(spark, rows + odd_rows())
    table = spark.createDataFrame([*labels, (3, None), (None, 1), (5, 1), (5, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, table)
    got = toxicity.scored(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows + odd_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = dict(labels)
    unseen = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and (r["doc_id"] or 0) > 20]
    assert len(unseen) > 100 and np.mean([t == p for t, p in unseen]) > 0.95
    assert all(r["held_out"] == held(r["doc_id"], 4) for r in got if r["doc_id"] is not None)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)


def test_held_out_labels_change_nothing(spark):
    rows, labels = labelled(200)
    docs = documents(spark, rows)
    turned = [(i, 1 - t if held(i, 4) else t) for i, t in labels]
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame(x, "doc_id bigint, toxic int"))).collect()}
        for x in (labels, turned)
    ]
    assert scores[0] == pytest.approx(scores[1], abs=1e-12)


def test_toxicity_without_both_classes(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(spark), none)
    assert {r["score"] for r in toxicity.scored(documents(spark), model).collect()} == {0.5}
    assert toxicity.scored(empty(spark), model).count() == 0


def plain_kneser_ney(rows):
    """p_y(w | h) of both classes in plain dictionaries, and the words that the models know."""
    words = [(toxicity.words_of(t), y) for _, t, y in rows]
    c = [Counter(p for ws, own in words if own == y for p in zip([b"", *ws], ws)) for y in (0, 1)]
    k = [Counter(w for _, w in of) for of in c]
    s = [Counter() for _ in c]
    for y in (0, 1):
        for w, n in k[y].items():
            s[y][toxicity.stem_of(w)] += n
    m = [sum(x.values()) for x in k]

    def mixed(of, whole, key, below, d=toxicity.DISCOUNT):
        over = lambda n: max(n - d, 0)
        left = [sum(map(over, x.values())) for x in of]
        b = 1 - min(a / n if n else 0 for a, n in zip(left, whole))
        return [(1 - b) * (over(x[key]) / a if a else 0) + b * q for x, a, q in zip(of, left, below)]

    def p(h, w):
        stem, both_k, both_s = toxicity.stem_of(w), k[0][w] + k[1][w], s[0][toxicity.stem_of(w)] + s[1][toxicity.stem_of(w)]
        q = mixed(s, m, stem, [(both_s or 1) / (sum(m) + 1)] * 2)
        g = (both_k or 1) / (both_s + 1) if both_s else 1
        of_h = [Counter({b: n for (a, b), n in x.items() if a == h}) for x in c]
        return mixed(of_h, [sum(x.values()) for x in of_h], w, mixed(k, m, w, [x * g for x in q]), toxicity.PAIR_DISCOUNT)

    stems = {toxicity.stem_of(w) for w in [*k[0], *k[1]]}
    return p, sorted({*k[0], *k[1]}), stems


def class_rows(n=60):
    r, rows = random.Random(8), []
    for i in range(n):
        y = i % 2
        pool = ["common", "words", "here", "and", "there"] + (["vilest", "vilesta", "vilestox"] if y else ["lovely", "garden"])
        rows.append((i, " ".join(r.choice(pool) if r.random() < 0.8 else f"w{r.randrange(200)}" for _ in range(30)), y))
    return rows


def test_toxicity_models_are_kneser_ney(spark):
    rows = class_rows()
    p, vocabulary, stems = plain_kneser_ney(rows)
    for h in (b"", b"common", b"vilest", b"never"):
        unknown = [f"{x.decode()}{'~' * 9}".encode() for x in stems if len(x) == toxicity.STEM]
        total = np.sum([p(h, w) for w in vocabulary], axis=0)
        assert (total < 1).all() and (total > 0.5).all()
        rest = np.sum([p(h, w) for w in unknown], axis=0) + np.array(p(h, b"quite unknown"))
        short = [x for x in stems if len(x) < toxicity.STEM]  # nothing but the word itself has such a stem
        assert np.allclose(total + rest, 1, atol=0.02 * len(short))
    counts = toxicity.counted(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    reader = toxicity.Reader(counts)
    for _, text, _ in [*rows[:12], (0, "never seen vilest words common garden gardening here here w3", 0)]:
        words = toxicity.words_of(text)
        want = np.array([p(h, w) for h, w in zip([b"", *words], words)]).T
        got = reader.likelihoods(words)
        assert np.allclose(np.log(got[1] / got[0]), np.log(want[1] / want[0]), atol=1e-6)
        ratio = np.log(want[1] / want[0])
        assert reader.evidence(text) == pytest.approx((ratio.mean(), max(ratio[i : i + 3].mean() for i in range(len(ratio) - 2))), abs=1e-6)


def test_own_counts_are_taken_out(spark):
    rows = class_rows()
    counts = toxicity.counted(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    for i in (0, 1, 7):
        others = toxicity.counted(spark.createDataFrame(rows[:i] + rows[i + 1 :], "doc_id bigint, text string, toxic int"))
        got, want = toxicity.without_own(counts, rows[i][1], rows[i][2]), toxicity.Reader(others).evidence(rows[i][1])
        assert got == pytest.approx(want, abs=0.05)


def test_training_rows_are_bounded_by_bytes(spark):
    rows = [row(i, "x " * 500) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    kept = toxicity.training_rows(documents(spark, rows + rows[:50]), labels, max_bytes=5000).collect()
    assert Counter(r["toxic"] for r in kept) == {0: 5, 1: 5} and not any(held(r["doc_id"], 4) for r in kept)


def brute_url(url, rules):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = max(
        ((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or not h) and re.match(re.escape(p).replace(r"\*", ".*"), path)),
        default=None,
    )
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme/en/", "http://", "://x.com/en/", "https://A.Example.COM/en/7x?q=/de/", "http://example.com/en/6", "http://badexample.com/en/7",
    "http://com/en/", "http://x.net/de/8", "http://example.net/de/8#a", "http://example.net/de/9", "http://x.org/es/1", "http://x.org/es",
    "http://x.org?y=/es/", "https://user@h.org:80/es/é/", "x://a.org/es/b://c.com/en/", "http://spam.example.com/shop/12/buy/now", "http://q.com//en/",
]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_url_rules(spark, bound):
    rules = [*URL_RULES, ("spam.example.com", "/shop/*/buy", "block"), ("", "/shop", "allow"), ("org", "", "allow"), ("x.+", "/(", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, host string, rule string")
    table = spark.createDataFrame([*rules, ("net", "/x", None)], "host string, path string, verdict string")
    got = url_rules.judged(pages, table, broadcast_bytes=bound).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: brute_url(u, rules) for i, u in enumerate(URLS * 2)}


def test_no_urls_or_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id bigint, url string")
    assert [tuple(r) for r in url_rules.judged(pages, none, "block").collect()] == [(1, "a.com", "/en/", None, "block")]
    assert url_rules.judged(pages.limit(0), none).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.com", "/en/1"), ("b.com", "/en/2"), ("example.com", "/fr/")], "host string, path string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    filed = {r["rule"]: r["token"] for r in url_rules.filed_rules(rules, urls).collect()}
    assert filed["example.com/en/7"] == "h:example" and filed["com/en/"] == "p:en"


def test_sketches_and_neighbours(spark):
    rows = odd_rows()
    got = sketches.with_neighbours(documents(spark, rows), range_bytes=2000).collect()
    order = documents(spark, rows).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or "") for r in order))
    want = Counter()
    for i, (some, doc_id, _, text) in enumerate(order):
        after, half = order[(i + 1) % len(order)][3], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (sketches.sketch(x) for x in (text, edited, after))
        want[doc_id if some else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketches.fingerprint(a), sketches.likeness(a, b)[0], sketches.likeness(a, c)[0]] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got) == want
    assert sketches.with_neighbours(empty(spark)).count() == 0
    one = sketches.with_neighbours(documents(spark, [row(1, "abcd")])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_sketches_of_text_ids_and_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sketches, "REPEATS", 5)
    rows = [(f"ä{i:03d}", words(i, 20)) for i in range(40)] + [("ä007", words(7, 20))] * 30 + [(None, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sketches.with_neighbours(docs, range_bytes=300).collect()
    order = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted((r["doc_id"] is not None, (r["doc_id"] or "").encode(), r["h"], r["text"]) for r in order)
    want = Counter()
    for i, (some, doc_id, _, text) in enumerate(order):
        after = order[(i + 1) % len(order)][3]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want[doc_id.decode() if some else None, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_short_texts_say_what_they_know():
    texts = [words(i, 8) for i in range(200)]
    long = " ".join(texts)
    whole = sketches.sketch(long)
    short = [sketches.sketch(t) for t in texts]
    assert {len(x) > 0 and not sketches._scaled(x) for x in short} == {True, False}
    assert all((sketches.likeness(x, whole)[1] is None) == (not sketches._scaled(x)) for x in short)
    assert all(sketches.likeness(x, whole)[1] >= 0.99 for x in short if sketches._scaled(x))
    joined = short[0]
    for x in short[1:]:
        joined = sketches.union(joined, x)
    inside = [h for h in whole if h in set(joined)]
    assert len(inside) >= 0.5 * len(whole) and sketches._scaled(joined)


def shingles(text, n=sketches.SHINGLE):
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


def test_sketches_estimate_and_merge(monkeypatch):
    a, b = words(1, 6000), words(1, 3000) + words(2, 200)
    x, y = sketches.sketch(a), sketches.sketch(b)
    jaccard = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    inside = len(shingles(a) & shingles(b)) / len(shingles(b))
    assert sketches.likeness(x, y)[0] == pytest.approx(jaccard, abs=0.03)
    assert sketches.likeness(y, x)[1] == pytest.approx(inside, abs=0.03)
    monkeypatch.setattr(sketches, "BLOCK", 1000)
    assert (sketches.sketch(a) == x).all()
    assert len(sketches.sketch("ab")) == 1 and len(sketches.sketch("")) == 0


def plain_lm(rows):
    """Tokens, pairs and their quantised counts in plain dictionaries."""
    tokens = [[*(r[1] or "").encode().lower().split(), b"\n"] for r in rows]
    train = [not held(r[0], 7) if r[0] is not None else True for r in rows]
    known = Counter(w for t, k in zip(tokens, train) if k for w in t)
    pairs = Counter(p for t, k in zip(tokens, train) if k for p in zip([None, *t], t))
    n, v = sum(known.values()), len(known)
    once, twice = (sum(c == i for c in known.values()) for i in (1, 2))
    discount = (once + 1) / (once + 2 * twice + 2)
    share = min(0.99, max(0.01, sum(c for c in pairs.values() if c > 1) / sum(pairs.values())))
    quantised = {p: 2 ** int(math.log2(c)) for p, c in pairs.items()}
    found, of = Counter(), Counter()
    for (h, w), q in quantised.items():
        found[h] += q
    for (h, w), c in pairs.items():
        of[h] += c

    def p(h, w):
        word = (known[w] - discount) / n if known[w] else discount * v / n
        return share * quantised.get((h, w), 0) / max(of[h], 1) + (1 - share * found[h] / max(of[h], 1)) * word

    assert all(sum(p(h, w) for w in [*known, "never"]) == pytest.approx(1, abs=1e-9) for h in [*list(known)[:40], None, "never"])
    out = []
    for t, k in zip(tokens, train):
        base = sum(math.log10((known[w] + 1) / (n + v + 1)) for w in t)
        out.append((not k, len(t), sum(known[w] > 0 for w in t), n, base, sum(math.log10(p(h, w)) for h, w in zip([None, *t], t))))
    return out


def lm_rows():
    return odd_rows() + [row(100 + i, words(i % 30, 40, 30)) for i in range(80)]


def lm_scores(spark, rows, **how):
    near = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    got = ngram_bloom.scored(documents(spark, rows), **how).collect()
    return Counter(near((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])) for r in got)


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "slice_entries": 50}])
def test_lm_scores(spark, how, monkeypatch):
    monkeypatch.setattr(ngram_bloom, "BITS", 64)  # false positives are rare enough for none here
    rows = lm_rows()
    near = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    assert lm_scores(spark, rows, **how) == Counter((r[0], *near(x)) for r, x in zip(rows, plain_lm(rows)))


def test_lm_scores_are_the_same_on_both_sides_of_the_broadcast_bound(spark, monkeypatch):
    """With the query's own bits, false positives and all; and with blocks of a few texts."""
    rows = lm_rows()
    for entries in (1 << 20, 50):
        want = lm_scores(spark, rows, slice_entries=entries)
        monkeypatch.setattr(ngram_bloom, "BLOCK", 300)
        assert lm_scores(spark, rows, broadcast_bytes=0, slice_entries=entries) == want
        monkeypatch.undo()
    exact = {r[0]: x[-1] for r, x in zip(rows, plain_lm(rows))}
    off = [abs(k[-1] - exact[k[0]]) / k[2] for k in want if k[0] is not None and k[0] >= 100]
    assert np.mean(off) < 0.03


def test_a_block_of_texts_asks_groups_of_slices(spark, monkeypatch):
    """Not each slice by itself: there are as many as the texts are large, and as many blocks."""
    tables, plain = [], ngram_bloom.written
    monkeypatch.setattr(ngram_bloom, "written", lambda df: tables.append(plain(df)) or tables[-1])
    rows = lm_rows()
    got = lm_scores(spark, rows, broadcast_bytes=0, slice_entries=10)
    slices = next(t for t in tables if "filter" in t.columns).select("kind", "slice").distinct().count()
    asked = next(t for t in tables if "text" in t.columns)
    requests = asked.filter("kind >= 0")
    most = max(r["count"] for r in requests.groupBy("part").count().collect())
    assert slices > 100 and most < slices / 4
    assert got == lm_scores(spark, rows, slice_entries=10)


def test_probabilities_add_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(ngram_bloom, "BITS", 64)
    docs = documents(spark, lm_rows()).withColumn("held_out", F.lit(False))
    counts = ngram_bloom.counted(docs)
    reader = ngram_bloom.Reader(*ngram_bloom._collected(counts))
    vocabulary = reader.of_words[0]
    never = np.array([12345], np.uint64)
    for left in [*vocabulary[:: max(1, len(vocabulary) // 30)], np.uint64(ngram_bloom.START), never[0]]:
        right = np.concatenate([vocabulary, never])
        lefts = np.full(len(right), left)
        held_, found = reader.lefts(ngram_bloom.codes_of(lefts))
        if left == ngram_bloom.END:
            continue  # nothing follows the end of a text
        _, p = ngram_bloom.logs(reader.words(right), held_, found, reader.pairs(ngram_bloom.pair_keys(lefts, right)), reader.plain)
        assert (10**p).sum() == pytest.approx(1, abs=1e-6)


def test_filter_finds_all_and_little_else():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 20_000).astype(np.uint64))
    counts = r.integers(1, 40, len(keys)).astype(np.int64)
    import pyarrow as pa

    table = pa.table({"kind": [1], "slice": [0], "keys": [keys.tobytes()], "counts": [counts.astype("<u4").tobytes()]})
    merged = ngram_bloom._merge(table)
    bits, sizes = np.frombuffer(merged["filter"][0].as_py(), np.uint8), np.array([merged["bits"][0].as_py()], np.uint64)
    probe = lambda k: ngram_bloom.probed(k, bits, sizes, np.zeros(1, np.int64), np.zeros(len(k), np.int64))
    exact = 2.0 ** np.floor(np.log2(counts))
    assert (probe(keys) >= exact).all() and (probe(keys) > exact).mean() < 0.03
    assert (probe(np.setdiff1d(r.integers(0, 1 << 63, 20_000).astype(np.uint64), keys)) > 0).mean() < 0.03


def test_lm_without_training_rows(spark):
    only = [row(i, "a b") for i in range(200) if held(i, 7)]
    got = ngram_bloom.scored(documents(spark, only)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(0, 0, 0.0, 0.0)}
    assert ngram_bloom.scored(empty(spark)).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string, block string, matrix int"


def conversations():
    r, rows = random.Random(2), []
    for conv in range(60):
        for turn in range(r.randrange(2, 9)):
            role = ("user", "assistant")[turn % 2]
            n = r.randrange(3, 12) if role == "user" else r.randrange(40, 90)
            text = words(conv * 100 + turn, n) + ("?" if role == "user" else "\n" + words(turn, 30))
            rows.append((conv, turn, role, text, "x", 1))
    return rows


def test_roles_are_recovered_and_rendered(spark):
    turns = conversations()
    raw = raw_transcripts(spark.createDataFrame(turns, TURNS))
    model = transcripts.fit(raw.filter("conv_id % 2 = 0"))
    got = {(r["conv_id"], r["turn"]): r for r in transcripts.parsed(raw, model).collect()}
    assert len(got) == len(turns)
    right = [got[c, t]["role"] == role and got[c, t]["opens"] for c, t, role, *_ in turns if c % 2]
    assert np.mean(right) > 0.97
    for conv in (1, 2, 3):
        mine = [(t, role, text) for c, t, role, text, *_ in turns if c == conv]
        if all(got[conv, t]["role"] == role for t, role, _ in mine):
            want = "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, role, text in mine)
            assert "".join(got[conv, t]["rendered"] for t, *_ in mine) == want


@pytest.mark.parametrize("fan", [2, 1024])
def test_blocks_give_the_path_over_all_lines(spark, fan, monkeypatch):
    monkeypatch.setattr(transcripts, "BLOCK", 3)
    monkeypatch.setattr(transcripts, "CROWD", 2)
    r = random.Random(4)
    lines = ["User: hi?", "Assistant: " + "b" * 99, "c " * 100, "", "System: x", "what?", "Bob: yes"]
    rows = [(1, t, "", "\n".join(r.choice(lines) for _ in range(r.randrange(1, 5))), "x", 1) for t in range(60)]
    rows += [(2, 7, "", f"{r.choice(lines)} {i}", "x", 1) for i in range(30)]
    pieces = spark.createDataFrame(rows, TURNS)
    rng = np.random.default_rng(2)
    log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None))
    model = transcripts.Model(log(6), log(6, 6), log(6, transcripts.CODES))
    got = transcripts.parsed(pieces, model, fan).collect()
    keyed = pieces.select("conv_id", "turn", "text", F.xxhash64("text").alias("h")).distinct().collect()
    for conv in (1, 2):
        order = sorted((x["turn"], x["h"], x["text"]) for x in keyed if x["conv_id"] == conv)
        codes = [transcripts.codes_of(t) for _, _, t in order]
        flat = [c for piece in codes for c in piece]
        best, back = model.start + model.show[:, flat[0]], []
        for c in flat[1:]:
            through = best[:, None] + model.move
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + model.show[:, c]
        states = [int(best.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states.reverse()
        want = Counter()
        for (turn, _, _), piece in zip(order, codes):
            own, states = states[: len(piece)], states[len(piece) :]
            want[turn, transcripts.ROLES[own[0] // 2], len(piece)] += 1
        assert Counter((x["turn"], x["role"], x["n_lines"]) for x in got if x["conv_id"] == conv) == want


def test_odd_transcripts(spark):
    raw = raw_transcripts(spark.createDataFrame(conversations(), TURNS))
    model = transcripts.fit(raw)
    odd = [(None, None, "user", None, "x", 1), (None, 1, "x", "", "x", 1), (1, 1, "user", "a\nb", "x", 1), (1, 1, "user", "a\nb", "x", 1), (1, 1, None, "c", "x", 1)]
    got = transcripts.parsed(spark.createDataFrame(odd, TURNS), model).collect()
    assert len(got) == 4
    for conv in (None, 1):
        text = "".join(r["rendered"] for r in got if r["conv_id"] == conv)
        assert text.count("<|im_end|>") == text.count("<|im_start|>") >= 1
    assert transcripts.parsed(spark.createDataFrame([], TURNS), model).count() == 0


def covered(rows, n=suffixes.MIN_WORDS):
    """Words in a window of n words that another document holds."""
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append((r[1] or "").encode().lower().split())
    own = defaultdict(set)
    for d, bodies in texts.items():
        for w in bodies:
            for i in range(len(w) - n + 1):
                own[tuple(w[i : i + n])].add(d)
    out = defaultdict(set)
    for d, bodies in texts.items():
        for w in bodies:
            for i in range(len(w) - n + 1):
                if len(own[tuple(w[i : i + n])]) > 1:
                    out[d].update(range(i, i + n))
    return out


def passages():
    """Shared passages of 45 to 80 words in the midst of other words, some of them common to many."""
    rows = []
    for i in range(60):
        size = 45 + i % 8 * 5
        shared = words(900 + i % 8, 90).split()[:size]
        rows.append(row(i, " ".join([words(i, 10 + i), *shared, words(300 + i, 40)])))
    return rows + [row(100 + i, words(50, 120)) for i in range(5)] + [row(200, " ".join([words(7, 60)] * 3))]


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}])
def test_repeated_passages(spark, how):
    rows = odd_rows() + passages()
    got = defaultdict(set)
    for r in suffixes.repeated_spans(documents(spark, rows), **how).collect():
        assert r["other_id"] != r["doc_id"] and not got[r["doc_id"]] & set(range(r["start"], r["start"] + r["n_words"]))
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    want = covered(rows)
    assert set(got) == {d for d in want if want[d]}
    missing = sum(len(want[d] - got[d]) for d in want)
    extra = sum(len(got[d] - want[d]) for d in got)
    assert missing <= 0.005 * sum(map(len, want.values())) and extra == 0


def test_more_shared_keys_than_fit_still_thin_out_the_second_pass(spark, monkeypatch):
    """Beyond the bound a table of bits takes the keys' place: the same spans, and few suffixes are carried in vain."""
    tables, plain = [], suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df: tables.append(plain(df)) or tables[-1])
    found, carried = [], []
    for size in (suffixes.BROADCAST_BYTES, 1024, 0):
        tables.clear()
        spans = suffixes.repeated_spans(documents(spark, passages()), size)
        found.append(sorted((r["doc_id"], r["start"], r["n_words"]) for r in spans.collect()))
        carried.append(next(t for t in tables if "at" in t.columns).count())
    assert found[0] and found[0] == found[1] == found[2]
    assert carried[0] <= carried[1] < (carried[0] + carried[2]) / 2


def test_crowded_keys_are_decided_exactly(spark):
    """Three texts whose neighbours in both orders match too little, though two of them match enough."""
    tail, head = words(70, 40), words(71, 40).split()
    key = words(72, suffixes.KEY)
    rows = [
        row(1, " ".join([*head[-8:], key, " ".join(tail.split()[:8])])),
        row(2, " ".join(["x", *head[-8:], key, " ".join(tail.split()[:7]), words(73, 30)])),
        row(3, " ".join([*words(74, 30).split(), *head[-2:], key, tail])),
    ]
    got = {r["doc_id"] for r in suffixes.repeated_spans(documents(spark, rows)).collect()}
    assert got == {d for d, w in covered(rows).items() if w}


def test_no_passages(spark):
    assert suffixes.repeated_spans(empty(spark)).count() == 0
    assert suffixes.repeated_spans(documents(spark, [row(1, words(1, 300)), row(2, words(2, 300))])).count() == 0


def test_passages_are_cut_out_of_later_documents(spark):
    docs = documents(spark, passages()[:20])
    out = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(docs).collect()}
    assert out[6] == passages()[6][1] and len(out) == 20
    spans = {r["doc_id"]: r for r in suffixes.repeated_spans(docs).collect()}
    late = spans[14]
    whole = passages()[14][1].split()
    assert out[14].split() == whole[: late["start"]] + whole[late["start"] + late["n_words"] :]


@pytest.mark.parametrize("size", [50, 55, 70])
def test_one_of_many_holders_keeps_the_passage(spark, size):
    passage = words(900, size)
    rows = [row(i, " ".join([words(i, 30), passage, words(300 + i, 30)])) for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(documents(spark, rows)).collect()}
    assert out == {i: text if i == 0 else f"{words(i, 30)} {words(300 + i, 30)}" for i, text, *_ in rows}


def test_the_broadcast_takes_slices_out_of_their_rows():
    """Values are copied once and leave their rows, also where there are none."""
    rows = [{"slice": 0, "keys": np.array([5, 9], "<u8").tobytes()}, {"slice": 1, "keys": b""}, {"slice": 2, "keys": np.array([11], "<u8").tobytes()}]
    assert ngram_bloom._bytes_of(rows, "keys", "<u8").tolist() == [5, 9, 11] and all("keys" not in r for r in rows)
    assert ngram_bloom._bytes_of([], "keys", "<u8").tolist() == []
