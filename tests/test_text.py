import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrain.functions import text as tx
from citegrain.functions import values as vl
from citegrain.operators import chunks

FEW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
ODD = st.text(alphabet="aB9_ \t\n\r\x1c\x85\xa0 　检索é;|.,", max_size=30)


def one(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [tuple(r) for r in df.select(*columns).collect()]


@FEW
@given(st.lists(ODD, min_size=1, max_size=20))
def test_strip_and_tokens_as_in_python(spark, values):
    got = one(spark, values, tx.strip("c"), tx.rstrip("c"), tx.tokens("c"))
    pattern = re.compile(r"[一-鿿]+|[A-Za-z0-9_]+")
    assert got == [(v.strip(), v.rstrip(), pattern.findall(v.lower())) for v in values]


@FEW
@given(st.lists(ODD, min_size=1, max_size=20), st.integers(1, 12))
def test_previews_as_in_python(spark, values, n):
    def cut(v):
        flat = v.replace("\n", " ")
        return flat[:n].rstrip() + "..." if len(flat) > n else flat

    got = one(spark, values, tx.preview("c", n), tx.hard_preview("c", n))
    assert got == [(cut(v), v.replace("\n", " ")[:n]) for v in values]


@FEW
@given(st.lists(ODD, min_size=1, max_size=20))
def test_lists_as_in_python(spark, values):
    got = one(spark, values, tx.split_list("c"), tx.split_set("c"))
    for v, (items, members) in zip(values, got):
        assert items == [x.strip() for x in v.split(";") if x.strip()]
        assert sorted(members) == sorted({x.strip() for x in v.split("|") if x.strip()})


def test_labels_and_blocks(spark):
    assert one(spark, ["t"], tx.chunk_label(F.lit("a.txt"), F.lit(3)), tx.context_block(F.lit("a#chunk3"), "c")) == [
        ("a.txt#chunk3", "[a#chunk3] t")
    ]


def test_paragraphs(spark):
    docs = spark.createDataFrame(
        [("a.txt", "a\n\n\n b\n\n\n\nc"), ("b.txt", " \n\n\t\n\n"), ("c.txt", "one\nline")],
        "doc_name string, text string",
    )
    rows = [tuple(r) for r in chunks.paragraph_chunks(docs).orderBy("doc_name", "chunk_id").collect()]
    assert rows == [("a.txt", 0, "a"), ("a.txt", 1, "b"), ("a.txt", 2, "c"), ("c.txt", 0, "one\nline")]
    assert tuple(chunks.corpus_counts(chunks.paragraph_chunks(docs)).first()) == (4, 2)
    dotted = spark.createDataFrame([("d", "x.|y.|z")], "doc_name string, text string")
    assert [r.text for r in chunks.paragraph_chunks(dotted, ".|").collect()] == ["x", "y", "z"]


def test_lenient_casts(spark):
    cells = ["12", " -7 ", "12.5", "x", "", None, "1e3", "1d", "nan", "9" * 12]
    got = one(spark, cells, vl.lenient_int("c"), vl.lenient_float("c"))
    assert [g[0] for g in got] == [12, -7, 0, 0, 0, 0, 0, 0, 0, int("9" * 12)]
    floats = [g[1] for g in got]
    assert floats[:8] == [12.0, -7.0, 12.5, 0.0, 0.0, 0.0, 1000.0, 0.0]
    assert floats[8] != floats[8]


def test_lenient_timestamps(spark):
    cells = ["2026-02-16T17:21:12+00:00", "2026-02-16T17:21:12.5Z", "2026-02-16T19:21:12+02:00", "soon", "", None]
    shown = F.date_format(vl.lenient_timestamp("c"), "HH:mm:ss.S")
    assert [r[0] for r in one(spark, cells, shown)] == ["17:21:12.0", "17:21:12.5", "17:21:12.0", None, None, None]


def test_keyword_recall(spark):
    rows = spark.createDataFrame(
        [("Top-K 检索", ["检索", "生成", "Top-K"]), ("x", []), ("aa", ["a", "a", "b", "A"])],
        "answer string, kws array<string>",
    )
    got = [r[0] for r in rows.select(vl.keyword_recall("answer", "kws")).collect()]
    assert got == [2 / 3, 0.0, 0.5]
    assert [r[0] for r in rows.select(vl.any_keyword("answer", "kws")).collect()] == [True, False, True]


def test_times_are_whole_iso_times(spark):
    good = ["2026-02-16", "2026-02-16T12:30", "2026-02-16 12:30:01", "2026-02-16T12:30:01.25Z", "2026-02-16T12:30:01+02:00", " 2026-02-16T12:30:01,5 "]
    bad = ["12:30", "T12:30", "2024", "2024-05", "2024-1-1", "2026-02-30", "now", "2026-02-16T", "", "2026-02-16T12:30:01 x"]
    got = one(spark, good + bad + [None], vl.lenient_timestamp("c").isNotNull())
    assert [r[0] for r in got] == [True] * len(good) + [False] * (len(bad) + 1)


def test_numbers_with_underscores(spark):
    values = ["1_000", "_1", "1_", "1__0", "-1_0", "1_0.5_0", "12", "x"]

    def parsed(kind, v):
        try:
            return kind(v)
        except ValueError:
            return kind(0)

    got = one(spark, values, vl.lenient_int("c"), vl.lenient_float("c"))
    assert got == [(parsed(int, v), parsed(float, v)) for v in values]


def test_sliding_chunks(spark):
    texts = ["", "ab", "abcdefghij", "abcdefghijk", "🙂é" * 9, "x\r\n" * 11, None]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_name string, text string")
    for size, overlap in ((10, 4), (5, 0), (7, 6), (4, 2)):
        got = {(r.doc_name, r.chunk_id): (r.chunk_start, r.chunk_end, r.text) for r in chunks.sliding_chunks(docs, size, overlap).collect()}
        want, step = {}, size - overlap
        for i, t in enumerate(texts):
            start = 0
            while t and (start == 0 or start - step + size < len(t)):
                want[f"d{i}", start // step] = (start, min(start + size, len(t)), t[start : start + size])
                start += step
        assert got == want
