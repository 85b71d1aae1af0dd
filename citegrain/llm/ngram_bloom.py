"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs cover all training documents. A pair seen c times is quantised to
level 1 + floor(log2 c) and put into the filter once for each level up to its own; a reader probes
levels 1, 2, ... until one is missing, and takes q = 2 ** (level - 1) as the count, which is never above the
true one but for the filter's false positives (about one in a hundred at `BITS` bits an entry, and
half as often for every further level).

p(w | h) = a * q(h, w) / c(h) + (1 - a * Q(h) / c(h)) * p(w), where Q(h) is the sum of q over the pairs of h, so that
what the quantised counts leave of h goes to p(w) and all adds up to one. After a word that training does not
know, it is p(w). The share a is what the training pairs would find of themselves if each was left out once:
the part of them in pairs seen twice or more. p(w) is (c - D) / N for known words, and D * V / N for all unknown ones
together, with the absolute discount D from the words seen once and twice. A pair is filed under 32 bits of the hash of
either word, and h stands for all words with its 32 bits in c(h) and Q(h).

Counting is one pass: each task sums sorted runs of 64-bit hashes, cut into slices of the hash range
that are merged apart; every slice has its own segment of the filter. Word counts, the sums of the words' pairs and
the filter are broadcast together if they hold at most `broadcast_bytes`. Beyond that they stay where they are, and texts
are scored by the same code in blocks of `BLOCK` tokens: the keys that a block asks for travel to their slices, are looked
up or probed there, bit for bit as in the broadcast, and the answers travel back to the block. A block asks 2 ** `GROUP_BITS`
slices at once, and what many blocks ask of them is answered together: one by one, blocks times slices would grow with the
square of the texts.

Words are split at ASCII white space, A-Z lower; every text ends in an end token. Null and empty
texts are that token alone; long texts are taken whole. Rows that repeat a document are scored alike (and counted again in
training). Without training rows every token is unknown and has probability 1. An empty table has no scores. Columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citegrain.plans.workdir import written

SEED = 42
BITS = 10  # of the filter for each entry
PROBES = 5
BROADCAST_BYTES = 256 << 20
#: Entries that a slice of the hash range is meant to hold at most.
SLICE_ENTRIES = 1 << 19
#: Slices asked at once: 2 to this power.
GROUP_BITS = 4
#: Tokens that a task counts or scores at once.
BLOCK = 1 << 19
END = xxhash.xxh64_intdigest(b"\n", SEED)  # no word has white space
START = xxhash.xxh64_intdigest(b" ", SEED)
WORDS, PAIRS, LEFTS = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def token_keys(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    digest = xxhash.xxh64_intdigest
    return np.fromiter([*(digest(w, SEED) for w in words), END], dtype=np.uint64, count=len(words) + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def codes_of(keys: np.ndarray) -> np.ndarray:
    """The 32 bits of a word's key under which its pairs are filed."""
    return keys >> np.uint64(32)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return codes_of(left) << np.uint64(32) | codes_of(mixed(right))


def slices_of(kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """The slice of the hash range that each key belongs to."""
    if not bits:
        return np.zeros(len(keys), np.int64)
    with np.errstate(over="ignore"):
        spread = keys if kind == WORDS else mixed(keys * np.uint64(0x9E3779B97F4A7C15))
    return (spread >> np.uint64(64 - bits)).astype(np.int64)


def left_of(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before each, START at the head of a text. *ends*: where each text stops."""
    left = np.empty_like(keys)
    left[1:] = keys[:-1]
    left[np.concatenate([[0], ends[:-1]]).astype(np.int64)] = START
    return left


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """floor(log2 count), exactly."""
    return (np.frexp(counts.astype(np.float64))[1] - 1).astype(np.int64)


def positions(keys: np.ndarray, level: int, probe: int, bits: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = np.uint64((level * 64 + probe + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)
        return mixed(mixed(keys ^ salt) + salt) % bits


def blocks(batches, size: int = BLOCK):
    """(rows, keys, ends) of whole texts, cut whenever *size* tokens have come together."""
    for batch in batches:
        first, held, ends, at = 0, [], [], 0
        for i, text in enumerate(batch.column("text")):
            held.append(token_keys(text.as_py()))
            at += len(held[-1])
            ends.append(at)
            if at >= size or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), np.concatenate(held), np.array(ends)
                first, held, ends, at = i + 1, [], [], 0


def _sliced(kind: int, keys: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """The places of sorted *keys* in each slice that has some."""
    owner = slices_of(kind, keys, bits)
    order = np.argsort(owner, kind="stable")
    present, starts = np.unique(owner[order], return_index=True)
    return [(int(s), order[a:b]) for s, a, b in zip(present, starts, [*starts[1:], len(keys)])]


def _counting(bits: int):
    """Sums of words and pairs of each block, by slice of the hash range."""
    names = ["kind", "slice", "keys", "counts"]

    def rows_of(kind: int, keys: np.ndarray):
        keys, counts = np.unique(keys, return_counts=True)
        return [(kind, s, keys[at].tobytes(), counts[at].astype("<u4").tobytes()) for s, at in _sliced(kind, keys, bits)]

    def count(batches):
        for _, keys, ends in blocks(batches):
            rows = rows_of(WORDS, keys) + rows_of(PAIRS, pair_keys(left_of(keys, ends), keys))
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return count


_MERGED = (
    "kind int, slice int, keys binary, counts binary, filter binary, bits bigint, lefts binary, sums binary, "
    "distinct bigint, total bigint, once bigint, twice bigint"
)
_BINARY = ("keys", "counts", "filter", "lefts", "sums")


def _row_table(row: dict, schema: str) -> pa.Table:
    types = {"kind": pa.int32(), "slice": pa.int32(), **dict.fromkeys(_BINARY, pa.binary())}
    return pa.table({n: pa.array([row[n]], types.get(n, pa.int64())) for n in (c.split()[0] for c in schema.split(", "))})


def _merge(table: pa.Table) -> pa.Table:
    """A slice's exact counts of words, or the filter segment of its pairs; and what its keys add to their left words."""
    kind, part = table.column("kind")[0].as_py(), table.column("slice")[0].as_py()
    joined = lambda name, dtype: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), dtype=dtype)
    keys, counts = summed(joined("keys", "<u8"), joined("counts", "<u4").astype(np.int64))
    row = {
        "kind": kind, "slice": part, "distinct": len(keys), "total": int(counts.sum()), "filter": b"", "bits": 0,
        "once": int((counts == 1).sum()), "twice": int((counts == 2).sum()),
    }
    if kind == PAIRS:
        level = levels_of(counts) + 1
        size = max(64, int(level.sum()) * BITS + 7 >> 3 << 3)
        marked = np.zeros(size, dtype=bool)
        for step in range(1, int(level.max(initial=0)) + 1):
            for probe in range(PROBES):
                marked[positions(keys[level >= step], step, probe, np.uint64(size))] = True
        row |= {"filter": np.packbits(marked).tobytes(), "bits": size, "keys": b"", "counts": b""}
        lefts, sums = summed(codes_of(keys), np.int64(1) << (level - 1))
    else:
        row |= {"keys": keys.tobytes(), "counts": counts.astype("<u8").tobytes()}
        # every token is to the left of another but the end of a text, for which its start is
        lefts, sums = summed(codes_of(np.where(keys == END, np.uint64(START), keys)), counts)
    return _row_table(row | {"lefts": lefts.astype("<u4").tobytes(), "sums": sums.astype("<i8").tobytes()}, _MERGED)


def _left_rows(batches):
    for batch in batches:
        for kind, lefts, sums in zip(batch.column("kind").to_pylist(), batch.column("lefts"), batch.column("sums")):
            lefts, sums = np.frombuffer(lefts.as_py(), "<u4").astype(np.int64), np.frombuffer(sums.as_py(), "<i8")
            none = np.zeros(len(sums), np.int64)
            columns = [lefts, *((sums, none) if kind == WORDS else (none, sums))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["code", "held", "found"])


class Counts:
    """Totals of the training tokens, and where the merged slices are."""

    def __init__(self, slices: DataFrame, slice_bits: int):
        self.slices, self.slice_bits = slices, slice_bits
        sums = {r["kind"]: r for r in slices.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("distinct", "total", "once", "twice", "bits")]).collect()}
        words, pairs = sums.get(WORDS), sums.get(PAIRS)
        self.tokens, self.kinds = (words["total"], words["distinct"]) if words else (0, 0)
        once, twice = (words["once"], words["twice"]) if words else (0, 0)
        self.discount = (once + 1) / (once + 2 * twice + 2)
        self.share = min(0.99, max(0.01, (pairs["total"] - pairs["once"]) / pairs["total"])) if pairs else 0.01
        self.bytes = self.kinds * 36 + (pairs["bits"] // 8 if pairs else 0)
        lefts = slices.select("kind", "lefts", "sums").mapInArrow(_left_rows, "code bigint, held bigint, found bigint")
        #: How often each left word is one (held), and the sum of its pairs' quantised counts (found).
        self.lefts = written(lefts.groupBy("code").agg(F.sum("held").alias("held"), F.sum("found").alias("found")))

    def plain(self) -> tuple:
        return self.tokens, self.kinds, self.discount, self.share


def counted(docs: DataFrame, slice_entries: int = SLICE_ENTRIES) -> Counts:
    """Word and pair counts of all rows of *docs*."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, total / 6 / slice_entries))))  # a word and its gap take about six bytes
    parts = docs.select("text").mapInArrow(_counting(bits), "kind int, slice int, keys binary, counts binary")
    return Counts(written(parts.groupBy("kind", "slice").applyInArrow(_merge, _MERGED)), bits)


def logs(known: np.ndarray, held: np.ndarray, found: np.ndarray, pair: np.ndarray, plain: tuple) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of tokens by the base and by the model, from the count of the token, the count of the token
    before it and the sum of its pairs, and the count of both together (0: not seen)."""
    tokens, kinds, discount, share = plain
    base = np.log10((known + 1) / (tokens + kinds + 1))
    if not tokens:
        return base, np.zeros(len(known))
    word = np.where(known > 0, known - discount, discount * kinds) / tokens
    of = np.maximum(held, 1)
    return base, np.log10(share * np.minimum(pair, held) / of + (1 - share * found / of) * word)


def looked_up(keys: np.ndarray, table: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of *keys* in a sorted table, 0 for those that it does not have."""
    if not len(table):
        return [np.zeros(len(keys)) for _ in values]
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return [np.where(table[at] == keys, v[at], 0).astype(np.float64) for v in values]


def probed(keys: np.ndarray, filter_bytes: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """2 ** (level - 1) of each pair, 0 for those that are in no level. *sizes* and *offsets* of the segments, by *owner*."""
    found = np.zeros(len(keys))
    left, level = np.flatnonzero(sizes[owner] > 0), 1
    while len(left):
        for probe in range(PROBES):
            own = owner[left]
            at = positions(keys[left], level, probe, sizes[own]).astype(np.int64)
            byte = filter_bytes[offsets[own] + (at >> 3)]
            left = left[(byte >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
        found[left] = 2.0 ** (level - 1)
        level += 1
    return found


class Reader:
    """Word counts, left words and the filter, all here."""

    def __init__(self, plain, slice_bits, words, lefts, filter_bytes, sizes, offsets):
        self.plain, self.slice_bits, self.of_words, self.of_lefts = plain, slice_bits, words, lefts
        self.filter, self.sizes, self.offsets = filter_bytes, sizes, offsets

    def words(self, keys: np.ndarray) -> np.ndarray:
        return looked_up(keys, *self.of_words)[0]

    def lefts(self, codes: np.ndarray) -> list[np.ndarray]:
        return looked_up(codes, *self.of_lefts)

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        return probed(keys, self.filter, self.sizes, self.offsets, slices_of(PAIRS, keys, self.slice_bits))


class Answers:
    """What a block asked for, as its slices answered."""

    def __init__(self, plain, answers: dict[int, list[np.ndarray]]):
        self.plain, self.answers = plain, answers

    def _of(self, kind: int, keys: np.ndarray) -> list[np.ndarray]:
        table, *values = self.answers[kind]
        return looked_up(keys, table, *values)

    def words(self, keys: np.ndarray) -> np.ndarray:
        return self._of(WORDS, keys)[0]

    def lefts(self, codes: np.ndarray) -> list[np.ndarray]:
        return self._of(LEFTS, codes)

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        return self._of(PAIRS, keys)[0]


def scores(reader, keys: np.ndarray, ends: np.ndarray):
    """n_tokens, n_known, base and model score of every text."""
    left = left_of(keys, ends)
    kinds, back = np.unique(keys, return_inverse=True)
    known = reader.words(kinds)[back]
    codes, back = np.unique(codes_of(left), return_inverse=True)
    held, found = (x[back] for x in reader.lefts(codes))
    base, model = logs(known, held, found, reader.pairs(pair_keys(left, keys)), reader.plain)
    heads = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    add = lambda x: np.add.reduceat(x, heads)
    return np.diff(np.concatenate([[0], ends])), add((known > 0).astype(np.int64)), add(base), add(model)


_SCORES = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _score_rows(reader, rows: pa.RecordBatch, keys: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    found = [pa.array(x, t) for x, t in zip(scores(reader, keys, ends), _SCORES.values())]
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), *found], names=["doc_id", "held_out", *_SCORES])


def _score_schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _bytes_of(rows: list, name: str, dtype: str) -> np.ndarray:
    """A binary column's values, one after the other, taken out of the rows so that no second copy stays."""
    whole = np.empty(sum(len(r[name]) for r in rows), np.uint8)
    at = 0
    for row in rows:
        value = row.pop(name)
        whole[at : at + len(value)] = np.frombuffer(value, np.uint8)
        at += len(value)
    return whole.view(dtype)


def _collected(counts: Counts) -> tuple:
    """The arrays to broadcast; their size was checked. A slice comes at a time, so the driver holds them once."""

    def read(kind: int, *names: str) -> list[dict]:
        rows = counts.slices.filter(F.col("kind") == kind).select("slice", *names).toLocalIterator()
        return sorted(({c: r[c] for c in ("slice", *names)} for r in rows), key=lambda r: r["slice"])

    words = read(WORDS, "keys", "counts")
    word_table = (_bytes_of(words, "keys", "<u8"), _bytes_of(words, "counts", "<u8"))
    del words
    pairs = read(PAIRS, "filter", "bits")
    sizes = np.zeros(1 << counts.slice_bits, dtype=np.uint64)
    offsets = np.zeros(1 << counts.slice_bits, dtype=np.int64)
    at = 0
    for row in pairs:
        sizes[row["slice"]], offsets[row["slice"]] = row["bits"], at
        at += row["bits"] // 8
    filter_bytes = _bytes_of(pairs, "filter", "u1")
    lefts = counts.lefts.toArrow()
    order = np.argsort(lefts.column("code").to_numpy())
    code, held, found = (lefts.column(c).to_numpy()[order] for c in ("code", "held", "found"))
    left_table = (code.view(np.uint64), held, found)
    return counts.plain(), counts.slice_bits, word_table, left_table, filter_bytes, sizes, offsets


def _with_broadcast(docs: DataFrame, counts: Counts) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_collected(counts))

    def score(batches):
        reader = Reader(*shared.value)
        for rows, keys, ends in blocks(batches):
            yield _score_rows(reader, rows, keys, ends)

    return docs.mapInArrow(score, _score_schema(docs))


_ASKED = "part bigint, kind int, slice_group int, keys binary, doc_id {0}, held_out boolean, text string"


def _asking(bits: int, id_type: pa.DataType):
    """Texts with the number of their block (kind -1), and the sorted keys that the block asks of each group of slices."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), id_type, pa.bool_(), pa.string()]
    names = [c.split()[0] for c in _ASKED.split(", ")]

    def ask(batches):
        part = TaskContext.get().partitionId() << 32
        for rows, keys, ends in blocks(batches):
            left = left_of(keys, ends)
            wanted = {WORDS: keys, PAIRS: pair_keys(left, keys), LEFTS: codes_of(left) << np.uint64(32)}
            asked = []
            for kind, own in wanted.items():
                own = np.unique(own)
                asked += [(kind, s, own[at].tobytes()) for s, at in _sliced(kind, own, bits)]
            n, m = len(asked), rows.num_rows
            columns = [[part] * n, *zip(*asked), *[[None] * n] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            own = [pa.array([x] * m, t) for x, t in zip((part, -1, 0, None), types)]
            texts = [rows.column(c).cast(t) for c, t in zip(("doc_id", "held_out", "text"), types[4:])]
            yield pa.RecordBatch.from_arrays(own + texts, names=names)
            part += 1

    return ask


#: part: the block that asks, or the slice within its group.
_TABLE = "kind int, slice_group int, is_asked int, part bigint, keys binary, counts binary, more binary, bits bigint"
_ANSWER = "part bigint, kind int, keys binary, counts binary, more binary"


def _left_group(table: pa.Table) -> pa.Table:
    codes, held, found = (table.column(c).to_numpy() for c in ("code", "held", "found"))
    order = np.argsort(codes)
    return pa.table({
        "kind": pa.array([LEFTS], pa.int32()), "slice_group": pa.array([table.column("slice_group")[0].as_py()], pa.int32()),
        "keys": [(codes[order].astype(np.uint64) << np.uint64(32)).tobytes()], "counts": [held[order].astype("<u8").tobytes()],
        "more": [found[order].astype("<u8").tobytes()],
    })


def _group_reader(kind: int, held: list[dict], bits: int, group_bits: int):
    """The values of keys of one group, from its slices' rows."""
    held = sorted(held, key=lambda r: r["part"])  # words are in order then from one slice to the next
    if kind != PAIRS:
        names = ("keys", "counts", "more") if kind == LEFTS else ("keys", "counts")
        tables = [np.frombuffer(b"".join(r[c] for r in held), "<u8") for c in names]
        return lambda keys: looked_up(keys, *tables)
    sizes, offsets = np.zeros(1 << group_bits, np.uint64), np.zeros(1 << group_bits, np.int64)
    at = 0
    for row in held:
        sizes[row["part"]], offsets[row["part"]] = row["bits"], at
        at += len(row["keys"])
    filter_bytes = np.frombuffer(b"".join(r["keys"] for r in held), np.uint8)
    return lambda keys: [probed(keys, filter_bytes, sizes, offsets, slices_of(PAIRS, keys, bits) & (1 << group_bits) - 1)]


def _answering(bits: int, group_bits: int):
    """Each group's own rows come first, then what blocks ask of it, which is answered `BLOCK` keys at a time."""
    names, types = [c.split()[0] for c in _ANSWER.split(", ")], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def answers(kind: int, reader, asked: list[tuple]) -> pa.RecordBatch:
        values = reader(np.frombuffer(b"".join(keys for _, keys in asked), "<u8"))
        ends = np.cumsum([len(keys) >> 3 for _, keys in asked])[:-1]
        parts = [[x.astype("<f8").tobytes() for x in np.split(v, ends)] for v in values]
        columns = [[part for part, _ in asked], [kind] * len(asked), [keys for _, keys in asked], parts[0]]
        columns.append(parts[1] if len(parts) > 1 else [None] * len(asked))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def answer(batches):
        whose, held, reader, asked, size = None, [], None, [], 0
        for batch in batches:
            column = {c: batch.column(c) for c in ("part", "keys", "counts", "more", "bits")}
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "slice_group", "is_asked")))
            for i, (kind, group, is_asked) in enumerate(rows):
                if asked and ((kind, group) != whose or size >= BLOCK):
                    yield answers(whose[0], reader, asked)
                    asked, size = [], 0
                if (kind, group) != whose:
                    whose, held, reader = (kind, group), [], None
                if not is_asked:
                    held.append({c: x[i].as_py() for c, x in column.items()})
                    continue
                if reader is None:
                    reader, held = _group_reader(kind, held, bits, group_bits), []
                asked.append((column["part"][i].as_py(), column["keys"][i].as_py()))
                size += len(asked[-1][1]) >> 3
        if asked:
            yield answers(whose[0], reader, asked)

    return answer


def _answered(plain: tuple):
    """Scores of a block's texts, which come behind the answers to it."""

    def score(batches):
        part, held, reader = None, {}, None
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | ((kinds[1:] < 0) != (kinds[:-1] < 0))) + 1), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    part, held, reader = parts[a], {WORDS: [], PAIRS: [], LEFTS: []}, None
                rows = batch.slice(int(a), int(b - a))
                if kinds[a] >= 0:
                    for kind, *values in zip(*(rows.column(c).to_pylist() for c in ("kind", "keys", "counts", "more"))):
                        held[kind].append(values)
                    continue
                reader = reader or _reader(plain, held)
                for texts, keys, ends in blocks([rows]):
                    yield _score_rows(reader, texts, keys, ends)

    return score


def _reader(plain: tuple, held: dict[int, list]) -> Answers:
    answers = {}
    for kind, rows in held.items():
        keys = np.frombuffer(b"".join(r[0] for r in rows), "<u8")
        order = np.argsort(keys)
        values = [np.frombuffer(b"".join(r[i] for r in rows), "<f8")[order] for i in ((1, 2) if kind == LEFTS else (1,))]
        keys = keys[order]
        answers[kind] = [codes_of(keys) if kind == LEFTS else keys, *values]
    return Answers(plain, answers)


def _by_slices(docs: DataFrame, counts: Counts) -> DataFrame:
    """The same scores where the counts lie: keys travel to their slices, and the answers back to the texts."""
    kind = docs.schema["doc_id"].dataType
    schema = _ASKED.format(kind.simpleString())
    group_bits = min(GROUP_BITS, counts.slice_bits)
    groups = counts.slice_bits - group_bits
    asked = written(docs.select("doc_id", "held_out", "text").mapInArrow(_asking(groups, to_arrow_type(kind)), schema))
    group, place = F.shiftright("slice", group_bits).alias("slice_group"), (F.col("slice") % (1 << group_bits)).cast("bigint").alias("part")
    of = lambda kind, keys, counts_, bits: counts.slices.filter(F.col("kind") == kind).select(
        "kind", group, place, keys.alias("keys"), counts_.alias("counts"), F.lit(None).cast("binary").alias("more"), bits.alias("bits")
    )
    none = F.lit(None)
    owner = F.shiftrightunsigned(F.col("spread"), 64 - groups).cast("int") if groups else F.lit(0)
    lefts = _with_spread(counts.lefts).withColumn("slice_group", owner).drop("spread").groupBy("slice_group").applyInArrow(
        _left_group, "kind int, slice_group int, keys binary, counts binary, more binary"
    ).withColumns({"bits": none.cast("bigint"), "part": F.lit(0).cast("bigint")})
    tables = of(WORDS, F.col("keys"), F.col("counts"), none.cast("bigint"))
    tables = tables.unionByName(of(PAIRS, F.col("filter"), none.cast("binary"), F.col("bits"))).unionByName(lefts)
    tables = tables.withColumn("is_asked", F.lit(0))
    questions = asked.filter("kind >= 0").select("kind", "slice_group", "part", "keys").withColumns(
        {"is_asked": F.lit(1), "counts": none.cast("binary"), "more": none.cast("binary"), "bits": none.cast("bigint")}
    )
    names = [c.split()[0] for c in _TABLE.split(", ")]
    both = tables.select(*names).unionByName(questions.select(*names)).repartition("kind", "slice_group")
    both = both.sortWithinPartitions("kind", "slice_group", "is_asked")
    answers = both.mapInArrow(_answering(counts.slice_bits, group_bits), _ANSWER)
    texts = asked.filter("kind < 0").select(
        "part", "kind", *[none.cast("binary").alias(c) for c in ("keys", "counts", "more")], "doc_id", "held_out", "text"
    )
    answers = answers.select("*", none.cast(kind).alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("string").alias("text"))
    rows = answers.unionByName(texts).repartition("part").sortWithinPartitions("part", F.desc("kind"))
    return rows.mapInArrow(_answered(counts.plain()), _score_schema(docs))


def _with_spread(lefts: DataFrame) -> DataFrame:
    """Left words with the spread bits of their keys, as `slices_of` makes them."""

    def spread(batches):
        for batch in batches:
            codes = batch.column("code").to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                bits = mixed((codes << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], names=["code", "held", "found", "spread"])

    return lefts.mapInArrow(spread, "code bigint, held bigint, found bigint, spread bigint")


def scored(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, slice_entries: int = SLICE_ENTRIES) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = counted(rows.filter(~F.col("held_out")), slice_entries)
    out = (_with_broadcast if counts.bytes <= broadcast_bytes else _by_slices)(rows, counts)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
