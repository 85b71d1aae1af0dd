"""Transcript parsing: a hidden Markov model over lines recovers who speaks, then turns are rendered.

Input are pieces of raw transcripts: conv_id, turn (their order) and text. Each line is observed as
its speaker marker (none, system, user, assistant, some other name), its length, whether it
asks, and whether it follows a blank line or opens a piece. Hidden is who speaks and whether the line opens a turn
or goes on with it. The model's counts come from pieces whose roles are known.

Viterbi runs in blocks, because one conversation may hold any share of the rows. A block's lines
make one matrix, the best log probability from each state before it to each state at its end;
matrices of a conversation are multiplied (max, +) in a tree, which fixes the states at the
borders of all blocks, and then each block finds its own lines' states between its borders. The
path is as probable as the one over all lines at once.

Every piece is rendered by itself: the pieces of a conversation, in order, are its canonical text. Marker
text is cut off, lines that go on stay as they are, every turn is closed once.

Null text is one blank line. Null conv_ids are one conversation, null turns come first, pieces with
equal turns are ordered by a hash of the text; rows that repeat conv_id, turn and text are one
piece. An empty table gives an empty result. Further columns are not carried.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citegrain.plans.workdir import written

ROLES = ("system", "user", "assistant")
#: Names that transcripts give their speakers, by role.
SPEAKERS = {
    "system": "system|instructions?|context",
    "user": "user|human|customer|client|question|q",
    "assistant": "assistant|ai|bot|model|agent|gpt|answer|a",
}
STATES = 2 * len(ROLES)  # role * 2 + (0: opens a turn, 1: goes on)
CODES = 5 * 2 * 4 * 2
#: Consecutive turn numbers in a block; blocks and levels of the tree hold about this many members.
BLOCK = 64
#: Pieces in a block beyond which it is split by turn and text hash.
CROWD = 4 * BLOCK
_OPEN = r"\s*(?:<\|im_start\|>|<\||#{1,6}|\*\*|\[)?\s*"
_CLOSE = r"\s*(?:\|>|\*\*|\])?\s*"
_MARKERS = [
    (i + 1, re.compile(rf"{_OPEN}(?:{names}){_CLOSE}(?::|(?<=\|>)|(?<=\]))\s*(?:\*\*)?\s*|\s*(?:<\|im_start\|>|#{{2,6}}\s)\s*(?:{names})\s*$", re.IGNORECASE))
    for i, names in enumerate(SPEAKERS.values())
]
_OTHER = re.compile(r"\s*[A-Z][\w .-]{0,30}:\s+")


def marker_of(line: str) -> tuple[int, str]:
    """The kind of speaker marker (0: none) and the line without it."""
    for kind, pattern in _MARKERS:
        found = pattern.match(line)
        if found:
            return kind, line[found.end():]
    found = _OTHER.match(line)
    return (4, line) if found else (0, line)


def codes_of(text: str | None) -> list[int]:
    codes, blank = [], 1
    for line in (text or "").split("\n"):
        kind, rest = marker_of(line)
        rest = rest.strip()
        length = 0 if not rest else 1 if len(rest) < 80 else 2 if len(rest) < 240 else 3
        codes.append(((kind * 2 + blank) * 4 + length) * 2 + rest.endswith(("?", "？")))
        blank = int(not line.strip())
    return codes


class Model:
    """Log probabilities: start (states), move (states x states), show (states x codes)."""

    def __init__(self, start, move, show):
        self.start, self.move, self.show = (np.asarray(x, dtype=float) for x in (start, move, show))

    def matrix(self, codes) -> np.ndarray:
        """Best log probability from the state before the lines to the one at their end."""
        out = None
        for code in codes:
            step = self.move + self.show[:, code]
            out = step if out is None else (out[:, :, None] + step[None]).max(axis=1)
        return out

    def path(self, codes, enter: int, leave: int) -> list[int]:
        """The best states of the lines between two known ones (enter -1: the conversation begins)."""
        best = self.start if enter < 0 else self.move[enter]
        best, back = best + self.show[:, codes[0]], []
        for code in codes[1:]:
            through = best[:, None] + self.move
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + self.show[:, code]
        states = [leave]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        return states[::-1]


def borders(first: np.ndarray, matrices: list[np.ndarray], leave: int | None) -> list[int]:
    """The state at the end of each of consecutive spans. *first*: log probability of each state at the end
    of the first span; *leave*: the last state, if it is known."""
    best, back = first, []
    for m in matrices:
        through = best[:, None] + m
        back.append(through.argmax(axis=0))
        best = through.max(axis=0)
    states = [int(best.argmax()) if leave is None else leave]
    for step in reversed(back):
        states.append(int(step[states[-1]]))
    return states[::-1]


def fit(pieces: DataFrame) -> Model:
    """From pieces of known role (conv_id, turn, role, text); other roles are left out."""
    known = pieces.filter(F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", "text")

    def lines(frames):
        for frame in frames:
            counts: dict = {}
            for role, text in zip(frame["role"], frame["text"]):
                for i, code in enumerate(codes_of(text)):
                    key = (ROLES.index(role) * 2 + (i > 0), code)
                    counts[key] = counts.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["state", "code", "n"])

    show = np.ones((STATES, CODES)) * 0.1
    seen = known.select("role", "text").mapInPandas(lines, "state int, code int, n bigint")
    for row in seen.groupBy("state", "code").agg(F.sum("n").alias("n")).collect():  # at most STATES * CODES
        show[row["state"], row["code"]] += row["n"]
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    after = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    moves = known.select("conv_id", "turn", "role", n_lines.alias("lines")).join(after, ["conv_id", "turn"], "left")
    shape = moves.groupBy("role", "next", (F.col("lines") > 1).alias("more")).agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).collect()
    move, start = np.ones((STATES, STATES)) * 0.01, np.ones(STATES) * 0.01
    for row in shape:
        r = ROLES.index(row["role"]) * 2
        if row["more"]:
            move[r, r + 1] += row["n"]
            move[r + 1, r + 1] += row["lines"] - 2 * row["n"]
        if row["next"]:
            move[r + row["more"], ROLES.index(row["next"]) * 2] += row["n"]
    for row in known.filter("turn = 0").groupBy("role").count().collect():
        start[ROLES.index(row["role"]) * 2] += row["count"]
    scale = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(scale(start), scale(move), scale(show))


KEY = ("conv", "a", "b", "c")


def _blocks(pieces: DataFrame) -> DataFrame:
    """Pieces under the key of their block; blocks sort as their pieces do, by turn and then by h."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    at = F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 62)))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = pieces.select("conv_id", "turn", "text", conv.alias("conv"), at.alias("at"), h.alias("h"), F.floor(at / BLOCK).alias("a"))
    rows = written(rows.dropDuplicates(["conv", "at", "h"]))
    crowded = rows.groupBy("conv", "a").count().filter(F.col("count") > CROWD).select("conv", "a", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, ["conv", "a"], "left")
    zero = F.lit(0).cast("bigint")
    # where many share a turn, the top bits of the hash part them
    return rows.select(
        "conv_id", "turn", "text", "conv", "at", "h", "a",
        F.when(F.col("crowded"), F.col("at")).otherwise(zero).alias("b"),
        F.when(F.col("crowded"), F.shiftright("h", 52)).otherwise(zero).alias("c"),
    )


def _groups(batches, keys):
    """Runs of rows with equal keys, of sorted batches."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current and rows:
                yield rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield rows


def _gathered(df: DataFrame, keys, *order) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _batches(rows, schema: pa.Schema, size: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _placed(spans: DataFrame) -> DataFrame:
    """Spans with their place in their conversation, from 0; no task sees all of a long one."""
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    wide = spans.groupBy("conv", "a").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("a") / 4096))
    runs = wide.groupBy("conv", "run").agg(F.sum("n").alias("n"))
    runs = runs.select("conv", "run", F.coalesce(F.sum("n").over(before("conv", "run")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(before("conv", "run", "a")), F.lit(0))
    bases = wide.withColumn("inside", inside).join(runs, ["conv", "run"]).select("conv", "a", (F.col("base") + F.col("inside")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("conv", "a").orderBy("b", "c")) - 1
    return spans.withColumn("nth", nth).join(bases, ["conv", "a"]).withColumn("place", (F.col("base") + F.col("nth")).cast("bigint")).drop("nth", "base")


_SPAN = "matrix array<double>, begin array<double>"
_FLOATS = pa.list_(pa.float64())


def _spans(rows: DataFrame, model: tuple) -> DataFrame:
    schema = pa.schema([("conv", pa.string()), *[(k, pa.int64()) for k in KEY[1:]], ("matrix", _FLOATS), ("begin", _FLOATS)])

    def matrices(batches):
        m = Model(*model)

        def each():
            for group in _groups(batches, KEY):
                codes = [c for row in group for c in codes_of(row["text"])]
                begin = m.start + m.show[:, codes[0]]
                if len(codes) > 1:
                    begin = (begin[:, None] + m.matrix(codes[1:])).max(axis=0)
                yield {k: group[0][k] for k in KEY} | {"matrix": m.matrix(codes).ravel(), "begin": begin}

        yield from _batches(each(), schema)

    wanted = rows.select(*KEY, "at", "h", "text")
    return _gathered(wanted, KEY, "at", "h").mapInArrow(matrices, f"conv string, a bigint, b bigint, c bigint, {_SPAN}")


def _square(row: dict) -> np.ndarray:
    return np.array(row["matrix"]).reshape(STATES, STATES)


def _folded(batches):
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("matrix", _FLOATS), ("begin", _FLOATS)])

    def each():
        for group in _groups(batches, ("conv", "parent")):
            whole, begin = _square(group[0]), np.array(group[0]["begin"])
            for row in group[1:]:
                step = _square(row)
                whole, begin = (whole[:, :, None] + step[None]).max(axis=1), (begin[:, None] + step).max(axis=0)
            yield {"conv": group[0]["conv"], "place": group[0]["parent"], "matrix": whole.ravel(), "begin": begin}

    yield from _batches(each(), schema)


def _split(batches):
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())])

    def each():
        for group in _groups(batches, ("conv", "parent")):
            head = group[0]
            first = np.array(head["begin"]) if head["enter"] < 0 else _square(head)[head["enter"]]
            ends = borders(first, [_square(row) for row in group[1:]], None if head["leave"] < 0 else head["leave"])
            for i, (row, end) in enumerate(zip(group, ends)):
                enter = head["enter"] if i == 0 else ends[i - 1]
                yield {"conv": row["conv"], "place": row["place"], "enter": enter, "leave": end, "last": head["last"] and i + 1 == len(group)}

    yield from _batches(each(), schema)


def bordered(spans: DataFrame, fan: int = 16 * BLOCK) -> DataFrame:
    """The states at the borders of all spans (conv, place, matrix, begin): conv, place, enter (-1: none), leave, last."""
    top = (spans.agg(F.max("place")).first()[0] or 0) < fan
    child = spans.withColumn("parent", F.floor(F.col("place") / fan))
    if top:
        free = [F.lit(-1).alias("enter"), F.lit(-1).alias("leave"), F.lit(True).alias("last")]
        known = child.select("*", *free)
    else:
        parents = written(_gathered(child, ("conv", "parent"), "place").mapInArrow(_folded, f"conv string, place bigint, {_SPAN}"))
        above = bordered(parents, fan).withColumnRenamed("place", "parent")
        known = child.join(above, ["conv", "parent"])
    return _gathered(known, ("conv", "parent"), "place").mapInArrow(_split, "conv string, place bigint, enter int, leave int, last boolean")


def _rendered(lines: list[str], states: list[int], opens_all: bool, closes_all: bool) -> str:
    out, fresh = [], False
    for line, state in zip(lines, states):
        if state % 2 == 0 or (opens_all and not out):
            shown = marker_of(line)[1]
            out.append(("" if opens_all and not out else "<|im_end|>\n") + f"<|im_start|>{ROLES[state // 2]}\n{shown}")
            fresh = not shown
        else:
            out.append(line if fresh else f"\n{line}")
            fresh = False
    return "".join(out) + ("<|im_end|>\n" if closes_all else "")


def parsed(pieces: DataFrame, model: Model, fan: int = 16 * BLOCK) -> DataFrame:
    """One row per distinct piece: conv_id, turn, role (of its first line), opens (whether that line opens
    a turn), n_lines, n_turns (opened in it), rendered."""
    plain = (model.start, model.move, model.show)
    rows = written(_blocks(pieces))
    spans = written(_placed(_spans(rows, plain)))
    ends = bordered(spans.select("conv", "place", "matrix", "begin"), fan)
    ends = spans.select(*KEY, "place").join(ends, ["conv", "place"]).drop("place")
    kinds = [to_arrow_type(pieces.schema[c].dataType) for c in ("conv_id", "turn")]
    schema = pa.schema([
        ("conv_id", kinds[0]), ("turn", kinds[1]), ("role", pa.string()), ("opens", pa.bool_()),
        ("n_lines", pa.int64()), ("n_turns", pa.int64()), ("rendered", pa.string()),
    ])

    def paths(batches):
        m = Model(*plain)

        def each():
            for group in _groups(batches, KEY):
                codes = [codes_of(row["text"]) for row in group]
                states = m.path([c for piece in codes for c in piece], group[0]["enter"], group[0]["leave"])
                for i, (row, piece) in enumerate(zip(group, codes)):
                    own, states = states[: len(piece)], states[len(piece) :]
                    begins, ends_all = i == 0 and row["enter"] < 0, row["last"] and i + 1 == len(group)
                    yield {
                        "conv_id": row["conv_id"], "turn": row["turn"], "role": ROLES[own[0] // 2], "opens": begins or own[0] % 2 == 0,
                        "n_lines": len(piece), "n_turns": sum(x % 2 == 0 for x in own) + (begins and own[0] % 2),
                        "rendered": _rendered((row["text"] or "").split("\n"), own, begins, ends_all),
                    }

        yield from _batches(each(), schema)

    out = pieces.select("conv_id", "turn").schema
    for name, kind in (("role", "string"), ("opens", "boolean"), ("n_lines", "long"), ("n_turns", "long"), ("rendered", "string")):
        out = out.add(name, kind)
    return _gathered(rows.join(ends, list(KEY)), KEY, "at", "h").mapInArrow(paths, out)
