"""Token counts of byte-level BPE, without token ids.

A text is cut at the strings of added tokens, which are one token each, and the rest by the
pattern of the vocabulary into pieces. The symbols of a piece are its UTF-8 bytes, in a linked
list; a heap holds the adjacent pairs that can merge, by rank and then by place. The lowest is
popped and merged again and again, which takes n log n steps for a piece of n bytes. A piece has as
many tokens as it had symbols less its merges, so no id is ever looked up or put out.

The merges come from a tokenizer file, read once on the driver (its size is checked) and broadcast.
Pieces repeat, so each Python worker remembers the counts of up to `REMEMBERED` short ones.

Null and empty texts have no tokens. Texts of any length are counted whole; beyond `LONG` code points
pieces are taken one at a time and not as a list. Repeated rows and rows with null or equal ids are
counted each on its own; other columns are kept as they are, and a new column whose name is taken gets a
leading underscore. An empty table has no counts.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from citegrain.llm.common import free_name

# Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters and numbers that the classes of the vocabulary's library, of Unicode 16, do not know.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff3\U00016ff4-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    "\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    "\U0003d000-\U0003fc3f"
)
#: The largest tokenizer file that is broadcast.
MOST_BYTES = 64 << 20
LONG = 1 << 20
REMEMBERED = 1 << 19
#: Longer pieces are not remembered.
SHORT = 64


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and that byte."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The merges of a byte-level BPE. A symbol is a number: its byte, or 256 and up for what merges make.

    `rank` has the rank of a pair under (left << WIDTH | right), `made` the symbol that each rank makes. Symbols
    that spell the same are the same, however they were made.
    """

    WIDTH = 24

    def __init__(self, pairs: list[tuple[bytes, bytes]], added: list[str]):
        symbols = {bytes([b]): b for b in range(256)}
        number = lambda spelled: symbols.setdefault(spelled, len(symbols))
        self.rank = {number(a) << self.WIDTH | number(b): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [number(a + b) for a, b in pairs]
        self.added = added
        #: Counts of pieces seen so far; stays with a Python worker from task to task.
        self.known: dict[str, int] = {}

    def __reduce__(self):
        return Merges._restored, (self.rank, self.made, self.added)

    @classmethod
    def _restored(cls, rank: dict[int, int], made: list[int], added: list[str]) -> Merges:
        out = cls([], added)
        out.rank, out.made = rank, made
        return out

    def count(self, piece: bytes) -> int:
        """How many symbols are left when no adjacent pair of the piece can merge."""
        symbol, n = list(piece), len(piece)
        rank, width = self.rank.get, self.WIDTH
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(symbol[i] << width | symbol[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = heapq.heappop(heap)
            wanted, left = entry >> 32, entry & 0xFFFFFFFF
            right = after[left]
            # an entry is out of date once one of its symbols has merged with another
            if symbol[left] < 0 or right == n or rank(symbol[left] << width | symbol[right]) != wanted:
                continue
            symbol[left] = own = self.made[wanted]
            symbol[right] = -1
            merges += 1
            after[left] = last = after[right]
            if last < n:
                before[last] = left
                if (r := rank(own << width | symbol[last])) is not None:
                    heapq.heappush(heap, r << 32 | left)
            if (first := before[left]) >= 0 and (r := rank(symbol[first] << width | own)) is not None:
                heapq.heappush(heap, r << 32 | first)
        return n - merges


def load(path: str) -> Merges:
    """The merges and the added tokens of a byte-level tokenizer file."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    spec = json.loads(data)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if (model["type"], before.get("type")) != ("BPE", "ByteLevel") or before.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    byte = _byte_symbols()
    as_bytes = lambda symbols: bytes(map(byte.__getitem__, symbols))
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return Merges([(as_bytes(a), as_bytes(b)) for a, b in pairs], [t["content"] for t in spec.get("added_tokens", [])])


def counter(merges: Merges) -> Callable[[str], int]:
    """A function that counts the tokens of a text."""
    usual, later = regex.compile(PIECES), re.compile(f"[{LATER}]")
    beyond = re.compile(f"[{LATER[0]}-\U0010ffff]")  # finds at once that most texts have none
    # where a text has such characters, they are neither letters nor numbers
    other = regex.compile(PIECES.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{LATER}]|[^\s\p{{L}}\p{{N}}])").replace(r"?\p{L}+", rf"?(?:(?![{LATER}])\p{{L}})+").replace(r"?\p{N}+", rf"?(?:(?![{LATER}])\p{{N}})+"))
    cuts = regex.compile("|".join(regex.escape(t) for t in sorted(merges.added, key=len, reverse=True))) if merges.added else None
    known = merges.known

    def of_part(part: str) -> int:
        total = 0
        pieces = other if not part.isascii() and beyond.search(part) and later.search(part) else usual
        for piece in pieces.findall(part) if len(part) < LONG else (m.group() for m in pieces.finditer(part)):
            if (found := known.get(piece)) is None:
                found = merges.count(piece.encode())
                if len(piece) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            total += found
        return total

    def count(text: str) -> int:
        total, at = 0, 0
        for cut in cuts.finditer(text) if cuts else ():
            total += 1 + of_part(text[at : cut.start()])
            at = cut.end()
        return total + of_part(text[at:] if at else text)

    return count


def with_token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """*docs* with n_tokens, the tokens of each text by the tokenizer file at *path* (on the driver)."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))
    name = free_name(docs, "n_tokens")
    kept = docs.columns

    def counted(batches):
        count = counter(shared.value)
        for batch in batches:
            numbers = [count(t.as_py() or "") for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers, pa.int64())], names=[*kept, name])

    whole = docs.withColumn(free_name(docs, "counted_text"), F.col(text))
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return whole.mapInArrow(counted, schema)
