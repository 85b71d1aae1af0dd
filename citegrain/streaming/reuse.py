"""Answer reuse on a stream: the state of a key is when its stored answer expires, or the requests that may still be corrected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citegrain.operators.reuse import TTL_SEC

# Rows that a task puts out at once.
OUT_ROWS = 10_000


class _Reuse(StatefulProcessor):
    def __init__(self, ttl: int, order: str, keep_ms: int | None) -> None:
        self.ttl = ttl
        self.order = order
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # only times and places are kept of the batches of rows
        parts = [(pdf["at"].to_numpy(), pdf[self.order].to_numpy()) for pdf in rows]
        times, place = (np.concatenate(x) for x in zip(*parts))
        in_order = np.lexsort((place, times))
        times, place = times[in_order], place[in_order]
        known = self.until.get()
        old = None if known is None else known[0]
        until = -(1 << 62) if old is None else old
        # rows from before the stored answer came late: it was not there yet, and they store none
        reused = np.ones(len(times), dtype=bool) if old is None else times >= until - self.ttl
        i = int(np.searchsorted(times, until, side="right"))
        while i < len(times):
            reused[i] = False
            until = int(times[i]) + self.ttl
            i = int(np.searchsorted(times, until, side="right"))
        if until != old:
            self.until.update((until,))
        for a in range(0, len(times), OUT_ROWS):
            yield pd.DataFrame({"key": key[0], self.order: place[a : a + OUT_ROWS], "reused": reused[a : a + OUT_ROWS]})

    def close(self) -> None:
        pass


def mark_stream_reuse(
    requests: DataFrame,
    key: str = "key",
    ts: str = "ts",
    order: str = "event_id",
    ttl_sec: int = TTL_SEC,
    keep_hours: float | None = None,
) -> DataFrame:
    """Rows ``key, order, reused`` of a request stream, by the rule of the batch operator.

    Every row comes out, however late: there is no watermark. Rows are put in time order within a
    micro-batch; a row arriving in a later batch than a newer one is judged by the state left by that
    batch, and if it is older than the answer stored there it is no reuse and stores nothing. A key's
    state is one number; with *keep_hours* it is dropped when no answer was stored for so long by the
    clock. Such a query never finds itself idle, so it does not end by an available-now trigger. A task holds one key's
    rows of one micro-batch (time and *order* only); the source's limit per trigger bounds them. Rows without a
    time reuse nothing and store nothing. Needs the RocksDB state store.
    """
    slim, out, untimed = _slim(requests, key, ts, order)
    judged = slim.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Reuse(
            max(1, ttl_sec) * 1_000_000, order, None if keep_hours is None else int(keep_hours * 3_600_000)
        ),
        outputStructType=out,
        outputMode="Append",
        timeMode="None" if keep_hours is None else "ProcessingTime",
    )
    return judged.unionByName(untimed)


def _slim(requests: DataFrame, key: str, ts: str, order: str) -> tuple[DataFrame, T.StructType, DataFrame]:
    """Rows of key, order and at; the fields of the answer; and the answer for rows without a time."""
    kinds = requests.schema
    out = T.StructType(
        [
            T.StructField("key", kinds[key].dataType),
            T.StructField(order, kinds[order].dataType),
            T.StructField("reused", T.BooleanType()),
        ]
    )
    rows = requests.select(F.col(key).alias("key"), order, F.unix_micros(F.col(ts)).alias("at"))
    untimed = rows.filter("at is null").select("key", order, F.lit(False).alias("reused"))
    return rows.filter("at is not null"), out, untimed


class _Corrected(StatefulProcessor):
    """State of a key: its judged requests of the allowed delay by stretch of one ttl, and the chain before them."""

    def __init__(self, ttl: int, delay: int, order: str) -> None:
        self.ttl = ttl
        self.delay = delay
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", "until long, closed long")
        self.held = handle.getMapState("held", "stretch long", "at array<long>, place array<long>, reused array<boolean>, revision array<int>")

    def _fold(self, at: np.ndarray, until: int) -> tuple[np.ndarray, int]:
        reused = np.ones(len(at), dtype=bool)
        i = int(np.searchsorted(at, until, side="right"))
        while i < len(at):
            reused[i] = False
            until = int(at[i]) + self.ttl
            i = int(np.searchsorted(at, until, side="right"))
        return reused, until

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.chain.get()
        until, closed = known if known is not None else (-(1 << 62), -(1 << 62))
        newest = None
        for pdf in rows:
            at, place = pdf["at"].to_numpy(), pdf[self.order].to_numpy()
            stretch = at // self.ttl
            late = stretch <= closed  # from before what can still be corrected: judged by what was stored there
            if late.any():
                yield self._rows(key, place[late], at[late] > until - self.ttl, np.zeros(late.sum(), np.int32))
            for one in np.unique(stretch[~late]):
                mine = stretch == one
                self._add(int(one), at[mine], place[mine])
        for one in sorted(k[0] for k in self.held.keys()):
            at, place, reused, revision = (np.array(x) for x in self.held.getValue((one,)))
            now, after = self._fold(at, until)
            changed = (now != reused) | (revision < 0)
            if changed.any():
                revision = revision + changed
                self.held.updateValue((one,), (at.tolist(), place.tolist(), now.tolist(), revision.tolist()))
                yield self._rows(key, place[changed], now[changed], revision[changed])
            until, newest = after, int(at[-1])
        if newest is not None:
            self._close(newest)

    def _add(self, stretch: int, at: np.ndarray, place: np.ndarray) -> None:
        """Rows join those held of their stretch, in order; their revision is -1 until they are judged."""
        columns = [at, place, np.zeros(len(at), bool), np.full(len(at), -1, np.int32)]
        if self.held.containsKey((stretch,)):
            columns = [np.concatenate([np.array(old, dtype=new.dtype), new]) for old, new in zip(self.held.getValue((stretch,)), columns)]
        in_order = np.lexsort((columns[1], columns[0]))
        self.held.updateValue((stretch,), tuple(c[in_order].tolist() for c in columns))

    def _close(self, newest: int) -> None:
        """Stretches that end before the allowed delay leave the state; what they stored stays known."""
        known = self.chain.get()
        until, closed = known if known is not None else (-(1 << 62), -(1 << 62))
        over = [k for k in sorted(k[0] for k in self.held.keys()) if (k + 1) * self.ttl < newest - self.delay]
        for one in over:
            _, until = self._fold(np.array(self.held.getValue((one,))[0]), until)
            self.held.removeKey((one,))
            closed = one
        if over:
            self.chain.update((until, closed))

    def _rows(self, key, place: np.ndarray, reused: np.ndarray, revision: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], self.order: place, "reused": reused, "revision": revision.astype(np.int32)})

    def close(self) -> None:
        pass


def correct_stream_reuse(
    requests: DataFrame,
    key: str = "key",
    ts: str = "ts",
    order: str = "event_id",
    ttl_sec: int = TTL_SEC,
    delay_sec: int = 3600,
) -> DataFrame:
    """As `mark_stream_reuse`, but late rows judge what came before them anew: rows ``key, order, reused, revision``.

    A row that comes up to *delay_sec* behind the newest of its key takes its place in time; requests that it turns from a
    reuse to a stored answer, or back, come out once more with a higher revision. The last revision of every row is what
    the batch operator says, unless a row was later than that: it is judged by the chain that was closed there, and
    corrects none. *order* is a whole number. The state holds a key's requests of the delay, in stretches of
    one ttl; a stretch is folded at a time.
    """
    slim, out, untimed = _slim(requests, key, ts, order)
    out = T.StructType([*out.fields, T.StructField("revision", T.IntegerType())])
    judged = slim.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Corrected(max(1, ttl_sec) * 1_000_000, delay_sec * 1_000_000, order),
        outputStructType=out,
        outputMode="Append",
        timeMode="None",
    )
    return judged.unionByName(untimed.withColumn("revision", F.lit(0)))
