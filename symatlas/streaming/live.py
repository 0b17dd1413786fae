"""The state of live documents as one stream operator: debounce, cancellation at close, content hashes, generations, expiry.

Each document has one state, kept by transformWithStateInPandas. A change waits for DEBOUNCE_MS of event time;
a later change takes its place and starts the wait anew, a close or a delete cancels it. What is left is put
out unless its text is that of the last one put out. Changes of a generation older than the newest
seen are dropped, as are rows behind the watermark. A document that nothing happens to for KEPT_MS is forgotten,
so that the state is that of the documents of that time, not of all that were ever open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from symatlas.session import shipped

DEBOUNCE_MS = 300
KEPT_MS = 24 * 3600 * 1000
OUT = "uri string, ts timestamp, op string, text string, generation long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["uri", "ts", "op", "text", "generation"]


class Documents(StatefulProcessor):
    """Input rows (uri, ts, op, text, generation) with op change, open, save, close or delete; output rows with op index, close or tombstone."""

    def __init__(self, wait: int = DEBOUNCE_MS, kept: int = KEPT_MS):
        self.wait, self.kept = wait, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "text string, at long, due long")
        self.known = handle.getValueState("known", "hash string, generation long, forget long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out: list[tuple] = []
        frame = pd.concat(list(rows))  # what one document went through in one batch
        last, newest, forget = self.known.get() if self.known.exists() else (None, None, None)
        wait = self.pending.get() if self.pending.exists() else None
        for ts, op, text, generation in sorted(zip(frame["ts"], frame["op"], frame["text"], frame["generation"]), key=lambda r: r[0]):
            at = self._ms(ts)
            # a wait that ended before this row, in the same batch
            if wait is not None and at >= wait[2] and op not in ("close", "delete"):
                last = self._put(key[0], wait, last, newest, out)
                wait = None
            if forget is not None and at >= forget and wait is None:  # forgotten before this row, though the watermark isn't there yet
                last = newest = None
            generation = None if pd.isna(generation) else int(generation)
            if generation is not None and newest is not None and generation < newest:
                continue
            newest = generation if generation is not None else newest
            if op in ("close", "delete"):
                if wait is not None and at >= wait[2]:
                    last = self._put(key[0], wait, last, newest, out)
                wait = None
                if op == "delete":
                    last = None
                out.append((key[0], ts, "close" if op == "close" else "tombstone", None, newest))
            else:
                # opened and saved documents don't wait
                wait = (text or "", at, at if op in ("open", "save") else at + self.wait)
                if op in ("open", "save"):
                    last = self._put(key[0], wait, last, newest, out)
                    wait = None
        self._hold(wait)
        self._remember(last, newest, forget, max(self._ms(t) for t in frame["ts"]))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.pending.exists():
            wait = self.pending.get()
            if wait[2] <= now:
                last, newest, forget = self.known.get() if self.known.exists() else (None, None, None)
                last = self._put(key[0], wait, last, newest, out)
                self.pending.clear()
                self._remember(last, newest, forget, wait[1])
        if self.known.exists() and self.known.get()[2] <= now and not self.pending.exists():
            self.known.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _ms(ts) -> int:
        return int(pd.Timestamp(ts).timestamp() * 1000)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_COLUMNS)
        return frame.astype({"ts": "datetime64[us]", "generation": "Int64"})

    @staticmethod
    def _put(uri: str, wait: tuple, last: str | None, newest: int | None, out: list[tuple]) -> str:
        text, at = wait[0], wait[1]
        name = hashlib.md5(text.encode()).hexdigest()
        if name != last:
            out.append((uri, pd.Timestamp(at, unit="ms"), "index", text, newest))
        return name

    def _hold(self, wait: tuple | None) -> None:
        if self.pending.exists():
            old = self.pending.get()
            if wait is not None and tuple(old) == wait:
                return
            self.handle.deleteTimer(old[2])
            self.pending.clear()
        if wait is not None:
            self.pending.update(wait)
            self.handle.registerTimer(wait[2])

    def _remember(self, last: str | None, newest: int | None, forget: int | None, at: int) -> None:
        until = max(forget or 0, at + self.kept)
        if forget is not None and until != forget:
            self.handle.deleteTimer(forget)
        self.known.update((last, newest, until))
        self.handle.registerTimer(until)


def live_documents(changes: DataFrame, lateness: str = "1 second", wait: int = DEBOUNCE_MS, kept: int = KEPT_MS) -> DataFrame:
    """(uri, ts, op, text, generation): what is to be indexed, closed and deleted, from a stream of changes (uri, ts, op, text, generation).

    The state lies in the state store of RocksDB, which this sets for the session.
    """
    spark = shipped(changes.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    keyed = changes.select("uri", "ts", "op", "text", "generation").withWatermark("ts", lateness).groupBy("uri")
    return keyed.transformWithStateInPandas(statefulProcessor=Documents(wait, kept), outputStructType=OUT, outputMode="append", timeMode="EventTime")
