"""Notices of named sales as a stream: state of a sale and a timer for its reminder."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from salesignal.operators.watch import Watched

OUTPUT = "sale bigint, at timestamp, notice string, verdict_key string"


def _millis(at: datetime) -> int:
    return int(at.replace(tzinfo=UTC).timestamp() * 1000)


class Notices(StatefulProcessor):
    """Gives the rows of operators.watch.notices, for sales whose polls come in order. Times are UTC. A sale has one timer at most: that of the next reminder; its state goes when the reminder is out or can't come any more and a sale's last day is over by a month."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("watched", "verdict string, notable boolean, ends date, at timestamp, reminded boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = self._state()
        polls = pd.concat(list(rows)).sort_values("at")
        out = []
        for at, verdict, notable, ends in zip(polls["at"], polls["verdict_key"], polls["notable"], polls["ends"], strict=True):
            out += own.polled(pd.Timestamp(at).to_pydatetime().replace(tzinfo=None), verdict, bool(notable), None if pd.isna(ends) else pd.Timestamp(ends).date())
        self._keep(own)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = self._state()
        out = own.waited(datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).replace(tzinfo=None), included=True)
        self._keep(own)
        yield self._rows(key, out)

    def close(self) -> None:
        pass

    def _state(self) -> Watched:
        if not self.kept.exists():
            return Watched()
        verdict, notable, ends, at, reminded = self.kept.get()
        return Watched(verdict, notable, None if ends is None else pd.Timestamp(ends).date(), pd.Timestamp(at).to_pydatetime().replace(tzinfo=None), reminded)

    def _keep(self, own: Watched) -> None:
        self.kept.update(own.packed())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        due = own.due()
        if due is not None:
            self.handle.registerTimer(_millis(due))

    @staticmethod
    def _rows(key: tuple, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], pd.Timestamp(at), notice, verdict) for at, notice, verdict in out], columns=["sale", "at", "notice", "verdict_key"])


def estate_notices(polls: DataFrame, late: str = "1 hour") -> DataFrame:
    """(sale, at, notice, verdict_key) as they fall due. polls: sale, at, verdict_key, notable, ends. The state store is to be RocksDB (build_session sets it); a notice counts as sent with the batch that wrote it."""
    return polls.withWatermark("at", late).groupBy("sale").transformWithStateInPandas(Notices(), OUTPUT, "Append", "EventTime")
