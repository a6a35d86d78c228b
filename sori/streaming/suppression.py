"""Re-notification as a stream: alerts are published, sent as updates or silenced by what was published for their key before."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sori import constants as C

KEY = ("product", "main_aspect", "channel")
OUTPUT = "alert_id string, product string, main_aspect string, channel string, window_end date, rate double, decision string, updates_alert_id string"
PRIOR = "alert_id string, window_end date, rate double"


def decide(prior: list[tuple[str, date, float]], end: date, rate: float, alert_id: str) -> tuple[str, str | None]:
    """Decision on an alert, and which earlier alert it updates, by the newest of the unresolved ``prior`` (id, end, rate)."""
    if not prior:
        return "publish", None
    last = max(prior, key=lambda p: p[1])
    if (end - last[1]).days >= C.RENOTIFY_DAYS:
        return "publish", None
    if rate - last[2] >= C.RENOTIFY_JUMP - 1e-9:
        return "update", None if alert_id == last[0] else last[0]
    return "suppress", None


class Suppression(StatefulProcessor):
    """State of a key: its unresolved published alerts of the last days; a timer forgets each once it can silence nothing more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prior = handle.getListState("prior", PRIOR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))  # a key's alerts of one batch: one for each day and run
        new["window_end"] = pd.to_datetime(new["window_end"]).dt.date
        new["rate"] = new["rate"].astype("float64")
        new = new.sort_values(["window_end", "resolved", "alert_id"])
        prior, out = [(r[0], r[1], r[2]) for r in self.prior.get()], []
        for r in new.itertuples():
            if r.resolved:
                prior = [p for p in prior if p[0] != r.alert_id]
                continue
            decision, updated = decide(prior, r.window_end, r.rate, r.alert_id)
            if decision != "suppress":
                prior.append((r.alert_id, r.window_end, r.rate))
                self.handle.registerTimer(_millis(r.window_end + timedelta(C.RENOTIFY_DAYS)))
            out.append((r.alert_id, *key, r.window_end, r.rate, decision, updated))
        self._put(prior)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._put([(r[0], r[1], r[2]) for r in self.prior.get() if _millis(r[1] + timedelta(C.RENOTIFY_DAYS)) > now])
        yield pd.DataFrame()

    def _put(self, prior: list[tuple[str, date, float]]) -> None:
        if prior:
            self.prior.put(prior)
        else:
            self.prior.clear()

    def close(self) -> None:
        pass


def _millis(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)


def suppressed(alerts: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Decisions on a stream of alerts: what :func:`sori.operators.detection.suppress` decides day after day.

    ``alerts`` has alert_id, product, main_aspect, channel, window_end (date), rate and resolved. A row with ``resolved``
    says that the alert of this id has been dealt with: it silences nothing from then on. Days count by window_end, not
    by the clock. A batch may hold several days; a key's are taken in order. A key's state is a handful of alerts, as
    published ones are days apart, and it goes by timer once the newest alert is ``lateness`` ahead of what it could
    still silence; alerts that come later than that are left to the engine's rule for late rows. The session's state
    store must be RocksDB.
    """
    rows = alerts.select("alert_id", *KEY, "window_end", "rate", "resolved").withColumn("at", F.col("window_end").cast("timestamp"))
    return rows.withWatermark("at", lateness).groupBy(*KEY).transformWithStateInPandas(Suppression(), OUTPUT, "append", "eventTime")
