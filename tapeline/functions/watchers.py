"""State per symbol of live feeds: one row a second comes in, timers and a handful of values stay.

Pickled by value, so executors need no copy of this package.  Streams that use them need the RocksDB state store.
"""

from __future__ import annotations

import sys
from array import array
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

TRIGGERS = "symbol string, ts timestamp, price double, reasons string"
SILENCE = "symbol string, ts timestamp, status string"
LEVELS = ((2, "WARNING"), (4, "STALE"), (8, "DISCONNECTED"))


def in_order(stamps):
    """Places of ``stamps`` from the smallest on, equal ones as they came, a thousand numbers at a time as Python objects."""
    import numpy as np
    places = np.argsort(np.frombuffer(stamps, dtype="d"), kind="stable") if len(stamps) else np.empty(0, dtype="q")
    for start in range(0, len(places), 1024):
        yield from places[start:start + 1024].tolist()


def newest_before(columns: dict[str, tuple[str, str]]):
    """For ``mapInArrow``: of rows that come group by group in order, those of kind 1 with stamp, bid and ask of the last of kind 0 before.

    ``_place`` starts at 0 in each group.  Only one row is carried from batch to batch.
    """
    def fill(batches):
        import numpy as np
        import pyarrow as pa
        carried = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            rows = rows if carried is None else pa.concat_tables([carried, rows])
            at = np.arange(rows.num_rows)
            book = rows["_kind"].to_numpy() == 0
            start = np.maximum.accumulate(np.where(rows["_place"].to_numpy() == 0, at, 0))
            last = np.maximum.accumulate(np.where(book, at, -1))
            found = last >= start
            asked = np.flatnonzero(~book)
            mine, before = rows.take(pa.array(asked)), rows.take(pa.array(last[asked], mask=~found[asked]))
            out = {k: mine[name] for k, (name, _) in columns.items()} | {"book_ts": before["_t"], "bid": before["_bid"], "ask": before["_ask"]}
            yield from pa.table(out).combine_chunks().to_batches()
            carried = rows.slice(int(last[-1]), 1) if found[-1] else None
    return fill


class Triggers(StatefulProcessor):
    """Fires on a new bar, a 0.3 % move since the last firing, a changed signal or structure, at most every 300 s.

    NULL signals and structures say nothing: the last known one stays.
    """

    def init(self, handle):
        self.seen = handle.getValueState("seen", "bar long, signal string, structure string, price double, fired double")

    def handleInputRows(self, key, rows, timerValues):
        bar, signal, structure, last, fired = self.seen.get() if self.seen.exists() else (None,) * 5
        # Rows are kept as numbers, not as objects; the few different states of bars are kept once.
        whens, prices, places, states = array("d"), array("d"), array("q"), {}
        for row in rows:
            whens.append(row.second.timestamp())
            prices.append(float("nan") if row.price is None else row.price)
            places.append(states.setdefault((row.bar, row.signal, row.structure), len(states)))
        states = list(states)
        for i in in_order(whens):
            when, price = whens[i], prices[i] if prices[i] == prices[i] else None
            new_bar, new_signal, new_structure = states[places[i]]
            reasons = []
            if bar is not None and new_bar is not None and new_bar != bar:
                reasons.append("NEW_BAR")
            if last and price is not None and abs(price / last - 1) >= 0.003:
                reasons.append("PRICE_MOVE")
            if signal is not None and new_signal is not None and new_signal != signal:
                reasons.append("STRATEGY_STATE")
            if structure is not None and new_structure is not None and new_structure != structure:
                reasons.append("STRUCTURE")
            bar = bar if new_bar is None else new_bar
            signal, structure = new_signal or signal, new_structure or structure
            if reasons and (fired is None or when - fired >= 300):
                fired, last = when, price
                yield Row(symbol=key[0], ts=datetime.fromtimestamp(when, timezone.utc), price=price, reasons="|".join(reasons))
        self.seen.update((bar, signal, structure, last, fired))

    def close(self):
        pass


class Silence(StatefulProcessor):
    """Tells how long a feed has been silent, in multiples of its period; no result depends on the cut into batches."""

    def __init__(self, period_ms: int):
        self.period = period_ms

    def init(self, handle):
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, told int")

    def handleInputRows(self, key, rows, timerValues):
        last, told = self.seen.get() if self.seen.exists() else (None, 0)
        stamps = array("d", (row.second.timestamp() for row in rows))
        for i in in_order(stamps):
            now = round(stamps[i] * 1000)
            if last is not None:
                for factor, status in LEVELS[told:]:
                    if now - last > factor * self.period:
                        told += 1
                        yield self.row(key, last + factor * self.period, status)
            if last is None or told:
                yield self.row(key, now, "CONNECTED")
            last, told = now, 0
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        for factor, _ in LEVELS:
            self.handle.registerTimer(last + factor * self.period)
        self.seen.update((last, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, told = self.seen.get()
        while told < len(LEVELS) and last + LEVELS[told][0] * self.period <= expiredTimerInfo.getExpiryTimeInMs():
            factor, status = LEVELS[told]
            told += 1
            yield self.row(key, last + factor * self.period, status)
        self.seen.update((last, told))

    def row(self, key, at_ms, status):
        return Row(symbol=key[0], ts=datetime.fromtimestamp(at_ms / 1000, timezone.utc), status=status)

    def close(self):
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])
