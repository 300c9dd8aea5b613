"""Watchers hold a symbol's rows as numbers: order, states and values survive that, and memory stays small."""

import datetime as dt
import tracemalloc
from types import SimpleNamespace

from pyspark.sql import Row

from tapeline.functions.watchers import Triggers


class Kept:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def watch(rows):
    watcher = Triggers()
    watcher.init(SimpleNamespace(getValueState=lambda *_: Kept()))
    return list(watcher.handleInputRows(("A",), rows, None))


def test_rows_of_a_batch_may_come_in_any_order():
    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    rows = [Row(second=at(s), price=p, bar=b, signal=g, structure=None) for s, p, b, g in ((900, 5.0, 3, "UP"), (0, 1.0, 1, "UP"), (400, None, 2, "DOWN"), (1300, 5.0, 3, None))]
    assert [(r.ts, r.price, r.reasons) for r in watch(iter(rows))] == [(at(400), None, "NEW_BAR|STRATEGY_STATE"), (at(900), 5.0, "NEW_BAR|STRATEGY_STATE")]


def test_a_hundred_thousand_rows_take_a_few_megabytes():
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = (Row(second=start + dt.timedelta(seconds=i), price=1.0, bar=0, signal="UP", structure="x" * 64) for i in range(100_000))
    tracemalloc.start()
    try:
        assert watch(rows) == []
        assert tracemalloc.get_traced_memory()[1] < 12e6
    finally:
        tracemalloc.stop()
