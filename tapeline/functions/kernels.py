"""Small state machines that run once per series inside a task.

Only numpy and plain Python; pickled by value, so executors need no copy of
this package.
"""

from __future__ import annotations

import heapq
import sys
from bisect import bisect_right, insort

from pyspark import cloudpickle


def stop_and_reverse(high, low, step: float, top: float) -> list[float]:
    """Parabolic stop-and-reverse levels."""
    out, rising, peak, pace = [low[0]], True, high[0], step
    for i in range(1, len(high)):
        level = out[-1] + pace * (peak - out[-1])
        near, far = i - 1, max(i - 2, 0)
        if rising:
            level = min(level, low[near], low[far])
            broken, better = low[i] < level, high[i] > peak
        else:
            level = max(level, high[near], high[far])
            broken, better = high[i] > level, low[i] < peak
        if broken:
            level, rising, pace = peak, not rising, step
            peak = high[i] if rising else low[i]
        elif better:
            peak, pace = (high[i] if rising else low[i]), min(top, pace + step)
        out.append(level)
    return out


def structure_breaks(close, atr, kind, price, known_from):
    """Breaks of confirmed swings in one series.

    ``kind``/``price``/``known_from`` list the swings in pivot order; a swing may
    be broken on bars after ``known_from``, and once only.  Two stacks hold the
    unbroken highs and lows, newest on top, so every swing is pushed and popped
    at most once.  Returns (bar, swing, bullish, event type) per break.
    """
    stacks = {"HIGH": [], "LOW": []}
    trend, cursor, events = "RANGE", 0, []
    for i in range(1, len(close)):
        while cursor < len(kind) and known_from[cursor] < i:
            stacks[kind[cursor]].append(cursor)
            cursor += 1
        now, before = close[i], close[i - 1]
        noise = max(atr[i] if atr[i] == atr[i] else now * 0.002, now * 0.0005)
        broken = bullish = None
        top = stacks["HIGH"][-1] if stacks["HIGH"] else None
        floor = stacks["LOW"][-1] if stacks["LOW"] else None
        if top is not None and before <= price[top] < now and now - price[top] >= 0.05 * noise:
            broken, bullish = stacks["HIGH"].pop(), True
        elif floor is not None and before >= price[floor] > now and price[floor] - now >= 0.05 * noise:
            broken, bullish = stacks["LOW"].pop(), False
        if broken is not None:
            turn = trend == ("DOWN" if bullish else "UP")
            events.append((i, broken, bullish, "CHOCH" if turn else "BOS"))
            trend = "UP" if bullish else "DOWN"
    return events


def expanding_share(values) -> list[float]:
    """At each place the share of the values so far that are not above the current one."""
    seen, out = [], []
    for v in values:
        if v == v:
            insort(seen, v)
            out.append(bisect_right(seen, v) / len(seen))
        else:
            out.append(float("nan"))
    return out


def expanding_regularity(gaps, factor: float = 3.0) -> list[float]:
    """At each place the share of the gaps so far within ``factor`` times their median; 0 before the first."""
    seen, out = [], []
    for g in gaps:
        if g == g:
            insort(seen, g)
        if not seen:
            out.append(0.0)
            continue
        half = len(seen) // 2
        median = seen[half] if len(seen) % 2 else (seen[half - 1] + seen[half]) / 2
        out.append(bisect_right(seen, median * factor) / len(seen))
    return out


def open_gaps(high, low, band_price, band_half, band_side):
    """Follow price gaps that later bars have not filled.

    Yields per bar the newest open gap (+1/-1/0, bottom, top) and whether one of
    the twelve newest on ``band_side`` overlaps ``band_price`` +- ``band_half``.
    Fill levels sit in two heaps, so a gap is opened and closed once.
    """
    live, rising, falling, serial = {}, [], [], 0
    sides, bottoms, tops, meets = [], [], [], []
    nan = float("nan")
    for i in range(len(high)):
        while rising and -rising[0][0] >= low[i]:
            live.pop(heapq.heappop(rising)[1], None)
        while falling and falling[0][0] <= high[i]:
            live.pop(heapq.heappop(falling)[1], None)
        if i >= 2:
            side = 1 if high[i - 2] < low[i] else -1 if low[i - 2] > high[i] else 0
            if side:
                bottom, top = (high[i - 2], low[i]) if side > 0 else (high[i], low[i - 2])
                bottom, top = round(bottom, 6), round(top, 6)
                size = max(top - bottom, 1e-12)
                live[serial] = (side, bottom, top)
                if side > 0:
                    heapq.heappush(rising, (-(top - 0.999 * size), serial))
                else:
                    heapq.heappush(falling, (bottom + 0.999 * size, serial))
                serial += 1
        newest = next(reversed(live.values())) if live else None
        sides.append(newest[0] if newest else 0)
        bottoms.append(newest[1] if newest else nan)
        tops.append(newest[2] if newest else nan)
        meet = 0
        if band_price[i] == band_price[i]:
            for count, (side, bottom, top) in enumerate(reversed(live.values())):
                if count == 12 or meet:
                    break
                if side == band_side[i] and min(top, band_price[i] + band_half[i]) > max(bottom, band_price[i] - band_half[i]):
                    meet = 1
        meets.append(meet)
    return sides, bottoms, tops, meets


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def common_length(x: str, y: str, masks: dict[str, int]) -> int:
    """Length of the longest common subsequence; ``masks`` holds the places of x's characters as bits."""
    full = (1 << len(x)) - 1
    rest = full
    for ch in y:
        hit = rest & masks.get(ch, 0)
        if hit:
            rest = ((rest + hit) | (rest - hit)) & full
    return len(x) - rest.bit_count()


def places(x: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(x):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out
