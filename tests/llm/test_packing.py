import re

import numpy as np

from tapeline.llm import packing


def slow_fill(lengths, sizes):
    """The same rules by scanning every open bin."""
    open_bins, out = [], []
    for i, n in enumerate(lengths):
        fits = [b for b in open_bins if b["room"] >= n]
        if fits:
            least = min(b["room"] for b in fits)
            b = [x for x in sorted(fits, key=lambda x: x["at"]) if x["room"] == least][-1]
        else:
            hope = lambda s: min(s, n + sum(x for x in lengths[i + 1:] if x <= s - n))  # noqa: B023, E731
            s = min((s for s in sorted(sizes) if s >= n), key=lambda s: (packing.cost(s) / hope(s), s))
            b = {"id": len(open_bins), "room": s, "used": 0, "at": 0}
            open_bins.append(b)
        b["room"] -= n
        b["used"] += n
        b["at"] = i
        out.append(b["id"])
    return out, [min(s for s in sizes if s >= b["used"]) for b in open_bins]


def test_fill_equals_scan():
    rng = np.random.default_rng(3)
    for sizes in ((16, 32, 64), (10,), (7, 50)):
        for n in (0, 1, 5, 120):
            lengths = sorted(rng.integers(1, max(sizes) + 1, n).tolist(), reverse=True)
            bins, capacity = packing.fill(np.array(lengths, dtype=np.int64), sizes)
            want = slow_fill(lengths, sizes)
            assert bins.tolist() == want[0] and capacity.tolist() == want[1]


def test_pack_keeps_every_token_once(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "x " * 50), (1, "a b c"), (5, "w " * 1000), (6, "é b\tc\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS key", "'x' AS bin")
    bins = packing.pack(docs, sizes=(16, 64), shard_pieces=6).collect()
    pieces = sorted((d if d is not None else -1, s, n) for b in bins for d, s, n in zip(b.doc_ids, b.starts, b.lengths, strict=True))
    want = []
    for d, t in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        want += [(d if d is not None else -1, s, min(64, n - s)) for s in range(0, n, 64)]
    assert pieces == sorted(want)
    for b in bins:
        assert b.used == sum(b.lengths) <= b.capacity and b.capacity == min(s for s in (16, 64) if s >= b.used)
    assert len({b.shard for b in bins}) > 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_less_cost_than_one_size(spark):
    rng = np.random.default_rng(0)
    lengths = np.sort(np.minimum(8192, rng.lognormal(5.5, 1.2, 3000)).astype(int) + 1)[::-1]
    lengths = np.minimum(lengths, 8192)
    _, several = packing.fill(lengths)
    _, one = packing.fill(lengths, (8192,))
    assert packing.cost(several.astype(float)).sum() < packing.cost(one.astype(float)).sum()
