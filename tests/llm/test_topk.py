import math
import random

from tapeline.llm import topk


def slow(rows, every, k):
    good = [(i, key, [math.floor(256 * float(x)) for x in v]) for i, (key, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, q in good:
        if key is not None and key % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), c is None, c or 0, j) for j, c, x in good if j != i)[:k]
            out += [(key, n + 1, None if none else c, -s) for n, (s, none, c, _) in enumerate(scored)]
    return sorted(out, key=str)


def test_equals_all_scores(spark):
    r = random.Random(5)
    for n, dim, shift in ((700, 16, 0.0), (90, 5, 0.7), (4, 3, 0.0)):
        rows = [(i, [r.gauss(shift, .2) for _ in range(dim)]) for i in range(n)]
        rows += [(r.randrange(n), rows[r.randrange(n)][1]) for _ in range(n // 5)] + [rows[0], rows[0], (None, rows[1][1]), (n + 1, None), (n + 2, [None] * dim), (n + 3, [math.nan] + [0.0] * (dim - 1)), (n + 4, [math.inf] * dim), (n + 5, [])]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS id", "'x' AS ids").repartition(3)
        got = topk.top_k(table, every=10, k=5)
        assert sorted(map(tuple, got.collect()), key=str) == slow(rows, 10, 5)
    assert topk.top_k(table.limit(0)).collect() == []


def test_components_of_any_size_are_exact(spark):
    big = float(1 << 40)
    fits = [(1, [1.0, 1.0]), (2, [5e6, 1.0]), (3, [2.0, 1.0]), (4, [1.0, 0.0]), (10, [0.0, 2.0**30]), (13, [-1e300, 0.0]), (20, [1.0, 3.0])]
    table = spark.createDataFrame(fits, "vec_id long, embedding array<double>").repartition(2)
    got = topk.top_k(table, every=10, k=3)
    assert sorted(map(tuple, got.collect()), key=str) == slow(fits, 10, 3)
    far = [(10, [0.0, big]), (1, [1.0, big])]
    try:
        topk.top_k(spark.createDataFrame(far, table.schema), every=10, k=3).collect()
    except Exception as error:
        assert "does not fit a long" in str(error)
    else:
        raise AssertionError("a score beyond the longs went through")
    # Sums that cancel: the partial sums leave the longs, the totals do not.
    even = [(10, [big, big, 1.0]), (1, [big, -big, 3.0]), (2, [big, -big, 2.0]), (3, [-big, big, 5.0]), (4, [0.0, 0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(even, table.schema), every=10, k=3)
    assert sorted(map(tuple, got.collect()), key=str) == slow(even, 10, 3)
