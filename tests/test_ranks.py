import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeline.functions import ranks


def frame():
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else ("b" if i % 2 else None), None if v == 7 else (float("nan") if v == 8 else float(v))) for i, v in enumerate(rng.integers(0, 40, 600))]
    return pd.DataFrame(rows, columns=["k", "v"])


def test_numbers_ranks_and_quantiles_equal_pandas(spark):
    pdf = frame().reset_index(names="i")
    pdf["v"] = pdf["v"].astype(object).where(pdf["v"].notna(), None)
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "i long, k string, v double").repartition(5)
    got = ranks.numbered(df, ["k"], [F.col("v").asc_nulls_last(), F.col("i")]).toPandas()
    assert len(got) == len(pdf)
    for k, own in got.groupby("k", dropna=False):
        own = own.sort_values("place")
        assert list(own.place) == list(range(len(own))) and set(own.total) == {len(own)}
        want = own.sort_values(["v", "i"], na_position="last")
        assert list(want.i) == list(own.i)
    got = ranks.average_ranks(df, ["k"], "v", "r").toPandas()
    assert len(got) == len(pdf)
    want = got.groupby("k", dropna=False)["v"].rank()
    assert np.allclose(got.r.astype(float), want, equal_nan=True)
    got = ranks.quantiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "top": 0.95}).toPandas().set_index("k")
    for k, own in pdf.groupby("k", dropna=False):
        v = pd.to_numeric(own.v).dropna()
        row = got.loc[k] if isinstance(k, str) else got[got.index.isna()].iloc[0]
        assert np.allclose([row.low, row.mid, row.top], np.quantile(v, [0.1, 0.5, 0.95]))


def test_without_keys_and_empty(spark):
    df = spark.range(100).selectExpr("id % 7 AS v", "id")
    got = ranks.numbered(df, [], [F.col("v"), F.col("id").desc()]).orderBy("place").collect()
    assert [(r.v, r.id) for r in got] == sorted(((i % 7, i) for i in range(100)), key=lambda x: (x[0], -x[1]))
    assert ranks.numbered(df.limit(0), ["v"], [F.col("id")]).collect() == []
    assert ranks.quantiles(df.limit(0), ["v"], "id", {"p": 0.5}).collect() == []
    assert ranks.quantiles(df, [], "id", {"p": 0.5}).collect()[0].p == 49.5


def test_digest_does_not_depend_on_partitions(spark):
    import hashlib

    from tapeline.operators import quality
    rows = [(f"s{i:05d}", i % 7, None if i % 5 == 0 else i / 4) for i in range(4200)]
    df = spark.createDataFrame(rows, "symbol string, n long, x double")
    got = {tuple(quality.digest_rows(d, ["symbol", "n", "x"], ["symbol"]).first()) for d in (df, df.repartition(7), df.orderBy(F.desc("symbol")))}
    level = [hashlib.sha256(",".join("-" if v is None else str(v) for v in r).encode()).hexdigest() for r in rows]
    while True:
        level = [hashlib.sha256("".join(level[i : i + 64]).encode()).hexdigest() for i in range(0, len(level), 64)]
        if len(level) == 1:
            break
    assert got == {(level[0], 4200)}
    assert tuple(quality.digest_rows(df.limit(0), ["n"], ["symbol"]).first()) == (None, 0)
