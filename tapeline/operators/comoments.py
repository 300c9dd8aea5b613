"""Moments of all pairs of series by blocks of symbols and spans of time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tapeline.functions.series import ratio

MOMENTS = ("samples", "x", "y", "xx", "yy", "xy")


def pair_moments(values: DataFrame, value: str = "ret", width: int = 64, days: int = 30) -> DataFrame:
    """Per pair left < right: shared stamps and the sums of both values, squares and products over them.

    Needs symbol, ts and ``value``, unique per symbol and stamp.  Symbols are dealt into blocks of about ``width``; each row
    goes once to every pair of blocks it belongs to, one task multiplies two blocks over ``days``, and the products are summed
    per pair.  So a row is sent as often as there are blocks, not as there are symbols, and no task holds more than two
    blocks of a span.  NULL and non-finite values and NULL keys take no part; pairs without a shared stamp have no row.
    """
    c = F.col
    known = values.select("symbol", "ts", c(value).cast("double").alias("v")).filter("symbol is not null and ts is not null and v is not null and not isnan(v) and abs(v) < double('infinity')")
    blocks = max(1, -(-known.select("symbol").distinct().count() // width))
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    dealt = known.select("symbol", "v", F.unix_micros("ts").alias("at"), F.floor(F.unix_seconds("ts") / (86400 * days)).alias("span"), own.alias("own"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")})

    def multiply(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        names, row = np.unique(frame["symbol"].to_numpy(), return_inverse=True)
        stamps, column = np.unique(frame["at"].to_numpy(), return_inverse=True)
        v, seen = np.zeros((len(names), len(stamps))), np.zeros((len(names), len(stamps)))
        v[row, column], seen[row, column] = frame["v"].to_numpy(), 1.0
        home = np.empty(len(names), int)
        home[row] = frame["own"].to_numpy()
        a, b = np.nonzero(home == key[1])[0], np.nonzero(home == key[2])[0]
        va, vb, sa, sb = v[a], v[b], seen[a], seen[b]
        products = (sa @ sb.T, va @ sb.T, sa @ vb.T, (va * va) @ sb.T, sa @ (vb * vb).T, va @ vb.T)
        left, right = np.meshgrid(a, b, indexing="ij")
        use = (products[0] > 0) & ((left < right) if key[1] == key[2] else True)
        out = pd.DataFrame({"p": names[left[use]], "q": names[right[use]], **{n: m[use] for n, m in zip(MOMENTS, products, strict=True)}})
        turned = out["p"] > out["q"]
        swapped = out[turned].rename(columns={"p": "q", "q": "p", "x": "y", "y": "x", "xx": "yy", "yy": "xx"})
        return pd.concat([out[~turned], swapped])[["p", "q", *MOMENTS]]

    parts = dealt.groupBy("span", "i", "j").applyInPandas(multiply, "p string, q string, " + ", ".join(f"{m} double" for m in MOMENTS))
    return parts.groupBy(c("p").alias("left"), c("q").alias("right")).agg(F.sum("samples").cast("long").alias("samples"), *[F.sum(m).alias(m) for m in MOMENTS[1:]])


def pair_correlation(values: DataFrame, value: str = "ret", least: int = 30, width: int = 64, days: int = 30) -> DataFrame:
    """Pearson correlation of every pair with ``least`` shared stamps; NULL without spread."""
    c = F.col
    m = pair_moments(values, value, width, days).filter(c("samples") >= least)
    spread = lambda s, ss: F.when(c("samples") * c(ss) - c(s) * c(s) > 1e-12 * c("samples") * c(ss), c("samples") * c(ss) - c(s) * c(s))
    return m.select("left", "right", "samples", ratio(c("samples") * c("xy") - c("x") * c("y"), F.sqrt(spread("x", "xx")) * F.sqrt(spread("y", "yy"))).alias("correlation"))
