"""Structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import indicators as ind, structure as st
from tapeline.plans.bars import ADX_CTES, TR, TRC, WIN, q
from tapeline.plans.base import HOURLY_SQL, R, RUN, W, ewm_sql, hourly, roll, rows, show
from tapeline.plans.features import SWING_CTE


def swings(spark, d):
    return show(st.swing_table(hourly(spark, d)), "symbol", "swing_kind", "swing_price", "pivot", "formed_at", "known_from", "known_at")


def price_gaps(spark, d):
    return show(st.price_gaps(ind.sx_atr(hourly(spark, d))), "symbol", "ts", "n", "direction", "bottom", "top", "size", "size_atr",
                "age", "filled_percent", "status", filled_percent=4)


def price_gaps_as_of(spark, d):
    out = st.price_gaps_as_of(ind.sx_atr(hourly(spark, d)), "2024-01-15 00:00:00")
    return show(out, "symbol", "ts", "direction", "age", "filled_percent", "status", filled_percent=4)


def fib_levels(spark, d):
    out = st.fib_ladder(hourly(spark, d)).select("symbol", "status", "direction", F.explode("levels").alias("ratio", "level"))
    return show(out, "symbol", "status", "direction", "ratio", "level")


def structure_breaks(spark, d):
    out = st.breaks(ind.sx_volume(ind.sx_atr(hourly(spark, d))))
    return show(out, "symbol", "ts", "n", "break_type", "direction", "break_price", "break_pivot", "volume_ratio", "confirmation")


def structure_changes(spark, d):
    out = st.structure_state(ind.sx_atr(hourly(spark, d)))
    return out.select("symbol", "ts", "bos_at", "choch_at", "gap_at", "changed")


def divergences(spark, d):
    bars = ind.rsi(hourly(spark, d))
    return bars.select("symbol", "ts", st.divergence("close", "rsi").alias("rsi_divergence"))


SW = [SWING_CTE, "sz AS (SELECT *, CASE WHEN is_high THEN 'HIGH' WHEN is_low THEN 'LOW' END AS kind, round(CASE WHEN is_high THEN high WHEN is_low THEN low END, 6) AS price FROM sw)"]
REST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def gaps_ctes(source: str) -> list[str]:
    return [f"g0 AS (SELECT {source}.*, ea, row_number() {W} - 1 AS n, count(*) OVER (PARTITION BY symbol) - 1 AS last_n, lag(high, 2) {W} AS h2, lag(low, 2) {W} AS l2, "
            f"min(low) {REST} AS fmin, max(high) {REST} AS fmax FROM {source} JOIN ea USING (symbol, ts))",
            "g1 AS (SELECT *, CASE WHEN h2 < low THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CASE WHEN h2 < low THEN h2 ELSE high END AS bottom, CASE WHEN h2 < low THEN low ELSE l2 END AS top FROM g0 WHERE h2 < low OR l2 > high)",
            "g2 AS (SELECT *, top - bottom AS size, coalesce(least(1, greatest(0, CASE WHEN direction = 'BULLISH' THEN top - fmin ELSE fmax - bottom END / greatest(top - bottom, 1e-12))), 0) AS f FROM g1)"]


STATUS = "CASE WHEN f >= 0.999 THEN 'FILLED' WHEN f > 0 THEN 'PARTIALLY_FILLED' ELSE 'OPEN' END"

BREAKS_CTES = f"""{TRC}, {ewm_sql("ea", "trc", "tr", "(1.0/14)")}, {", ".join(SW)},
 o AS (SELECT sz.symbol, sz.ts, sz.n, sz.close, lag(sz.close) OVER w AS pc, greatest(ea, sz.close * 0.0005) AS noise, volume,
   volume / nullif({roll('median({})', 'sz.volume', 30).replace('PARTITION BY symbol ORDER BY ts', 'PARTITION BY sz.symbol ORDER BY sz.ts')}, 0) AS vr,
   lag(kind, 4) OVER w AS k, lag(price, 4) OVER w AS p, lag(n, 4) OVER w AS pn
   FROM sz JOIN ea USING (symbol, ts) WINDOW w AS (PARTITION BY sz.symbol ORDER BY sz.ts)),
 st AS (SELECT symbol, ts, n, CAST([] AS STRUCT(n BIGINT, p DOUBLE)[]) AS hs, CAST([] AS STRUCT(n BIGINT, p DOUBLE)[]) AS ls, 'RANGE' AS trend,
   CAST(NULL AS VARCHAR) AS typ, CAST(NULL AS BOOLEAN) AS up, CAST(NULL AS DOUBLE) AS bp, CAST(NULL AS BIGINT) AS bn, vr FROM o WHERE n = 0
  UNION ALL
  SELECT symbol, ts, n, CASE WHEN up THEN hs[:-2] ELSE hs END, CASE WHEN NOT up THEN ls[:-2] ELSE ls END,
    CASE WHEN up IS NULL THEN trend WHEN up THEN 'UP' ELSE 'DOWN' END,
    CASE WHEN up IS NULL THEN NULL WHEN trend = CASE WHEN up THEN 'DOWN' ELSE 'UP' END THEN 'CHOCH' ELSE 'BOS' END, up,
    CASE WHEN up THEN hs[-1].p WHEN NOT up THEN ls[-1].p END, CASE WHEN up THEN hs[-1].n WHEN NOT up THEN ls[-1].n END, vr
  FROM (SELECT *, CASE WHEN len(hs) > 0 AND pc <= hs[-1].p AND hs[-1].p < close AND close - hs[-1].p >= 0.05 * noise THEN TRUE
                       WHEN len(ls) > 0 AND pc >= ls[-1].p AND ls[-1].p > close AND ls[-1].p - close >= 0.05 * noise THEN FALSE END AS up FROM (
    SELECT o.symbol, o.ts, o.n, o.close, o.pc, o.noise, o.vr, st.trend,
      CASE WHEN o.k = 'HIGH' THEN list_append(st.hs, CAST(row(o.pn, o.p) AS STRUCT(n BIGINT, p DOUBLE))) ELSE st.hs END AS hs,
      CASE WHEN o.k = 'LOW' THEN list_append(st.ls, CAST(row(o.pn, o.p) AS STRUCT(n BIGINT, p DOUBLE))) ELSE st.ls END AS ls
    FROM st JOIN o ON o.symbol = st.symbol AND o.n = st.n + 1)))"""

FIB_SQL = "WITH " + HOURLY_SQL + ", " + ", ".join(SW) + """,
 k AS (SELECT symbol, n, kind, price, lag(kind) OVER w AS pk, lag(price) OVER w AS pp FROM sz WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY n)),
 e AS (SELECT symbol, kind AS last_kind, CASE WHEN kind = 'LOW' THEN price ELSE pp END AS lo, CASE WHEN kind = 'HIGH' THEN price ELSE pp END AS hi FROM k WHERE pk <> kind
   QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1),
 r AS (SELECT unnest([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.618, 2.0]::DOUBLE[]) AS ratio),
 f AS (SELECT symbol, last_kind = 'HIGH' AS up, CAST(ratio AS VARCHAR) AS ratio, CASE WHEN (last_kind = 'HIGH') = (ratio <= 1) THEN hi - (hi - lo) * CASE WHEN ratio <= 1 THEN ratio ELSE ratio END
   ELSE lo + (hi - lo) * ratio END AS level FROM e, r)
 SELECT symbol, 'AVAILABLE' AS status, CASE WHEN up THEN 'UP' ELSE 'DOWN' END AS direction, ratio, """ + R("level") + " AS level FROM f"


def _div_sql():
    from tapeline.plans.bars import RSI_CTES
    a, b = rows(15), rows(15, -15)
    return q(*RSI_CTES, "j AS (SELECT c.symbol, c.ts, close, rsi FROM c JOIN rs USING (symbol, ts))",
             final=f"""SELECT symbol, ts, CASE WHEN count(*) {rows(30)} < 30 THEN 'NONE'
  WHEN min(close) {a} < min(close) {b} AND min(rsi) {a} > min(rsi) {b} THEN 'BULLISH'
  WHEN max(close) {a} > max(close) {b} AND max(rsi) {a} < max(rsi) {b} THEN 'BEARISH' ELSE 'NONE' END AS rsi_divergence FROM j""")


QUERIES = {
    "swings": (swings, q(HOURLY_SQL, *SW, final=f"SELECT * FROM (SELECT symbol, kind AS swing_kind, {R('price')} AS swing_price, n AS pivot, ts AS formed_at, n + 3 AS known_from, lead(ts, 3) {W} AS known_at FROM sz) WHERE swing_kind IS NOT NULL")),
    "price_gaps": (price_gaps, q(HOURLY_SQL, TRC, ewm_sql("ea", "trc", "tr", "(1.0/14)"), *gaps_ctes("c"),
                                 final=f"SELECT symbol, ts, n, direction, {R('bottom')} AS bottom, {R('top')} AS top, {R('size')} AS size, {R('size / greatest(ea, 1e-12)')} AS size_atr, last_n - n AS age, {R('f * 100', 4)} AS filled_percent, {STATUS} AS status FROM g2")),
    "price_gaps_as_of": (price_gaps_as_of, q(HOURLY_SQL, "cc AS (SELECT * FROM c WHERE ts <= TIMESTAMP '2024-01-15')", TRC, ewm_sql("ea", "trc", "tr", "(1.0/14)"), *gaps_ctes("cc"),
                                             final=f"SELECT symbol, ts, direction, last_n - n AS age, {R('f * 100', 4)} AS filled_percent, {STATUS} AS status FROM g2")),
    "fib_levels": (fib_levels, FIB_SQL),
    "structure_breaks": (structure_breaks, f"""WITH RECURSIVE {HOURLY_SQL}, {BREAKS_CTES}
 SELECT symbol, ts, n, typ AS break_type, CASE WHEN up THEN 'BULLISH' ELSE 'BEARISH' END AS direction, {R('bp')} AS break_price, bn AS break_pivot,
  {R('coalesce(vr, 1)')} AS volume_ratio, CASE WHEN coalesce(vr, 1) >= 1.2 THEN 'VOLUME_CONFIRMED' ELSE 'CLOSE_CONFIRMED' END AS confirmation FROM st WHERE typ IS NOT NULL"""),
    "structure_changes": (structure_changes, f"""WITH RECURSIVE {HOURLY_SQL}, {BREAKS_CTES}
, gp AS (SELECT symbol, ts, coalesce(lag(high, 2) {W} < low OR lag(low, 2) {W} > high, FALSE) AS gap FROM c),
 sv AS (SELECT symbol, ts, n, max(CASE WHEN typ = 'BOS' THEN n END) {W} AS bos_at, max(CASE WHEN typ = 'CHOCH' THEN n END) {W} AS choch_at, max(CASE WHEN gap THEN n END) {W} AS gap_at FROM st JOIN gp USING (symbol, ts))
 SELECT symbol, ts, bos_at, choch_at, gap_at, NOT coalesce(bos_at IS NOT DISTINCT FROM lag(bos_at) {W} AND choch_at IS NOT DISTINCT FROM lag(choch_at) {W} AND gap_at IS NOT DISTINCT FROM lag(gap_at) {W} AND lag(n) {W} IS NOT NULL, FALSE) AS changed FROM sv"""),
    "divergences": (divergences, _div_sql()),
}
