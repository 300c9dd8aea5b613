"""News and text queries over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import news as nw
from tapeline.plans.bars import q
from tapeline.plans.base import HOURLY_SQL, R, W, hourly, r, show, table
from tapeline.session import cut

NOW = "2024-01-31 00:00:00"
# Words that occur in the corpus stand in for the finance lists, which real feeds use.
WEIGHTS = {"that": 14, "with": 18, "this": 12, "are": 8, "was": -12, "for": -9, "und": 22, "des": -16, "que": 11, "from": -14}
EVENTS = {"Earnings": ("attion", "eriner"), "Regulation": ("thanedble", "nicht"), "Legal": ("ciue", "eauou"), "Product": ("with",)}
SECTORS = {"north": ("thin", "ther"), "south": ("para", "sch"), "west": ("les",)}
ALIASES = {"AAA": ("anea", "orin"), "BBB": ("elle",), "CCC": ("zz",)}
SOURCES = {f"src{i}": ("", "", 0.5 + i / 50, "", "", 1) for i in range(12)}
SYMBOLS = ("click", "error", "purchase", "signup", "view")


def _news(spark, d):
    c = F.col
    t0 = table(spark, d, "events").agg(F.min("ts").alias("t0"))
    i = c("doc_id")
    return (table(spark, d, "documents").crossJoin(F.broadcast(t0)).select(
        i.alias("id"), F.substring_index("text", "\n", 1).alias("title"), "text", "source", c("source").alias("provider"),
        F.timestamp_micros(F.unix_micros("t0") + F.pmod(i, F.lit(720)) * 3600000000).alias("published_at"),
        F.array(F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (F.pmod(i, F.lit(5)) + 1).cast("int"))).alias("symbols"), (i % 4 + 1).alias("related_sources")))


def _analyzed(spark, d):
    return nw.analyze(_news(spark, d), weights=WEIGHTS, events=EVENTS, sectors=SECTORS, aliases=ALIASES, sources=SOURCES, sensitive=("Regulation",))


def news_lexicon_sentiment(spark, d):
    out = _analyzed(spark, d)
    return show(out.withColumns({"sectors": F.array_join("sectors", ","), "symbols": F.array_join("symbols", ",")}), "id", "sentiment", "label", "direction", "event_type", "sectors", "symbols",
                "magnitude", "confidence", "impact", "level")


def news_radar(spark, d):
    return show(nw.radar(_analyzed(spark, d)), "items", "market_sentiment", "positive", "negative", "neutral", "major")


def news_sector_impact(spark, d):
    return nw.sector_impact(_analyzed(spark, d))


def news_weighted(spark, d):
    rel = nw.by_symbol(_analyzed(spark, d))
    return show(nw.weighted_score(rel, NOW), "symbol", "news_score", "items")


def news_decisions(spark, d):
    c = F.col
    df = _analyzed(spark, d).select("id", c("sentiment").alias("news_score"), (c("id") % 100).cast("double").alias("technical_score"), ((c("id") % 30) / 10).alias("volume_ratio"), (c("id") % 130).alias("samples"))
    return show(nw.horizon_estimates(nw.decide(df)), "id", "horizon", "composite", "buy", "hold", "avoid", "view", "grade", "up", "down")


def news_feed(spark, d):
    return show(nw.feed(_analyzed(spark, d), NOW, label="bullish", hours=480, page=2, size=40), "id", "impact", "published_at")


def news_watch(spark, d):
    rel = nw.by_symbol(_analyzed(spark, d))
    watched = table(spark, d, "events").filter("event_type in ('view', 'signup')").select(F.col("event_type").alias("symbol"))
    return nw.watch_news(rel, watched.unionByName(watched.limit(1).select(F.lit("AAA").alias("symbol")))).select("id", "matched", "sentiment")


def news_headline_signal(spark, d):
    rel = _news(spark, d).select("title", "published_at", F.col("symbols")[0].alias("symbol"))
    return show(nw.headline_signal(rel, ("that", "und", "is"), ("was", "de", "for"), NOW), "symbol", "signal", "day", "week")


def news_text(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.sha2(nw.letters(F.col("text")), 256).alias("fingerprint"), F.length(nw.letters(F.col("text"))).cast("long").alias("kept"), nw.readable(F.substring_index("text", "\n", 1)).alias("readable"),
                      nw.identity(F.substring_index("text", "\n", 1), F.col("source")).alias("identity"))


def news_pages_plain(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.sha2(nw.plain(F.col("html")), 256).alias("digest"), F.length(nw.plain(F.col("html"))).cast("long").alias("chars"))


def news_freshness(spark, d):
    return _news(spark, d).groupBy(nw.freshness(F.col("published_at"), "2024-01-20 00:00:00").alias("freshness")).agg(F.count(F.lit(1)).alias("items"))


def news_published(spark, d):
    c = F.col
    base = F.timestamp_seconds(F.unix_seconds("published_at"))
    raw = (F.when(c("id") % 4 == 0, F.unix_seconds("published_at").cast("string")).when(c("id") % 4 == 1, F.concat(F.date_format(base, "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
           .when(c("id") % 4 == 2, F.concat(F.date_format(base, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("soon"))
    return _news(spark, d).select("id", nw.published(raw).alias("published_at"))


def news_similar(spark, d):
    a = _analyzed(spark, d).select("id", "event_type", "label", "sectors", F.when(F.col("id") % 3 == 0, "BULL").otherwise("BEAR").alias("market_regime"), F.when(F.col("id") % 2 == 0, "HIGH").otherwise("LOW").alias("volatility_regime"),
                                   F.round("impact", 1).alias("impact"))
    return show(nw.similar(a, a), "query_id", "id", "similarity", "rank")


def _study(spark, d):
    ev = _analyzed(spark, d).select("id", F.element_at(F.filter("symbols", lambda s: s.isin(*SYMBOLS)), 1).alias("symbol"), "label", "event_type", "published_at")
    return cut(ev), hourly(spark, d)  # the texts are read and scored once


def event_study(spark, d):
    ev, bars = _study(spark, d)
    return show(nw.event_outcomes(ev, bars, benchmark=bars.filter("symbol = 'view'")), "id", "symbol", "h", "entry_ts", "entry", "ret", "window", "abnormal", "abnormal_window")


def event_study_metrics(spark, d):
    ev, bars = _study(spark, d)
    return show(nw.event_metrics(nw.event_outcomes(ev, bars, benchmark=bars.filter("symbol = 'view'"))), "h", "samples", "directional", "win_rate", "mean", "median", "std", "max_return", "min_return",
                "window_mean", "profit_loss_ratio", "car", "ci_low", "ci_high", "evidence")


def event_outcome_shares(spark, d):
    ev, bars = _study(spark, d)
    out = nw.event_outcomes(ev, bars, (1, 5, 20)).select("id", F.concat(F.lit("T+"), F.col("h").cast("string")).alias("horizon"), "ret")
    return show(nw.outcome_shares(ev, out), "event_type", "horizon", "up", "sideways", "down", "samples")


def event_priced_in(spark, d):
    ev, bars = _study(spark, d)
    return show(nw.priced_in(ev, bars), "id", "symbol", "pre_return", "post_return", "score", "assessment")


def headline_leaders(spark, d):
    return nw.clusters(_news(spark, d)).filter("relation = 'FOLLOW_UP'").select("id", "leader")


def headline_clusters(spark, d):
    return nw.clusters(_news(spark, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("items"))


def news_dedupe(spark, d):
    return nw.dedupe(_news(spark, d)).select("id", "items", "titles", "related_sources")


def news_collection(spark, d):
    return nw.collection_status(_news(spark, d), [f"src{i}" for i in (*range(20), 99)])


def benchmarks(spark, d):
    assets = hourly(spark, d).select("symbol").distinct().withColumn("market", F.when(F.col("symbol") == "signup", "CN").when(F.col("symbol") == "error", "US").otherwise("CRYPTO"))
    return nw.benchmark_of(assets)


# --- SQL ---------------------------------------------------------------------------


def _has(w: str) -> str:
    return f"contains(x, '{w}')"


SCORE = " + ".join(f"CASE WHEN {_has(w)} THEN {v} ELSE 0 END" for w, v in WEIGHTS.items())
HITS = " + ".join(f"CAST({_has(w)} AS INT)" for w in WEIGHTS)
KIND = "CASE " + " ".join(f"WHEN {' OR '.join(_has(w) for w in ws)} THEN '{k}'" for k, ws in EVENTS.items()) + " ELSE 'General Market News' END"


def _tags(t: dict) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(_has(w) for w in ws)} THEN '{k}' END" for k, ws in t.items()) + "], lambda v: v IS NOT NULL)"


NEWS = ["nd AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text, source, (SELECT min(ts) FROM events) + to_hours(doc_id % 720) AS published_at, ['click','error','purchase','signup','view'][doc_id % 5 + 1] AS sym, doc_id % 4 + 1 AS rel FROM documents)"]
AN = [*NEWS, "n1 AS (SELECT *, ' ' || lower(title || ' ' || text) || ' ' AS x FROM nd)",
      f"n2 AS (SELECT *, greatest(-100, least(100, {SCORE})) AS s, {HITS} AS hits, {KIND} AS event_type, list_sort({_tags(SECTORS)}) AS sectors, list_sort(list_append({_tags(ALIASES)}, sym)) AS symbols FROM n1)",
      "n3 AS (SELECT *, CASE WHEN s = 0 THEN 1 ELSE least(5, greatest(1, CAST(ceil(abs(s) / 20) AS BIGINT))) END AS mag, CASE WHEN s >= 10 THEN 'bullish' WHEN s <= -10 THEN 'bearish' ELSE 'neutral' END AS label FROM n2)",
      """an AS (SELECT *, least(0.95, 0.45 + 0.08 * hits + 0.1 + 0.08) AS conf, round(0.18 * CASE WHEN source IN (""" + ", ".join(f"'{k}'" for k in SOURCES) + """) THEN 0.5 + CAST(substr(source, 4) AS INT) / 50 ELSE 0.55 END * 100
  + 0.2 * mag * 20 + 0.22 * 90 + 0.1 * greatest(20, 100 - 18.0 * greatest(0, rel - 1)) + 0.15 * CASE WHEN event_type = 'Regulation' THEN 85 ELSE 62 END + 7.5, 1) AS impact FROM n3)"""]
DEC = [*AN, """d0 AS (SELECT id, greatest(-100, least(100, s * 0.45::DOUBLE + (id % 100 - 50) * 0.6::DOUBLE + greatest(-10, least(10, ((id % 30) / 10 - 1) * 10)))) AS comp, id % 100 AS tech, id % 130 AS samples FROM an)""",
       "d1 AS (SELECT *, round_even(greatest(0, least(100, 50 + comp * 0.65)), 0) AS b, round_even(greatest(0, least(100, 50 - comp * 0.65)), 0) AS a FROM d0)", "d2 AS (SELECT *, greatest(0, 100 - greatest(b, a)) AS h FROM d1)",
       "hz AS (SELECT * FROM (VALUES ('T+1', 1.0), ('T+3', 0.78), ('T+5', 0.62)) v(horizon, fade))", "d3 AS (SELECT *, greatest(-30, least(30, comp * fade * 0.3)) AS e FROM d2, hz)"]
OUT = [HOURLY_SQL, *AN, f"br AS (SELECT *, row_number() {W} - 1 AS n, coalesce(lag(close) {W}, open) AS pre FROM c)", "hh AS (SELECT unnest([1, 3, 5, 10, 20]) AS h)",
       "e1 AS (SELECT an.id, an.sym AS symbol, label, event_type, published_at, br.n, br.ts AS entry_ts, br.open AS entry, br.pre FROM an ASOF JOIN br ON an.sym = br.symbol AND an.published_at < br.ts)",
       "e2 AS (SELECT e1.*, h, x.close / entry - 1 AS ret, x.close / e1.pre - 1 AS win FROM e1, hh JOIN br x ON x.symbol = e1.symbol AND x.n = e1.n + h - 1)",
       "b1 AS (SELECT an.id, br.n, br.open AS entry, br.pre FROM an ASOF JOIN (SELECT * FROM br WHERE symbol = 'view') br ON an.published_at < br.ts)",
       "b2 AS (SELECT b1.id, h, x.close / entry - 1 AS br, x.close / b1.pre - 1 AS bw FROM b1, hh JOIN br x ON x.symbol = 'view' AND x.n = b1.n + h - 1)",
       "oc AS (SELECT e2.*, ret - br AS abn, win - bw AS abw, CASE label WHEN 'bearish' THEN -ret WHEN 'bullish' THEN ret END AS dr FROM e2 LEFT JOIN b2 USING (id, h))"]
OUT = [x.replace("FROM e1, hh JOIN", "FROM e1 CROSS JOIN hh JOIN").replace("FROM b1, hh JOIN", "FROM b1 CROSS JOIN hh JOIN") for x in OUT]
LET = "regexp_replace(lower({}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"

QUERIES = {
    "news_lexicon_sentiment": (news_lexicon_sentiment, q(*AN, final=f"""SELECT id, s AS sentiment, label, CASE WHEN s >= 45 THEN 'STRONG_POSITIVE' WHEN s >= 10 THEN 'POSITIVE' WHEN s <= -45 THEN 'STRONG_NEGATIVE' WHEN s <= -10 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction, event_type,
  array_to_string(sectors, ',') AS sectors, array_to_string(symbols, ',') AS symbols, mag AS magnitude, {R('conf')} AS confidence, {R('impact')} AS impact, CASE WHEN impact >= 80 THEN 'EXTREME' WHEN impact >= 60 THEN 'HIGH' WHEN impact >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM an""")),
    "news_radar": (news_radar, q(*AN, final=f"SELECT count(*) AS items, {R('avg(s)')} AS market_sentiment, count(*) FILTER (s >= 10) AS positive, count(*) FILTER (s <= -10) AS negative, count(*) FILTER (abs(s) < 10) AS neutral, count(*) FILTER (impact >= 55) AS major FROM an")),
    "news_sector_impact": (news_sector_impact, q(*AN, "u AS (SELECT unnest(sectors) AS sector, s FROM an)", final="SELECT sector, count(*) FILTER (s >= 10) AS positive, count(*) FILTER (s <= -10) AS negative, count(*) FILTER (abs(s) < 10) AS neutral, CAST(sum(s) AS BIGINT) AS score FROM u GROUP BY 1")),
    "news_weighted": (news_weighted, q(*AN, f"u AS (SELECT unnest(symbols) AS symbol, s, exp(-greatest(0, (epoch(TIMESTAMP '{NOW}') - floor(epoch(published_at))) / 3600) / 96) * (0.5 + impact / 100) AS w FROM an)", final=f"SELECT symbol, {R('sum(s * w) / sum(w)')} AS news_score, count(*) AS items FROM u GROUP BY 1")),
    "news_decisions": (news_decisions, q(*DEC, final=f"""SELECT id, horizon, {R('comp')} AS composite, {R('round_even(b / greatest(1, b + h + a) * 100, 0)')} AS buy, {R('round_even(h / greatest(1, b + h + a) * 100, 0)')} AS hold, {R('round_even(a / greatest(1, b + h + a) * 100, 0)')} AS avoid,
  CASE WHEN comp >= 25 AND tech >= 75 THEN 'POSITIVE_DO_NOT_CHASE' WHEN comp >= 25 THEN 'BULLISH' WHEN comp <= -25 THEN 'BEARISH' ELSE 'WATCH' END AS view, CASE WHEN samples >= 100 AND abs(comp) >= 40 THEN 'A' WHEN samples >= 30 THEN 'B' WHEN samples >= 10 THEN 'C' ELSE 'D' END AS grade,
  {R('33.3 + e')} AS up, {R('33.3 - e')} AS down FROM d3""")),
    "news_feed": (news_feed, q(*AN, final=f"SELECT id, {R('impact')} AS impact, published_at FROM an WHERE label = 'bullish' AND floor(epoch(published_at)) >= epoch(TIMESTAMP '{NOW}') - 480 * 3600 ORDER BY an.impact DESC, published_at DESC, id LIMIT 40 OFFSET 40")),
    "news_watch": (news_watch, q(*AN, "u AS (SELECT id, s, unnest(symbols) AS symbol FROM an)", final="SELECT id, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS matched, max(s) AS sentiment FROM u WHERE symbol IN ('view', 'signup', 'AAA') GROUP BY 1")),
    "news_headline_signal": (news_headline_signal, q(*NEWS, f"u AS (SELECT sym, epoch(TIMESTAMP '{NOW}') - floor(epoch(published_at)) AS a, " + " + ".join(f"CAST(contains(lower(title), '{w}') AS INT)" for w in ("that", "und", "is")) + "".join(f" - CAST(contains(lower(title), '{w}') AS INT)" for w in ("was", "de", "for")) + " AS p FROM nd)",
                                                     final=f"SELECT sym AS symbol, {R('sign(sum(p))')} AS signal, count(*) FILTER (a BETWEEN 0 AND 86400) AS day, count(*) FILTER (a BETWEEN 0 AND 604800) AS week FROM u GROUP BY 1")),
    "news_text": (news_text, f"SELECT doc_id, sha256({LET.format('text')}) AS fingerprint, length({LET.format('text')}) AS kept, trim(split_part(text, chr(10), 1), ' ') <> '' AND length(split_part(text, chr(10), 1)) - length(replace(split_part(text, chr(10), 1), chr(65533), '')) <= greatest(1, length(split_part(text, chr(10), 1)) // 30) AS readable, left(sha256(split_part(text, chr(10), 1) || '|' || source), 24) AS identity FROM documents"),
    "news_pages_plain": (news_pages_plain, """WITH p AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM pages)
  SELECT page_id, sha256(t) AS digest, length(t) AS chars FROM p"""),
    "news_freshness": (news_freshness, q(*NEWS, "u AS (SELECT greatest(0, (epoch(TIMESTAMP '2024-01-20') - floor(epoch(published_at))) / 60) AS m FROM nd)", final="SELECT CASE WHEN m <= 30 THEN 'Breaking' WHEN m <= 360 THEN 'Recent' WHEN m <= 1440 THEN 'Aging' ELSE 'Old' END AS freshness, count(*) AS items FROM u GROUP BY 1")),
    "news_published": (news_published, q(*NEWS, final="SELECT id, CASE WHEN id % 4 <> 3 THEN date_trunc('second', published_at) END AS published_at FROM nd")),
    "news_similar": (news_similar, q(*AN, "k AS (SELECT id, event_type, label, sectors, id % 3 = 0 AS mr, id % 2 AS vr, round(impact, 1) AS impact FROM an)",
                                     """j AS (SELECT a.id AS query_id, b.id, round(0.35 * CAST(a.event_type = b.event_type AS INT) + 0.15 * CAST(a.label = b.label AS INT) + 0.15 * greatest(0, 1 - abs(a.impact - b.impact) / 100) + 0.15 * CASE WHEN len(list_distinct(list_concat(a.sectors, b.sectors))) > 0 THEN len(list_intersect(a.sectors, b.sectors)) / len(list_distinct(list_concat(a.sectors, b.sectors))) ELSE 0 END
  + 0.1 * CAST(a.mr = b.mr AS INT) + 0.1 * CAST(a.vr = b.vr AS INT), 6) AS sim FROM k a JOIN k b ON a.id <> b.id)""",
                                     "m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM j)", final=f"SELECT query_id, id, {R('sim')} AS similarity, rank FROM m WHERE rank <= 5")),
    "event_study": (event_study, q(*OUT, final=f"SELECT id, symbol, h, entry_ts, {R('entry')} AS entry, {R('ret')} AS ret, {R('win')} AS \"window\", {R('abn')} AS abnormal, {R('abw')} AS abnormal_window FROM oc")),
    "event_study_metrics": (event_study_metrics, q(*OUT, "g AS (SELECT h, count(*) AS n, count(dr) AS dn, avg(CASE WHEN dr > 0 THEN 1.0 WHEN dr IS NOT NULL THEN 0 END) AS wr, avg(ret) AS m, median(ret) AS md, stddev_samp(ret) AS sd, max(ret) AS mx, min(ret) AS mn, avg(win) AS wm, avg(dr) FILTER (dr > 0) / abs(avg(dr) FILTER (dr < 0)) AS pl, avg(abn) AS car FROM oc GROUP BY 1)",
                                                   final=f"""SELECT h, n AS samples, dn AS directional, {R('wr')} AS win_rate, {R('m')} AS mean, {R('md')} AS median, {R('sd')} AS std, {R('mx')} AS max_return, {R('mn')} AS min_return, {R('wm')} AS window_mean, {R('pl')} AS profit_loss_ratio, {R('car')} AS car,
  {R('m - 1.96 * sd / sqrt(n)')} AS ci_low, {R('m + 1.96 * sd / sqrt(n)')} AS ci_high, CASE WHEN n < 30 THEN 'INSUFFICIENT_EVIDENCE' WHEN n < 100 THEN 'WEAK' ELSE 'MODERATE' END AS evidence FROM g""")),
    "event_outcome_shares": (event_outcome_shares, q(*OUT, final=f"SELECT event_type, 'T+' || h AS horizon, {R('avg(CASE WHEN ret > 0.002 THEN 100.0 ELSE 0 END)')} AS up, {R('avg(CASE WHEN abs(ret) <= 0.002 THEN 100.0 ELSE 0 END)')} AS sideways, {R('avg(CASE WHEN ret < -0.002 THEN 100.0 ELSE 0 END)')} AS down, count(*) AS samples FROM oc WHERE h IN (1, 5, 20) GROUP BY event_type, h")),
    "event_priced_in": (event_priced_in, q(*OUT[:3 + len(AN) - 1], "mx AS (SELECT symbol, max(n) AS m FROM br GROUP BY 1)", "p1 AS (SELECT an.id, an.sym AS symbol, br.n FROM an ASOF LEFT JOIN br ON an.sym = br.symbol AND an.published_at <= br.ts)",
                                           "p2 AS (SELECT id, symbol, coalesce(n, m + 1) AS k, m FROM p1 JOIN mx USING (symbol))",
                                           "p3 AS (SELECT p2.id, p2.symbol, max(close) FILTER (br.n = k - 1) / max(close) FILTER (br.n = greatest(0, k - 8)) - 1 AS pre, max(close) FILTER (br.n = least(m, k + 3)) / max(close) FILTER (br.n = k) - 1 AS post FROM p2 JOIN br USING (symbol) WHERE k - 1 - greatest(0, k - 8) >= 1 AND least(m, k + 3) - k >= 1 GROUP BY 1, 2)",
                                           "p4 AS (SELECT *, abs(pre) / (abs(pre) + abs(post) + 1e-9) AS sc FROM p3)",
                                           final=f"SELECT id, symbol, {R('pre')} AS pre_return, {R('post')} AS post_return, {R('sc')} AS score, CASE WHEN sc > 0.67 THEN 'MOSTLY_PRICED' WHEN sc > 0.34 THEN 'PARTLY_PRICED' ELSE 'NOT_YET_PRICED' END AS assessment FROM p4")),
    "headline_leaders": (headline_leaders, None),
    "headline_clusters": (headline_clusters, None),
    "news_dedupe": (news_dedupe, None),
    "news_collection": (news_collection, "WITH p AS (SELECT unnest(list_concat(list_transform(range(20), lambda i: 'src' || i), ['src99'])) AS provider) SELECT p.provider, count(doc_id) AS \"count\", CASE WHEN count(doc_id) > 0 THEN 'HEALTHY' ELSE 'EMPTY' END AS status FROM p LEFT JOIN documents ON source = p.provider GROUP BY 1"),
    "benchmarks": (benchmarks, "SELECT DISTINCT event_type AS symbol, CASE event_type WHEN 'signup' THEN 'CN' WHEN 'error' THEN 'US' ELSE 'CRYPTO' END AS market, CASE event_type WHEN 'signup' THEN '000300' WHEN 'error' THEN 'SPY' ELSE 'BTC' END AS benchmark FROM events"),
}
