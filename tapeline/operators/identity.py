"""Symbol normalisation, identity attributes and registry search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.session import table_cut as cut


def stock_symbol(raw: Column) -> Column:
    value = F.replace(F.replace(F.trim(F.upper(raw)), F.lit("NASDAQ:")), F.lit("NYSE:"))
    value = F.when((F.length(value) == 8) & value.rlike("^(SH|SZ)"), F.substring(value, 3, 6)).otherwise(value)
    return F.regexp_replace(value, r"\.(SH|SS|SZ)$", "")


def crypto_symbol(raw: Column) -> Column:
    value = F.upper(raw)
    for piece in ("/USDT", "-USDT", "USDT"):
        value = F.replace(value, F.lit(piece))
    return F.trim(value)


def canonical(raw: Column, asset_type: Column) -> Column:
    text, code = F.trim(F.upper(raw)), stock_symbol(raw)
    six = code.rlike("^[0-9]{6}$")
    suffix = (F.when(text.rlike(r"\.(SH|SS)$") | text.startswith("SH"), ".SH").when(text.endswith(".SZ") | text.startswith("SZ"), ".SZ")
              .when(code.rlike("^[569]"), ".SH").otherwise(".SZ"))
    return F.when(asset_type == "crypto", crypto_symbol(raw)).when(six, F.concat(code, suffix)).otherwise(code)


def identity(df: DataFrame) -> DataFrame:
    """Attributes that follow from a symbol alone; needs raw and asset_type."""
    c = F.col
    df = df.withColumn("canonical_symbol", canonical(c("raw"), c("asset_type")))
    code = stock_symbol(c("canonical_symbol"))
    crypto, cn = c("asset_type") == "crypto", code.rlike("^[0-9]+$")
    sh = c("canonical_symbol").endswith(".SH")
    pick = lambda a, b, d: F.when(crypto, a).when(cn, b).otherwise(d)
    base = c("canonical_symbol")
    return df.withColumns({
        "market": pick(F.lit("CRYPTO"), F.lit("CN"), F.lit("US")),
        "exchange": pick(F.lit("OKX"), F.when(sh, "SSE").otherwise("SZSE"), F.lit("US")),
        "currency": pick(F.lit("USDT"), F.lit("CNY"), F.lit("USD")),
        "timezone": pick(F.lit("UTC"), F.lit("Asia/Shanghai"), F.lit("America/New_York")),
        "provider_symbol": pick(F.concat(base, F.lit("-USDT")), code, code),
        "aliases": pick(F.concat_ws("|", F.concat(base, F.lit("USDT")), F.concat(base, F.lit("/USDT")), F.concat(base, F.lit("-USDT"))),
                        F.concat_ws("|", code, F.concat(code, F.when(sh, ".SS").otherwise(".SZ"))),
                        F.concat_ws("|", code, F.concat(F.lit("NASDAQ:"), code), F.concat(F.lit("NYSE:"), code)))})


def security_id(raw: Column) -> Column:
    """Exchange-qualified id: 1. for Shanghai, 0. for Shenzhen; an explicit suffix beats the prefix rule."""
    text, code = F.trim(F.upper(raw)), stock_symbol(raw)
    shanghai = F.when(text.rlike(r"\.(SH|SS)$") | text.startswith("SH"), True).when(text.endswith(".SZ") | text.startswith("SZ"), False).otherwise(code.rlike("^[569]"))
    return F.concat(F.when(shanghai, "1.").otherwise("0."), code)


def paper_currency(symbol: Column) -> Column:
    value = F.upper(symbol)
    return F.when(value.rlike(r"^[0-9]{6}(\.(SH|SZ))?$"), "CNY").when(value.rlike(r"USDT$") | value.isin("BTC", "ETH", "SOL", "BNB"), "USDT").otherwise("USD")


def backfill_market(symbol: Column, asset_type: Column) -> Column:
    return F.when(asset_type == "crypto", "CRYPTO").when(symbol.rlike(r"^[0-9]{6}"), "CN").otherwise("US")


def _grams(text: Column, longest: int, sizes: Iterable[int] | None = None) -> Column:
    """Distinct substrings of up to ``longest`` characters, the empty one too: it is contained in everything.

    ``sizes`` names the lengths that are asked for, all if it is not given.
    """
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    chosen = range(longest + 1) if sizes is None else sorted(sizes)
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[of(n) if n else F.array(F.lit("")) for n in chosen]))


#: Fields that are searched: what of a query they must contain, and the longest substrings in their index.  Codes are
#: short and unlike, and many queries begin alike, so these are indexed by longer ones.
FIELDS = {"_s": ("_c", 8), "_n": ("_q", 3), "_a": ("_q", 3), "_b": ("_c", 8)}


def search(queries: DataFrame, registry: DataFrame, top: int = 20) -> DataFrame:
    """Substring search of many queries at once over symbol, name, aliases and base asset.

    A substring index instead of a cross join, field by field over its distinct values: each is keyed by its short
    substrings, each query by as many of its first characters, and only what shares that key is compared in full.
    Rows meet the values found, so a name or alias that many rows carry is searched once.
    """
    c = F.col
    compact = F.regexp_replace(F.regexp_replace(F.upper(F.trim("query")), r"[/-]USDT", ""), "USDT$", "")
    asked = cut(queries.select("query").distinct().withColumns({"_q": F.lower(F.trim("query")), "_c": F.lower(compact)}))
    sizes = asked.agg(*[F.collect_set(F.least(F.length(own), F.lit(longest))).alias(field) for field, (own, longest) in FIELDS.items()]).first()
    fields = {"_s": F.lower("symbol"), "_n": F.lower("name"), "_a": F.lower(F.coalesce("aliases", F.lit(""))), "_b": F.lower(F.coalesce("base_asset", F.lit("")))}
    rows = registry.select("symbol", "name", "asset_type", *[value.alias(f) for f, value in fields.items()])
    order = (F.when(c("_s") == c("_c"), 0).when(c("_b") == c("_c"), 1).when(c("_n") == c("_q"), 2).when(c("_s").startswith(c("_c")), 3).otherwise(4))
    hit = None
    for field, (own, longest) in FIELDS.items():
        index = rows.filter(c(field).isNotNull()).select(field).distinct().select(field, F.explode(_grams(c(field), longest, sizes[field])).alias("_key"))
        found = index.hint("merge").join(asked.withColumn("_key", F.substring(own, 1, longest)), "_key").filter(c(field).contains(c(own))).drop("_key")
        part = rows.hint("merge").join(found, field).select("query", "symbol", "name", "asset_type", order.alias("match"))
        hit = part if hit is None else hit.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("match", F.length("symbol"), "symbol"))
    return hit.distinct().withColumn("rank", rank).filter(c("rank") <= top)


def alias_search(queries: DataFrame, registry: DataFrame, top: int = 20) -> DataFrame:
    """Search stocks and coins separately, then one row per canonical symbol and market."""
    found = None
    for kind in ("stock", "crypto"):
        part = search(queries, registry.filter(F.col("asset_type") == kind), top)
        found = part if found is None else found.unionByName(part)
    return identity(found.withColumnRenamed("symbol", "raw")).dropDuplicates(["query", "canonical_symbol", "market"]).select("query", "canonical_symbol", "market", "exchange")


def members(registry: DataFrame, market: str, top: int) -> DataFrame:
    live = F.when(F.col("status").isin("TRADING", "live"), 0).otherwise(1)
    return registry.filter(F.col("market") == market).orderBy(live, "symbol").limit(top)


def registry_status(registry: DataFrame) -> DataFrame:
    return registry.groupBy("source").agg(F.count_distinct(F.struct("symbol", "asset_type")).alias("symbols"), F.max("updated_at").alias("updated_at"))
