"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All of it is a projection over whole texts: built-in functions only, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern of each kind. Possessive repeats and the run guards keep the matches of the plain patterns
#: (email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`` and so on) but need one pass and no deep stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<!\+[0-9]{1,3}\x20?)\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])",
}
#: Cheap necessary conditions, so that texts without them are not scanned further.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-", "local_phone": r"\([0-9]{3}\)"}
#: Words before a span that speak for a kind, and words that speak against any kind.
FOR = {
    "email": "mail|e-mail|contact|write to|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": "card|visa|mastercard|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security",
    "local_phone": "phone|call|tel|mobile|fax|telefon|teléfono|téléphone",
}
AGAINST = "version|release|isbn|order no|invoice|serial|sample|dummy|placeholder"
#: Score of a validated span before its context; kinds with a checksum start higher.
PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.5}
BASE_KINDS = ("email", "ip", "card", "phone")
STEP, KEEP, CONTEXT, BLOCK = 0.2, 0.6, 48, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; an expression used inside a lambda would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """Sums before each position of an array, in two levels, so that a text with very many hits stays near linear."""
    block = lambda i: F.floor(i / BLOCK).cast("int")
    sums = lambda n: F.transform(F.sequence(F.lit(0), block(F.size(n) - 1)), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
    starts = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
    before = lambda n: let(sums(n), lambda s: let(starts(s), lambda t: F.transform(n, lambda _, i: F.get(t, block(i)) + total(F.slice(n, block(i) * BLOCK + 1, i % BLOCK)))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(lengths, before))


def mod97(value: Column) -> Column:
    """ISO 7064 remainder of an account number: first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(hit) == 1
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Add ``into``: array of (kind, start, end, score, value) over the whole text, by kind, then start.

    Positions are code points, ``end`` exclusive. Spans of BASE_KINDS that pass their validator always stay;
    the other kinds need a score of KEEP. A score is PRIOR, plus STEP after a word that speaks for the kind,
    minus STEP after one that speaks against it, within CONTEXT code points before the span.

    A NULL or empty text gives an empty array; an empty table an empty one. Repeated rows are scored each by
    itself; other columns pass through, except that a column named ``into`` is replaced.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != into]
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.concat(*[F.coalesce(spans(kind, content), F.array().cast(SPANS)) for kind in PATTERNS])
    return docs.select(*keep, found.alias(into))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>"


def spans(kind: str, content: Column) -> Column:
    """The spans of one kind; NULL for a text that lacks what the kind needs."""
    pattern = F.lit(rf"\G(?s)(.*?)({PATTERNS[kind]})")

    def located(gaps: Column, hits: Column, before: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            near = F.lower(F.right(gap, F.lit(CONTEXT)))
            start = F.get(before, i) + F.length(gap)
            score = PRIOR[kind] + F.when(near.rlike(FOR[kind]), STEP).otherwise(0.0) - F.when(near.rlike(AGAINST), STEP).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), F.round(score, 3).alias("score"), hit.alias("value"))

        return F.transform(hits, span)

    def cut(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        lengths = F.transform(gaps, lambda g, i: (F.length(g) + F.length(F.get(hits, i))).cast("long"))
        return let(running(lengths), lambda before: located(gaps, hits, before))

    found = F.struct(F.regexp_extract_all(content, pattern, 1).alias("gaps"), F.regexp_extract_all(content, pattern, 2).alias("hits"))
    made = F.filter(let(found, cut), lambda s: valid(kind, s["value"]))
    return F.when(content.rlike(NEEDS[kind]), (made if kind in BASE_KINDS else F.filter(made, lambda s: s["score"] >= KEEP)).cast(SPANS))


def redact(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``text`` with each span of ``into`` (see :func:`find_pii`) replaced by its kind in brackets.

    Cut by position; of spans that overlap the earliest (the longest of those) names the place, and all of them go.
    """
    content = F.col(f"`{text}`")
    order = F.array_sort(F.transform(into, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("upto"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("made"))

    def taken(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substr(content, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], -s["upto"]).alias("at"), F.when(fresh, F.concat(acc["made"], piece)).otherwise(acc["made"]).alias("made"))

    done = F.aggregate(order, begin, taken, lambda acc: F.concat(acc["made"], F.substr(content, (acc["at"] + 1).cast("int"))))
    return docs.withColumn(text, F.when(F.size(into) > 0, done).otherwise(content))


def digest(found: DataFrame, into: str = "pii") -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(F.col(into), lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(F.col(into), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col(into)).alias("spans"))
