"""Line dedup across documents: equal lines, and lines one edit apart, keep their earliest occurrence.

Deletion neighbourhood in two grains. First blocks: lines that agree outside one block meet on a hashed key, and the
block is cut further until it holds at most BLOCK characters; only lines that still have a partner go on. Then
characters: the survivors emit every variant with one character of that block removed as a hashed key, equal variants
join, and the edit distance is verified on the texts. A key's members are joined with its earliest line only, so the
work is linear in the variants. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import table_cut, with_size

#: Characters that the longer of two near lines has at least: one edit makes another word of a short line ("Of.", "On.").
NEAR_CHARS, BLOCK = 20, 64
#: What is cut off both ends of a line before it is compared.
BLANK = " \t\x0b\x0c\r"


def hashed(*columns: Column, salt: int = 0) -> Column:
    return F.xxhash64(F.lit(salt), *columns)


def identity(key: Column, text: Column) -> tuple[Column, Column]:
    """A document is its key and its text; rows that repeat both are one document."""
    return key.alias("doc"), F.xxhash64(text).alias("body")


def lines_of(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """Lines that take part: place (document, line number), trimmed line, and its 128-bit name (a, b)."""
    doc, body = identity(F.col(f"`{key}`"), F.col(f"`{text}`"))
    out = docs.select(doc, body, F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("at", "line"))
    out = out.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.length("line") >= min_chars)
    place = F.struct(F.col("doc").isNull().alias("no_key"), "doc", "body", "at").alias("place")
    return out.select(place, "line", hashed("line").alias("a"), hashed("line", salt=1).alias("b"))


def forms(line: Column) -> Column:
    """A line of n characters may meet lines of n (itself whole, form 0), and of n - 1 (itself the longer, form 1)."""
    return F.array(*[F.struct(F.lit(f).alias("form"), (F.length(line) - f).alias("n")) for f in (0, 1)])


def block_key(line: Column, n: Column, s: Column, e: Column) -> Column:
    """Name of all that lies outside the block [s, e) of n characters."""
    return F.xxhash64(n, s, e, F.left(line, s), F.lit("|"), F.right(line, n - e))


def halves(n: Column, s: Column, e: Column, parts: int) -> Column:
    """[s, e) cut into ``parts`` blocks that hold all its positions."""
    width = F.greatest(F.lit(1), F.ceil((e - s) / parts).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(F.least(e, s + width * k).alias("s"), F.least(e, s + width * (k + 1)).alias("e")))


def keyed(lines: DataFrame, parts: int) -> DataFrame:
    """Rows (a, b, line, form, n, s, e) cut into blocks with their keys."""
    cut = lines.withColumn("cut", F.explode(halves(F.col("n"), F.col("s"), F.col("e"), parts))).where("cut.s < cut.e")
    return cut.select("a", "b", "line", "form", "n", F.col("cut.s").alias("s"), F.col("cut.e").alias("e")).withColumn("key", block_key(F.col("line"), F.col("n"), F.col("s"), F.col("e")))


def met(keys: DataFrame) -> DataFrame:
    """Keys of two different lines at least, one of them whole."""
    return table_cut(keys.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y"), F.min("form").alias("f")).where("x <> y AND f = 0").select("key"))


def near_lines(lines: DataFrame, firsts: DataFrame, near_chars: int) -> DataFrame:
    """(a, b) of the lines that have an earlier line one edit away, the longer one of ``near_chars`` at least."""
    lines = lines.where(F.length("line") >= near_chars - 1)
    started = lines.select("a", "b", "line", F.explode(forms(F.col("line"))).alias("f")).select("a", "b", "line", "f.form", "f.n", F.lit(0).alias("s"), F.col("f.n").alias("e"))
    keys = keyed(started, 2)
    live = keys.join(with_size(met(keys.select("key", "a", "form")), 8), "key", "left_semi")
    live = table_cut(live.groupBy("a", "b", "form", "n", "s", "e").agg(F.first("line").alias("line")))
    done = [live.where(F.col("e") - F.col("s") <= BLOCK)]
    while not (live := live.where(F.col("e") - F.col("s") > BLOCK)).isEmpty():
        keys = keyed(live, 4)
        live = table_cut(keys.join(with_size(met(keys.select("key", "a", "form")), 8), "key", "left_semi").drop("key"))
        done.append(live.where(F.col("e") - F.col("s") <= BLOCK))
    ready = reduce(DataFrame.union, [d.select("a", "b", "line", "form", "n", "s", "e") for d in done])
    without = lambda i: F.concat(F.left("line", i), F.substr(F.col("line"), i + 2))
    # kind 0: a character changed at i; kind 1: the whole line; kind 2: the longer line without a character.
    changed = F.transform(F.sequence("s", F.col("e") - 1), lambda i: F.struct(F.lit(0).alias("kind"), hashed(F.lit("s"), i, without(i)).alias("k1"), hashed(F.lit("s"), i, without(i), salt=1).alias("k2")))
    shorter = F.transform(F.sequence("s", "e"), lambda i: F.struct(F.lit(2).alias("kind"), hashed(F.lit("d"), without(i)).alias("k1"), hashed(F.lit("d"), without(i), salt=1).alias("k2")))
    whole = F.array(F.struct(F.lit(1).alias("kind"), hashed(F.lit("d"), F.col("line")).alias("k1"), hashed(F.lit("d"), F.col("line"), salt=1).alias("k2")))
    variants = ready.select("a", "b", F.explode(F.when(F.col("form") == 0, F.concat(whole, changed)).otherwise(shorter)).alias("v")).select("a", "b", "v.*").distinct()
    texts = table_cut(ready.groupBy("a", "b").agg(F.first("line").alias("line")).join(firsts, ["a", "b"]).select("a", "b", "line", "first"))
    variants = table_cut(variants.join(texts.select("a", "b", "first"), ["a", "b"]))
    who = F.struct("first", "a", "b")
    heads = variants.groupBy("k1", "k2").agg(F.min(F.when(F.col("kind") < 2, who)).alias("whole"), F.min(F.when(F.col("kind") == 2, who)).alias("longer"), F.count("*").alias("members")).where("members > 1")
    other = F.when(F.col("kind") == 1, F.col("longer")).otherwise(F.col("whole"))
    pairs = variants.join(heads, ["k1", "k2"]).withColumn("other", other).where(F.col("other.first") < F.col("first")).select("a", "b", F.col("other.a").alias("oa"), F.col("other.b").alias("ob")).distinct()
    both = pairs.join(texts.select("a", "b", "line"), ["a", "b"]).join(texts.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("line").alias("earlier")), ["oa", "ob"])
    return both.where((F.greatest(F.length("line"), F.length("earlier")) >= near_chars) & (F.levenshtein("line", "earlier", 1) >= 0)).select("a", "b").distinct()


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int | None = None, max_edits: int = 1) -> DataFrame:
    """Per document with such lines: doc, body (see :func:`identity`) and ``drops``, the numbers of the lines that go."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = lines_of(docs, key, text, 1 if min_chars is None else min_chars)
    firsts = table_cut(lines.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("copies")))
    decided = firsts.where("copies > 1").select("a", "b", "first", F.lit(False).alias("near"))
    if max_edits:
        near = table_cut(near_lines(lines, firsts.select("a", "b", "first"), NEAR_CHARS if min_chars is None else min_chars))
        decided = decided.join(near, ["a", "b"], "left_anti").union(near.join(firsts, ["a", "b"]).select("a", "b", "first", F.lit(True)))
    decided = with_size(table_cut(decided), 64)
    gone = lines.drop("line").join(decided, ["a", "b"]).where(F.col("near") | (F.col("place") > F.col("first")))
    once = gone.select("place.doc", "place.body", "place.at").distinct()  # rows that repeat key and text have the same numbers
    return once.groupBy("doc", "body").agg(F.collect_list("at").alias("drops"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int | None = None, max_edits: int = 1, into: str = "dropped_lines") -> DataFrame:
    """``docs`` without repeated lines in ``text``, and ``into``: the sorted numbers (from 0) of the lines that went.

    A line (split at newlines, blanks at its ends ignored) goes if an earlier line equals it, or lies within
    ``max_edits`` (0 or 1) edits and the longer of the two has NEAR_CHARS characters; earlier means a smaller key (NULL
    last), then text hash, then line number. Blank lines stay. With ``min_chars``, shorter lines stay and are not
    compared, and all others are near at any length. Rows that repeat key and text are one document and get the same result.
    NULL texts stay NULL, empty ones empty; a document may end up empty; an empty table stays empty. Other columns
    pass through, except that a column named ``into`` is replaced.
    """
    drops = with_size(table_cut(dropped_lines(docs, key, text, min_chars, max_edits)), 80 + 5 * F.size("drops"))
    doc, body = identity(F.col(f"`{key}`"), F.col(f"`{text}`"))
    keep = [c for c in docs.columns if c != into]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), doc, body)
    joined = packed.join(drops.select(F.col("doc").alias("doc_"), F.col("body").alias("body_"), "drops"), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("body") == F.col("body_")), "left")
    pieces = F.split(F.col(f"row.`{text}`"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("drops"))
    lines = joined.withColumn("pieces", F.when(F.col("drops").isNotNull(), pieces)).withColumn("left", F.when(F.col("drops").isNotNull(), left))
    fresh = F.when(F.col("drops").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(F.transform("left", lambda i: F.get("pieces", i)), "\n"))
    return lines.select(*[(fresh if c == text else F.col(f"row.`{c}`")).alias(c) for c in keep], F.coalesce(F.array_sort("drops"), F.array().cast("array<int>")).alias(into))
