"""Tool calls of conversations: linked to their results, ordered, checked against schemas, written as canonical JSON.

Built-in functions only. Calls and results meet in a hash join on (conversation, identifier). The order starts from
the turn; conversations in which a call refers to a later or equal turn are placed by pointer doubling, which also finds
the cycles. A conversation is never gathered: each call is a line of its own with its sort key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import table_cut

#: What a schema type is called among the types of JSON values.
KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with the arguments (a parsed JSON value) of a call; NULL value: not JSON."""
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("-"))))
    written = F.to_json(arguments)
    for tool, fields in sorted(schemas.items()):
        checks = []
        for key, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(arguments, f"$.{key}", "variant")
            found = F.schema_of_variant(value)
            if required:
                checks.append(F.when(value.isNull(), f"missing {key}"))
            checks.append(F.when(value.isNotNull() & ~found.rlike(KINDS[kind]), f"{key} is not {kind}"))
        more = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(written), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in sorted(fields)]))), lambda k: F.concat(F.lit("unknown field "), k))
        own = F.concat(F.array_compact(F.array(*checks)), more)
        out = F.when(name == tool, own).otherwise(out)
    shape = F.when(arguments.isNull(), "arguments are not JSON").when(~F.schema_of_variant(arguments).startswith("OBJECT"), "arguments are not an object")
    return F.when(shape.isNotNull(), F.array(shape)).otherwise(out)


def followed(calls: DataFrame, most: int) -> DataFrame:
    """(conv, id, dep, place, ok) of calls (conv, id, turn, dep), each of which follows one reference or none.

    A place is the turn, or one more than the place of what is followed, where that is larger: the largest turn plus
    distance on the way. The part of the way that is looked at doubles in each round. A way of ``most`` steps, the
    number of calls of the largest conversation, is in a cycle or leads into one: then ``ok`` is false.
    """
    state, step = calls.select("conv", "id", "dep", F.col("turn").alias("place"), F.col("dep").alias("jump")), 1
    while step <= most and not state.where("jump IS NOT NULL").isEmpty():
        target = state.select("conv", F.col("id").alias("jump"), (F.col("place") + step).alias("there"), F.col("jump").alias("next"))
        state = table_cut(state.join(target, ["conv", "jump"], "left").select("conv", "id", "dep", F.greatest("place", "there").alias("place"), F.col("next").alias("jump")))
        step *= 2
    return state.select("conv", "id", "dep", "place", F.col("jump").isNull().alias("ok"))


def ordered(calls: DataFrame, refers: DataFrame) -> DataFrame:
    """(conv, id, place, ordered): turn, or one more than the largest place a call refers to, where that is larger.

    Calls in a cycle or behind one have their turn, and ``ordered`` is false. Each call follows one of its references;
    as long as another one is not behind it, it follows that, which makes its place larger or finds it behind a cycle.
    """
    turns = calls.select("conv", "id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"))
    edges = table_cut(refers.where("dep IS NOT NULL").distinct().join(turns.select("conv", F.col("id").alias("dep"), F.col("turn").alias("behind")), ["conv", "dep"]).join(turns, ["conv", "id"]))
    hot = table_cut(edges.where("behind >= turn").select("conv").distinct())
    if hot.isEmpty():
        return turns.select("conv", "id", F.col("turn").alias("place"), F.lit(True).alias("ordered"))
    edges = edges.join(hot, "conv", "left_semi").select("conv", "id", "dep", "behind")
    most = turns.join(hot, "conv", "left_semi").groupBy("conv").count().agg(F.max("count")).first()[0]
    chosen = edges.groupBy("conv", "id").agg(F.max(F.struct("behind", "dep")).alias("c")).select("conv", "id", F.col("c.dep").alias("dep"))
    inside = table_cut(turns.join(hot, "conv", "left_semi"))
    follows = table_cut(inside.join(chosen, ["conv", "id"], "left"))
    while True:
        places = followed(follows, most)
        target = places.select("conv", F.col("id").alias("dep"), F.col("place").alias("behind"), F.col("ok").alias("clear"))
        pairs = edges.select("conv", "id", "dep").join(target, ["conv", "dep"]).join(places.where("ok").select("conv", "id", "place"), ["conv", "id"])
        broken = table_cut(pairs.where("NOT clear OR behind >= place").groupBy("conv", "id").agg(F.max(F.struct(~F.col("clear"), "behind", "dep")).alias("c")).select("conv", "id", F.col("c.dep").alias("other")))
        if broken.isEmpty():
            break
        follows = table_cut(follows.join(broken, ["conv", "id"], "left").select("conv", "id", "turn", F.coalesce("other", "dep").alias("dep")))
    moved = places.select("conv", "id", F.when(F.col("ok"), F.col("place")).alias("moved"), "ok")
    return turns.join(moved, ["conv", "id"], "left").select("conv", "id", F.coalesce("moved", "turn").alias("place"), F.coalesce("ok", F.lit(True)).alias("ordered"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], rounds: int | None = None) -> DataFrame:
    """One row per call: conv, id, place, turn, name, ordered, answered, problems, line.

    ``calls``: conv, turn, id, name, arguments (JSON text), refers (identifiers of other calls). ``results``: conv,
    turn, id, content. Repeated calls or results of one (conv, id) count once, the earliest (least turn, then least
    values); calls without conv or id stay each by itself, without a result. References to unknown calls are ignored.
    ``line`` is canonical JSON: sorted keys, no blanks, NULLs left out; arguments that are not JSON stay as text.
    Sorting by (conv, place, id) gives each call behind the calls it refers to, unless ``ordered`` is false: then it is
    in a cycle or behind one, and its place is its turn. ``rounds`` has no effect: no depth is too large. Empty tables give an empty one; other columns are ignored.
    """
    told = calls.select("conv", "turn", "id", "name", "arguments", "refers")
    named = F.col("conv").isNotNull() & F.col("id").isNotNull()
    fields = ["turn", "name", "arguments", "refers"]
    first = table_cut(told.where(named).groupBy("conv", "id").agg(F.min(F.struct(*fields)).alias("c")).select("conv", "id", "c.*"))
    answers = results.where(named).groupBy("conv", "id").agg(F.min(F.struct("turn", "content")).alias("r")).select("conv", "id", F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    places = ordered(first, first.select("conv", "id", F.explode("refers").alias("dep")))
    joined = first.join(places, ["conv", "id"]).join(answers, ["conv", "id"], "left")
    alone = told.where(~named).select("*", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("place"), F.lit(True).alias("ordered"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("boolean").alias("answered"))
    every = joined.unionByName(alone).withColumn("value", F.try_parse_json("arguments")).withColumn("problems", problems(F.col("name"), F.col("value"), schemas))
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    pairs = [("arguments", F.coalesce(F.to_json("value"), text(F.col("arguments")))), ("id", text(F.col("id").cast("string"))), ("name", text(F.col("name"))), ("result", text(F.col("content")))]
    have = {"arguments": F.col("arguments").isNotNull(), "id": F.col("id").isNotNull(), "name": F.col("name").isNotNull(), "result": F.col("content").isNotNull()}
    line = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.when(have[k], F.concat(F.lit(f'"{k}":'), v)) for k, v in pairs])), ","), F.lit("}"))
    return every.select("conv", "id", "place", "turn", "name", "ordered", F.coalesce("answered", F.lit(False)).alias("answered"), "problems", line.alias("line"))


SCHEMAS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "lookup": {"key": ("string", True), "deep": ("boolean", False)}, "score": {"value": ("number", True)}}


def conversation_calls(messages: DataFrame) -> DataFrame:
    """A call per assistant turn, with its whole text among the arguments; it refers to the call before it, every fifth to the next.

    The call after such a fifth one refers to the call before both, so that no references form a cycle.
    """
    n = F.coalesce("turn", F.lit(0))
    name = F.get(F.array(*[F.lit(x) for x in ("search", "lookup", "score", "erase")]), (n % 4).cast("int"))
    search = F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit")))
    lookup = F.to_json(F.struct((F.length("text") % 2 == 0).alias("deep"), F.when(F.length("text") % 3 > 0, F.col("text")).alias("key"), F.when(F.length("text") % 3 == 0, F.col("text")).alias("keys")))
    other = F.to_json(F.struct(F.length("text").cast("string").alias("value"), F.col("text").alias("extra")))
    arguments = F.when(n % 4 == 0, search).when(n % 4 == 1, lookup).otherwise(other)
    ident = lambda k: F.concat_ws("-", F.lit("call"), k)
    refers = F.when(n % 5 == 0, F.array(ident(n + 2))).when(n % 5 == 2, F.array(ident(n - 4))).otherwise(F.array(ident(n - 2)))
    return messages.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), "turn", ident(n).alias("id"), name.alias("name"), arguments.alias("arguments"), refers.alias("refers"))


def conversation_results(messages: DataFrame) -> DataFrame:
    """The turn after a call answers it."""
    return messages.where("role = 'user' AND turn > 0").select(F.col("conv_id").alias("conv"), "turn", F.concat_ws("-", F.lit("call"), F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
