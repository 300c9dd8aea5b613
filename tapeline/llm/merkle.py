"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups, a proof for every row.

Rows are numbered within their group over range partitions, so a group may hold any share of the table. A level is a
slot pivot: conditional aggregates spread the children of a parent into FANOUT columns; concatenating the columns
hashes the parent, and the columns but a child's own are its siblings. BLOCK levels are climbed inside blocks of
FANOUT ** BLOCK consecutive rows, which one exchange deals by (group, block); block roots are the rows of the next
round. So a table of n rows takes log(n) / log(FANOUT ** BLOCK) rounds, each that much smaller than the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.ranks import numbered
from tapeline.llm.common import table_cut, with_size

#: Fixed value: consecutive nodes that make a parent.
FANOUT = 3
#: Levels climbed within one block of rows.
BLOCK = 6
#: Bytes of a path, by which the table of block paths is measured before it travels.
PATH_BYTES = 64 * 2 * 20


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for NULL, else byte count, colon and value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def climbed(nodes: DataFrame, group: str, fanout: int, levels: int) -> DataFrame:
    """Nodes (group, at, total, node) with ``path``, their siblings on each level of their block, and ``up``, its root.

    A level of a group that has one node left adds nothing to the path.
    """
    held = nodes.withColumn("_block", F.floor(F.col("at") / F.lit(fanout**levels)).cast("long"))
    steps = [f"_q{k}" for k in range(1, levels + 1)]
    for k, name in enumerate(steps, 1):
        held = held.withColumn(name, F.floor(F.col("at") / F.lit(fanout**k)).cast("long"))
    # The deepest level first: the windows of the levels above are prefixes of its order, so one sort serves all.
    held = held.repartition(group, "_block").withColumn("up", F.col("node"))
    path = []
    for k, name in enumerate(steps, 1):
        family = Window.partitionBy(group, "_block", *reversed(steps[k - 1 :]))
        below = F.col("at") if k == 1 else F.col(steps[k - 2])
        slot = F.pmod(below, F.lit(fanout)).cast("int")
        live = F.ceil(F.col("total") / F.lit(fanout ** (k - 1))) > 1
        held = held.withColumn("_slot", slot)
        children = [f"_c{i}" for i in range(fanout)]
        held = held.withColumns({c: F.max(F.when(F.col("_slot") == i, F.col("up"))).over(family) for i, c in enumerate(children)})
        side = lambda test, children=children: F.concat(*[F.when(test(i), F.coalesce(c, F.lit(""))).otherwise("") for i, c in enumerate(children)])
        own = F.struct(side(lambda i: F.col("_slot") > i).alias("left"), side(lambda i: F.col("_slot") < i).alias("right"))
        held = held.withColumn(f"_p{k}", F.when(live, own))
        path.append(f"_p{k}")
        held = held.withColumn("up", F.when(live, digest(*[F.coalesce(c, F.lit("")) for c in children])).otherwise(F.col("up")))
    kept = [F.col(f"`{c}`") for c in nodes.columns]
    return held.select(*kept, "_block", "up", F.filter(F.array(*path), lambda p: p.isNotNull()).alias("path"))


def rooted(nodes: DataFrame, group: str, fanout: int = FANOUT, levels: int = BLOCK) -> DataFrame:
    """Nodes (group, at, total, node) with their whole ``path`` to the group's root, and that ``root``."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    rounds = [nodes]
    while most > fanout**levels:
        tops = climbed(rounds[-1], group, fanout, levels).where(F.pmod("at", F.lit(fanout**levels)) == 0)
        size = F.ceil(F.col("total") / F.lit(fanout**levels)).cast("long")
        rounds.append(table_cut(tops.select(group, F.col("_block").alias("at"), size.alias("total"), F.col("up").alias("node"))))
        most = -(-most // fanout**levels)
    out = climbed(rounds[-1], group, fanout, levels).withColumnRenamed("up", "root").drop("_block")
    for below in reversed(rounds[:-1]):
        above = with_size(table_cut(out.select(F.col(group).alias("_g"), F.col("at").alias("_a"), F.col("path").alias("_above"), "root")), PATH_BYTES)
        own = climbed(below, group, fanout, levels).drop("up")
        met = own.join(above, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_a")))
        out = met.withColumn("path", F.concat("path", "_above")).drop("_g", "_a", "_above", "_block")
    return out


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", node: str = "leaf", fanout: int = FANOUT, levels: int = BLOCK) -> DataFrame:
    """``leaves`` (with the digest ``node`` of each row) with ``subroot``, ``root`` and ``path``.

    Within ``group`` (NULL is a group) rows ascend by ``order`` (NULL first), then by digest; equal rows take places
    in any order, each its own. While a level has several nodes, every ``fanout`` consecutive ones become the digest
    of their concatenation; a shorter last run, even of one, too. Groups ascend by name, NULL first, and their roots
    make ``root`` likewise. ``path`` lists from the row up (left, right): the siblings before and after, concatenated,
    both '' where a node has none; a group of one row adds nothing. An empty table stays empty. Other columns pass
    through, except those named at, total, node, subroot, root, path or with an underscore in front.
    """
    own = {"at", "total", "node", "subroot", "root", "path", node}
    kept = [c for c in leaves.columns if c not in own and not c.startswith("_")]
    rows = leaves.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{node}`").alias("node"), F.col(f"`{group}`").alias("_group"), F.col(f"`{order}`").alias("_order"))
    rows = table_cut(rows)  # ranges are sampled, and the texts behind the digests are to be read once
    placed = numbered(rows, ["_group"], [F.col("_order").asc_nulls_first(), F.col("node")], "at", "total")
    below = rooted(table_cut(placed), "_group", fanout, levels)
    # Of each group its root, from any of its rows; they are the leaves of the tree above.
    first = table_cut(below.where("at = 0").select(F.col("_group").alias("_name"), F.col("root").alias("node")))
    tree = table_cut(numbered(first, [], [F.col("_name").asc_nulls_first()], "at", "total").withColumn("_group", F.lit(0)))
    above = rooted(tree, "_group", fanout, levels).select("_name", F.col("node").alias("subroot"), F.col("path").alias("_over"), F.col("root").alias("_root"))
    met = below.join(with_size(table_cut(above), PATH_BYTES), F.col("_group").eqNullSafe(F.col("_name")))
    return met.select(*[F.col(f"`{c}`") for c in kept], F.col("node").alias(node), "subroot", F.col("_root").alias("root"), F.concat("path", "_over").alias("path"))


def folded(node: Column, path: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(path, node, lambda acc, p: digest(p["left"], acc, p["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Rows of ``documents`` as (doc_id, source, leaf, tampered): the second digest is of the text without its newlines
    where the crc32 of the id is even, and NULL where nothing was changed."""
    values = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr("text", "\n") > 0)
    return docs.select("doc_id", "source", values(F.col("text")).alias("leaf"), F.when(hit, values(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """Every document's leaf, roots and proof, and what its tampered copy leads to; a NULL doc_id is not tampered with."""
    held = manifest(document_leaves(docs))
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = held.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE leaves AS (
    SELECT doc_id, source,
        CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
        || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
        || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head, text
    FROM documents),
bytes AS (SELECT * FROM (VALUES {crc}) t(b, v)),
hashed AS (
    SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) AS other
    FROM leaves),
crcs AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
    UNION ALL
    SELECT doc_id, s, i + 1, xor(c >> 8, v) FROM crcs JOIN bytes ON b = xor(c & 255, ord(s[i])) WHERE i <= length(s)),
even AS (SELECT doc_id FROM crcs WHERE i > length(s) AND xor(c, 4294967295) % 2 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
sub AS (SELECT 0 AS lv, source, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM placed
    UNION ALL
    SELECT any_value(lv) + 1, source, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value(n + 2) // 3 FROM sub WHERE n > 1 GROUP BY source, pos // 3),
subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, lv AS depth FROM sub WHERE n = 1),
top AS (SELECT 0 AS lv, pos, h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT any_value(lv) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value(n + 2) // 3 FROM top WHERE n > 1 GROUP BY pos // 3),
root AS (SELECT h FROM top WHERE n = 1),
families AS (SELECT 0 AS tree, lv, source, pos // 3 AS parent, list(h ORDER BY pos) AS hs FROM sub WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT 1, lv, NULL, pos // 3, list(h ORDER BY pos) FROM top WHERE n > 1 GROUP BY ALL),
walk AS (
    SELECT p.doc_id, p.source, p.leaf, p.pos AS leaf_at, 0 AS tree, CAST(0 AS BIGINT) AS lv, p.pos AS pos, s.pos AS top_at, s.h AS subroot, s.depth AS depth,
        CASE WHEN e.doc_id IS NULL THEN p.leaf ELSE p.other END AS f, '' AS proof
    FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN even e ON p.doc_id = e.doc_id
    UNION ALL
    SELECT w.doc_id, w.source, w.leaf, w.leaf_at, w.t2, w.l2 + 1, w.a2 // 3, w.top_at, w.subroot, w.depth,
        sha256(array_to_string(hs[: a2 % 3], '') || f || array_to_string(hs[a2 % 3 + 2 :], '')),
        proof || array_to_string(hs[: a2 % 3], '') || array_to_string(hs[a2 % 3 + 2 :], '')
    FROM (SELECT *, CASE WHEN tree = 0 AND lv = depth THEN 1 ELSE tree END AS t2, CASE WHEN tree = 0 AND lv = depth THEN 0 ELSE lv END AS l2,
            CASE WHEN tree = 0 AND lv = depth THEN top_at ELSE pos END AS a2 FROM walk) w
    JOIN families m ON m.tree = w.t2 AND m.lv = w.l2 AND m.parent = w.a2 // 3 AND (w.t2 = 1 OR m.source IS NOT DISTINCT FROM w.source)),
ends AS (SELECT *, row_number() OVER (PARTITION BY source, leaf_at ORDER BY tree DESC, lv DESC) AS r FROM walk)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM ends, root WHERE r = 1
"""


def _crc_rows() -> str:
    """The 256 steps of crc32 (reflected polynomial 0xEDB88320), as SQL rows."""
    def step(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c
    return ", ".join(f"({b}, {step(b)})" for b in range(256))


SQL = SQL.replace("{crc}", _crc_rows())
