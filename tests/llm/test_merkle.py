import hashlib
import random
import zlib

import pytest

from tapeline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout=3):
    """Root, and per node its siblings as (left, right) from the bottom up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, own = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for k in range(len(run)):
                for leaf in owners[i + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            own.append([x for o in owners[i : i + fanout] for x in o])
        nodes, owners = up, own
    return nodes[0], paths


def brute(rows):
    leaf = lambda r, text: h(*[field(v) for v in (*r[:4], text)])
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        made[name] = (own, *tree([leaf(r, r[4]) for r in own]))
    root, over = tree([made[n][1] for n in names])
    out = []
    for name, above in zip(names, over):
        own, subroot, paths = made[name]
        for r, path in zip(own, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            f = leaf(r, r[4].replace("\n", "") if changed else r[4])
            for left, right in path + above:
                f = h(left, f, right)
            out.append((r[0], leaf(r, r[4]), subroot, root, h(*[x for p in path + above for x in p]), f, f == root))
    return sorted(out, key=str)


def rows(n=170):
    r = random.Random(5)
    some = [(i, r.choice(["hot", "hot", "hot", "b", "é", None]), r.choice(["en", None]), r.choice([3, None]), r.choice(["a\nb", "no break", "", None, "\n", "ü\n" * 30])) for i in range(n)]
    lone = [(1000, "lone", "en", 1, "x\ny"), (None, "hot", "en", 1, "z\n"), (None, None, None, None, None), (7, "\U0001f600", "en", 2, "w\n"), (9, "￮", "en", 2, "w")]
    return some + lone + [some[3]] * 4 + [(some[5][0], some[5][1], "fr", 1, "same id")]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_equals_brute_force(spark, levels):
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS root", "2 AS at", "3 AS _block").repartition(5)
    held = merkle.manifest(merkle.document_leaves(docs), levels=levels)
    got = held.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(held.path), merkle.folded(merkle.F.coalesce("tampered", "leaf"), held.path).alias("f")).selectExpr("*", "f = root").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())


def test_query_rows_and_edges(spark):
    docs = spark.createDataFrame(rows(60), SCHEMA)
    got = merkle.document_proofs(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows(60)) and not all(r.verified for r in got)
    assert merkle.document_proofs(docs.limit(0)).collect() == []
    one = [(4, "s", "en", 1, "a")]
    (got,) = merkle.document_proofs(spark.createDataFrame(one, SCHEMA)).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == h("") and got.verified


def test_columns_pass_and_paths_prove(spark):
    leaves = spark.createDataFrame([(i, "g", h(str(i)), i * 2) for i in range(11)], "k long, g string, d string, extra long")
    for r in merkle.manifest(leaves, group="g", order="k", node="d", fanout=2).collect():
        f = r.d
        for left, right in r.path:
            f = h(left, f, right)
        assert f == r.root and r.extra == r.k * 2 and r.d == h(str(r.k))
