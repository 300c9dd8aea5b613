import random

from pyspark.sql import functions as F

from tapeline.llm import lines
from tapeline.llm.common import with_size


def distance_within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def slow(rows, min_chars, edits):
    """Every line against every earlier line; rows of unique ids."""
    seen, out = [], {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        gone = []
        for at, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\x0b\x0c\r")
            if len(line) < min_chars:
                continue
            if any(line == s or edits and distance_within_one(line, s) for s in seen):
                gone.append(at)
            seen.append(line)
        out[key] = (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), gone)
    return out


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.choice([3, 6, 8, 40, 90, 300, 1200]))) for _ in range(14)]
    rows = []
    for k in range(90):
        text = []
        for _ in range(r.randrange(4)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(line) + 1)
                kind = r.randrange(3)
                if kind == 0:
                    line.insert(at, r.choice("abxé"))
                elif line and at < len(line):
                    line[at:at + 1] = [r.choice("xyz")] if kind == 1 else []
            text.append(r.choice(["", " "]) + "".join(line) + r.choice(["", "\t"]))
        rows.append((k, "\n".join(text)))
    return rows + [(None, rows[5][1]), (900, None), (901, ""), (902, "\n\n"), (903, rows[7][1])]


def test_equals_every_pair(spark):
    for seed, edits in ((1, 1), (2, 1), (3, 0)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' AS doc", "1 AS line", "'r' AS row").repartition(4)
        got = lines.dedup_lines(docs, min_chars=6, max_edits=edits)
        assert got.columns == ["doc_id", "text", "doc", "line", "row", "dropped_lines"]
        assert {r.doc_id: (r.text, r.dropped_lines) for r in got.collect()} == slow(rows, 6, edits)


def test_repeated_rows_and_long_lines(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(40000))
    docs = spark.createDataFrame([(1, long), (2, long[:100] + long[101:]), (3, "short"), (3, "short"), (4, "a line that is repeated"), (4, "a line that is repeated"), (5, "a line that is repeatet")], "doc_id long, text string")
    got = sorted((r.doc_id, len(r.text), r.dropped_lines) for r in lines.dedup_lines(docs).collect())
    assert got == [(1, 40000, []), (2, 0, [0]), (3, 5, []), (3, 5, []), (4, 23, []), (4, 23, []), (5, 0, [0])]
    assert lines.dedup_lines(docs.limit(0)).collect() == []


def test_short_lines_meet_exactly(spark):
    rows = [(1, "Of.\n\n" + "b" * 19), (2, "Of.\nOn.\n \n" + "b" * 20), (3, " On.\t\nx\n" + "b" * 18), (4, "x\n" + "b" * 19 + "c")]
    got = {r.doc_id: r.dropped_lines for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 3], 3: [0], 4: [0, 1]}


def test_repeated_rows_drop_a_line_once(spark):
    line = "a line that is repeated"
    rows = [(1, line)] + [(2, f"x\n{line}\n{line}")] * 3 + [(None, f"{line}\ny")] * 3
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 9, r.text, r.dropped_lines) for r in got) == [(1, line, [])] + [(2, "x", [1, 2])] * 3 + [(9, "y", [0])] * 3


def test_long_lists_are_not_marked_for_broadcast(spark):
    table = spark.range(2).select(F.sequence(F.lit(0), F.lit(2_000_000)).alias("drops"))
    assert with_size(table, 80 + 5 * F.size("drops")) is table
    assert with_size(table.limit(0), 80 + 5 * F.size("drops")) is not table
