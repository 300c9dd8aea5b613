import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeline.llm import decontam, packing
from test_ngram_join import slow as slow_groups


@pytest.fixture
def tables(spark, tmp_path):
    passage = "this very passage is repeated across documents " * 8
    bench = "What does the bench ask about tall red trees? It asks for nine green apples."
    base = [" ".join(f"w{(i * 37 + j * j) % 997}x" for j in range(40)) for i in range(400)]
    rows = [(i, base[i] + ("\n" + passage if i % 7 == 0 else "") + (" vilest scoundrel" if i % 5 == 0 else ""), "en") for i in range(400)]
    rows += [(1100, base[1], "en"), (1101, base[1] + " more", "en"), (1102, base[2] + " " + bench + " " + base[3], "en"), (1103, None, None), (1104, "", "en"), (1105, passage, "en"), (1106, base[2], "en"), (1106, base[2], "en")]
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_each_stage_does_its_work(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    ids = lambda name: sorted(r.doc_id for r in stages[name](spark, docs, tables).select("doc_id").collect())
    every = sorted(r.doc_id for r in docs.collect())
    assert ids("toxicity") == [d for d in every if not (d < 400 and d % 5 == 0)]
    left = stages["line_dedup"](spark, docs, tables)
    holders = [r.doc_id for r in left.where(F.col("text").contains("this very passage")).collect()]
    assert holders == [0, 7] and not {1100, 1105} & {r.doc_id for r in left.collect()} and {1103, 1104} <= {r.doc_id for r in left.collect()}
    assert all(r.n_chars == len(r.text or "") for r in left.where("text IS NOT NULL").collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    chosen = sorted({k for k, _, c in slow_groups(rows, 5, 80) if k == c})
    assert ids("ngram_join") == chosen
    assert ids("decontamination") == [d for d in every if d != 1102]


def test_run_equals_its_stages(spark, tables):
    bins = corpus_pipeline.run(spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
    want = sorted((r.doc_id, len(decontam.re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1) for r in docs.collect())
    assert sorted((d, n) for b in bins for d, n in zip(b.doc_ids, b.lengths, strict=True)) == want
    assert all(b.capacity in packing.SIZES and b.used == sum(b.lengths) for b in bins)


def test_clashing_columns_come_back(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    more = docs.selectExpr("*", "doc_id * 2 AS toxic_score", "'a' AS leaks", "doc_id AS key", "1 AS dropped_lines", "'n' AS component_id", "7 AS n", "'b' AS text_")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, tables)
        assert got.dtypes == more.dtypes, name
        assert got.where("NOT (toxic_score <=> doc_id * 2 AND leaks = 'a' AND key <=> doc_id AND dropped_lines = 1 AND component_id = 'n' AND n = 7 AND text_ = 'b')").count() == 0, name
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stage(spark, docs, tables).collect()), name


def test_empty_tables(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    assert corpus_pipeline.pack(spark, none, tables).count() == 0
