import corpus_pipeline
from rscframe.llm.textkit import table


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == table(spark, sf_dir, "documents").columns, name
    kept = docs.count()
    assert 0 < kept < before and docs.select("doc_id").distinct().count() == kept


def test_run_ends_with_encoded_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_leave_columns_of_any_name_unchanged(spark, sf_dir):
    from pyspark.sql import functions as F

    names = ["full", "cut", "budget", "_stats", "_domain", "_lang", "_source", "_epoch", "_full", "_cut", "score", "set_id", "id", "component_id", "domain", "key", "a.b"]
    docs = table(spark, sf_dir, "documents").where("doc_id < 60").select("*", *[F.concat(F.lit(n + " "), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name


def test_pipeline_takes_empty_tables_and_nulls(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for part in (docs.where("false"), docs.where("doc_id < 40").selectExpr("doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, part, sf_dir).count() <= 40


def test_near_dedup_stage_is_that_of_brute_force(spark, sf_dir):
    from tests.llm.test_operators import brute_components

    docs = table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots = brute_components([t for _, t in rows], 5, 80)
    want = [rows[i][0] for i, root in enumerate(roots) if root == i]
    assert len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()) == want
