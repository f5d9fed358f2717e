"""The pipeline's stages against plain versions, on the smallest data and on odd rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import ODD, docs, plain_alike, plain_hits
from windloom.llm import pii, toxicity
from windloom.llm.common import table


def test_stages_keep_columns_and_decide(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bench = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, sf_dir)
        before = d.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == d.columns
        after = out.collect()
        kept = {r["doc_id"] for r in after}
        if name == "toxicity":
            lex = toxicity.learn(d, table(spark, sf_dir, "labels"))
            assert kept == {r["doc_id"] for r in before if lex.score(lex.weigh(r["text"])[0], lex.weigh(r["text"])[2]) < 0.3}
        elif name == "simhash":
            ids = [r["doc_id"] for r in before]
            assert kept == set(plain_alike(ids, [r["text"] for r in before]))
        elif name == "decontamination":
            assert kept == {r["doc_id"] for r in before if not plain_hits(r["text"], bench, 10)[4]}
        elif name == "pii":
            assert kept == {r["doc_id"] for r in before} and all(not pii.base_spans(r["text"]) or "[" in r["text"] for r in after)
        else:
            assert kept == {r["doc_id"] for r in before} and all(len(r["ids"]) == r["n_pieces"] for r in after)
        d = spark.createDataFrame(after, out.schema)


def test_odd_rows_pass(spark, sf_dir):
    d = docs(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf_dir)
        assert out.count() > 0
        d = spark.createDataFrame(out.collect(), out.schema) if "text" in out.columns else out


def test_empty_table_passes(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= table(spark, sf_dir, "documents").count() and out.where(F.size("ids") != F.col("n_pieces")).count() == 0


@pytest.mark.parametrize("name", ["op1_warc", "op6_decontaminate"])
def test_sql(spark, sf_dir, name):
    import duckdb

    from windloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(cur.fetchall(), key=str)
