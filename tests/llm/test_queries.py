"""Registered queries against their SQL, and the pipeline against the brute force."""

import brute
import pytest

import corpus_pipeline
from voxframe.llm import decontam, queries, stages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    assert brute.rows_of(got.select(cols)) == brute.expected(want.fetchall())


def test_suffix_and_simhash_queries_on_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert brute.rows_of(queries.op7_suffix_dedup(spark, SF)) == brute.expected(brute.repeated_bytes(docs))
    assert brute.rows_of(queries.op2_simhash(spark, SF)) == brute.expected(brute.near_duplicates(docs))


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain reading of what it does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_dedup", "decontaminate", "mix_sources", "shard"]
    kept = [stages.quality_rules(spark, docs, SF)]
    figures = {r.doc_id: brute.quality_figures(r.text) for r in docs.collect()}
    ids = {r.doc_id for r in kept[0].collect()}
    assert all(figures[i][0] >= 50 and 2 * figures[i][4] <= figures[i][0] for i in ids)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in ids for i, q in labels.items() if q == 1 and i in figures and figures[i][0] >= 50)
    assert not any(i in ids for i, q in labels.items() if q == 0)

    rows = [(r.doc_id, r.text) for r in kept[0].collect()]
    kept.append(stages.simhash_dedup(spark, kept[0], SF))
    assert {r.doc_id for r in kept[1].collect()} == {i for i, _, c in brute.near_duplicates(rows) if i == c}

    kept.append(stages.decontaminate(spark, kept[1], SF))
    index = decontam.Index.build([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    items = ["".join(map(chr, c)) for c in index.items]
    left = {r.doc_id for r in kept[2].collect()}
    for r in kept[1].collect():
        folded = "".join(map(chr, decontam.normalised(r.text)[0]))
        if any(item in folded for item in items):
            assert r.doc_id not in left

    kept.append(stages.mix_sources(spark, kept[2], SF))
    sizes, took = {}, {}
    for r in kept[2].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    for r in kept[3].collect():
        took[r.source] = took.get(r.source, 0) + len(brute.words(r.text))
    assert all(abs(took[s] - t) <= 1 for s, t in brute.targets(sizes).items())
    assert all(k.columns == cols for k in kept)
    final = stages.shard(spark, kept[3], SF)
    assert final.columns[:len(cols)] == cols and final.filter("shard NOT BETWEEN 0 AND 23").count() == 0
    assert brute.rows_of(corpus_pipeline.run(spark, SF)) == brute.rows_of(final)
