"""Results that are read after other operators were built, or under other settings."""

import pytest

from pagelathe.llm import capfilter, ngrams, simhash, substrings


@pytest.mark.parametrize("last", [False, True])
def test_scores_do_not_depend_on_what_is_built_meanwhile(spark, sf_dir, last):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, ngrams.score(docs).collect()))
    first = None if last else ngrams.score(docs)
    links = capfilter.embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    near = simhash.near_duplicates(docs)
    first = ngrams.score(docs) if last else first
    if not last:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = sorted(map(tuple, first.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)
    assert links.count() > 0 and near.count() > 0


def test_a_batch_size_that_a_user_has_set_stays(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set(name, "123")
    try:
        assert substrings.remove_repeats(docs).count() == docs.count() and spark.conf.get(name) == "123"
    finally:
        spark.conf.unset(name)
