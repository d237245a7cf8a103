"""The registered queries and the pipeline over the smallest tables."""

import glob
import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, decontamination, pii, quality_classifier, queries
from marlstone.llm.common import BATCH_ROWS
from test_shingles import brute_clusters

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    shape = docs.dtypes
    held: list = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], SF).write.parquet(out := str(tmp_path / f"{len(held)}"))
        held.append(spark.read.parquet(out))
    assert all(d.dtypes == shape for d in held[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in held]
    bad = {r.doc_id for r in quality_classifier.classify(held[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0").collect()}
    assert ids[1] == ids[0] - bad and bad
    # groups by shingles of five words and a Jaccard similarity of 0.8, by brute force; the smallest id of each stays
    rows = sorted((r.doc_id, r.text) for r in held[1].collect())
    assert ids[2] == {rows[i][0] for i in brute_clusters([t for _, t in rows])} and len(ids[2]) < len(ids[1])
    hits = {r.doc_id for r in decontamination.find_contaminated(held[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - hits and ids[4] == ids[5] == ids[3]
    assert held[4].filter(F.size(pii.seeds(F.col("text"))) > 0).count() == 0
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(held[5].collect())


def test_stages_take_nulls_ties_and_clashing_names(spark):
    """Each stage keeps all columns and survives nulls, repeated rows, long texts, clashing names and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, score double, text_key string"
    rows = [(1, None, "a", None, 1, "x", 0.0, "k"), (None, "", "b", "s", 1, "x", 0.0, "k"), (3, "tie tie", None, "s", 1, "x", 0.0, "k"), (3, "tie tie", None, "s", 1, "x", 0.0, "k"), (4, "mail a@b.c " * 9000, "d", "s", None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == len(rows) and last(spark, docs.limit(0), SF).count() == 0


def _largest_batch(df):
    """Rows of the largest Arrow batch that Python gets."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows] * batch.num_rows})

    return df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES if name != "personal data"])
def test_stages_send_small_batches(spark, name):
    """A stage whose texts go to Python lowers the session's rows of a batch, and leaves a lower number as it is."""
    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.range(0, 12_000, 1, 1)
    try:
        for given, least, most in ((None, BATCH_ROWS, BATCH_ROWS), ("0", BATCH_ROWS, BATCH_ROWS), ("7", 7, 7)):
            spark.conf.unset(key) if given is None else spark.conf.set(key, given)
            dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SF)
            assert least <= _largest_batch(rows) <= most
    finally:
        spark.conf.unset(key)


def test_workers_forget_pieces(spark):
    """When a task of the last stage is over, its worker holds no pieces of texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(e.memo) + len(e.flat) for e in bpe._ENCODERS.values())] * batch.num_rows, "encoders": [len(bpe._ENCODERS)] * batch.num_rows})

    try:
        assert len(corpus_pipeline.tokens(spark, docs, SF).collect()) == docs.count()
        rows = spark.range(0, 64, 1, 16).mapInArrow(held, "n long, encoders long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.encoders for r in rows) == 1 and max(r.n for r in rows) == 0
