import duckdb
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tarnspark.llm import line_dedup, mixing, queries, toxicity
from tests.llm.test_models import plain_chain

SF = "/root/testdata/sf0.001"


def test_stages_in_order_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


CLASHES = [
    "_d", "_w_source", "_w_lang", "_w_topic", "_p", "_mix", "topic", "tokens", "mass", "_k1", "_k2", "_r1", "_r2", "_may", "_new", "_runs", "_spans", "_key", "_hash", "_blank", "_id", "_x", "root", "node", "n",
    "_slot", "_word", "_bits", "_member", "x", "h", "y",
]


def test_columns_of_any_name_pass_through_all_stages(spark):
    """Each stage keeps the extra columns and their values, whatever its own columns are called, and null in any column."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = docs.columns
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "web", 0), (None, "a text without any id at all", "de", None, 28)], docs.schema)
    docs = docs.unionByName(odd).select(*names, *(F.xxhash64("doc_id", F.lit(k)).alias(c) for k, c in enumerate(CLASHES)))
    before = docs.columns
    for title, stage in corpus_pipeline.STAGES[:-1]:
        own = {(r["doc_id"], r["_d"]): tuple(r[c] for c in CLASHES) for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before, title
        kept = docs.collect()
        assert kept and all(tuple(r[c] for c in CLASHES) == own[r["doc_id"], r["_d"]] for r in kept), title
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_toxicity_stage_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    want = sorted(d for d, text in docs.select("doc_id", "text").collect() if plain_chain(chain, text)[-1] <= toxicity.THRESHOLD)
    assert sorted(r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, SF).collect()) == want


def test_line_dedup_stage_follows_the_operator(spark):
    """A document of which nothing is left goes, the others have the operator's text and its length."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect() if not r.removed_spans or r.text.strip()}
    got = corpus_pipeline.line_dedup_stage(spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got if r.text)


def test_mixing_stage_keeps_by_probability(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix_documents(docs)
    decided = mixed.select("doc_id", "kept", "probability", mixing.uniform(F.col("doc_id"), seed=0).alias("u")).collect()
    assert all(r.kept == (r.u < r.probability) for r in decided)
    assert sorted(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()) == sorted(r.doc_id for r in decided if r.kept)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_parity(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = c.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(x) for x in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
