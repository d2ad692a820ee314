"""The pipeline, stage by stage, and the registered queries of the subpackage."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ledgerspark.llm import bpe, exact_dedup, minhash, mixing, quality
from ledgerspark.llm.common import Scratch
from ledgerspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def frame_rows(frame):
    """Sorted rows; pandas shows nulls, and whole numbers beside them, in several ways."""
    columns = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert frame_rows(QUERIES[name](spark, SF).toPandas()) == frame_rows(con.sql(ORACLES[name]).df())


def test_whole_tables(spark):
    for name, table in (("op1_html_text", "pages"), ("op4_licenses", "documents"), ("op8_bpe", "documents"), ("op3_quality", "documents")):
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_bpe_digests(spark):
    import hashlib

    library = Tokenizer.from_file(bpe.default_tokenizer())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op8_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages(spark):
    """Each stage keeps what its operator decides, row by row."""
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    decide = [
        lambda d: ids(quality.score(d, labels, Scratch(spark, "t")).where("kept")),
        lambda d: ids(exact_dedup.exact_groups(d, Scratch(spark, "t")).where(exact_dedup.KEPT)),
        lambda d: ids(minhash.near_groups(d, Scratch(spark, "t")).where("keeper")),
        lambda d: Counter({r.doc_id: r.times for r in mixing.mix(d, Scratch(spark, "t"), F.array("source")).where("times > 0").collect()}),
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES, decide):
        before = docs
        docs = scratch.write(stage(spark, docs, SF), name)
        assert docs.columns == columns and ids(docs) == want(before), name
    library = Tokenizer.from_file(bpe.default_tokenizer())
    texts = {r.doc_id: r.text for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last) == ids(docs)
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in last)
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, whole)) == Counter((r.doc_id, r.n_tokens) for r in last)


def test_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").join(labels, "doc_id")
    good, kept_good, kept_bad = labels.where("quality = 1").count(), kept.where("quality = 1").count(), kept.where("quality = 0").count()
    assert kept_good >= 0.99 * good and kept_bad <= 0.1 * labels.where("quality = 0").count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert all(isinstance(s, str) for s in __spark_entry__.oracle_sql().values())


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, empty texts, clashing names, and an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _f int, pattern string, row string"
    words = "lake stone river walked green after before house light under".split()
    some = lambda k: " ".join(words[(k * j) % 10] + str(k) for j in range(1, 30))
    rows = [(k, some(k), None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, k, "p", None) for k in range(20)]
    rows += [(3, some(3), "en", "s0", 5, 3, "p", None), (3, some(77), "en", "s0", 5, 3, "p", None), (None, some(78), None, None, None, None, None, None), (50, None, None, None, None, None, None, None), (51, "", "en", "s1", 0, 0, "", "")]
    for name, own in (("odd", rows), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()
        # Without labels all stay; of equal rows one; null, empty and unfit texts aren't mixed in.
        assert (name == "empty") == (not out) and {r.doc_id for r in out} <= {r[0] for r in rows if r[1]}
        if own:
            docs = spark.read.parquet(f"{sf}/documents.parquet")
            kept = corpus_pipeline.drop_near(spark, Scratch(spark, "t").write(corpus_pipeline.drop_exact(spark, docs, sf), "exact"), sf)
            assert kept.columns == docs.columns and sorted(Counter(r.doc_id for r in kept.collect()).items(), key=str) == sorted(Counter([*range(20), 3, None, 51]).items(), key=str)
