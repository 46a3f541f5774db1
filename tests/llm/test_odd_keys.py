"""Labels that share ids, hosts of very many labels, and lines that one id or rows without ids hold very often."""

import time

import pytest
from pyspark.sql import functions as F

from crossweave.llm import language_id, line_dedup, url_filter


def fitted(spark, rows):
    return language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=400)


@pytest.mark.parametrize("one_id", [7, None])
def test_a_language_whose_rows_share_an_id_is_learned(spark, one_id):
    english = [(i, f"the cat and the dog sat there number {i}", "en") for i in range(300)]
    german = [(one_id, f"der hund und die katze sitzen dort nummer {i % 900}", "de") for i in range(9000)]
    model = fitted(spark, english + german)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(spark.createDataFrame([(1, "der hund und die katze"), (2, "the dog and the cat")], "doc_id long, text string"), model).collect()}
    assert got == {1: "de", 2: "en"}


def test_one_text_of_a_language_is_enough(spark):
    rows = [(i, f"the cat and the dog sat there number {i}", "en") for i in range(2000)] + [(5, "der hund und die katze", "de")] * 3000
    got = language_id.predict(spark.createDataFrame([("der hund und die katze",), ("the dog",)], "text string"), fitted(spark, rows)).collect()
    assert [r.lang_pred for r in got] == ["de", "en"]


def test_the_sample_is_bounded(spark):
    rows = spark.createDataFrame([(f"word{i} and word{i + 1}", "en") for i in range(20_000)] + [("ein text", "de")] * 5000, "text string, lang string").withColumn("h", F.xxhash64("text"))
    got = {r["lang"]: r["count"] for r in language_id.sampled(rows, {"en": 20_000, "de": 1}, 400).groupBy("lang").count().collect()}
    assert 300 < got["en"] < 500 and got["de"] == 1


def test_a_host_of_very_many_labels(spark):
    host = "a." * 100_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/7/x", None), (2, "http://sub.example.com/en/1", ""), (3, "http://" + "b." * 50_000 + "net/x", None)], "page_id long, url string, html string")
    rules = [url_filter.UrlRule("block", "com", "/en/"), url_filter.UrlRule("allow", "example.com", "/en/7")]
    began = time.time()
    hosts = pages.select(url_filter.url_host(F.col("url")).alias("host"))
    assert url_filter.parent_edges(hosts).count() == 2 and hosts.select(F.sum(F.size(url_filter._suffixes(F.col("host"), 2)))).first()[0] == 6
    assert time.time() - began < 20
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in url_filter.judged_urls(pages, rules).collect()}
    assert got == {1: ("example.com/en/7", "allow", len(host)), 2: ("com/en/", "block", 15), 3: (None, "allow", 100_003)}


def test_rows_without_ids_that_share_a_line_are_spread(spark):
    line = "This line of well over forty code points is in every one of these rows."
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(line + "\nown "), F.col("id").cast("string")).alias("text"))
    dealt = line_dedup.line_keys(docs, 40).repartitionByRange(16, *line_dedup._COLS)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 8000
    got = line_dedup.dedup_lines(docs).agg(F.count("*").alias("n"), F.sum("n_dropped").alias("gone")).first()
    assert (got.n, got.gone) == (40_000, 0)  # one document


@pytest.mark.parametrize("others,gone", [(3, 0), (4, 1)])
def test_a_document_of_several_ranges_counts_once(spark, others, gone):
    line = "This line of well over forty code points is in every one of these rows."
    rows = [(50, f"{line}\n{i}") for i in range(3000)] + [(k, f"{line}\nother {k}") for k in range(others)]
    got = {r.doc_id: (r.n, r.gone) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_dropped").alias("gone")).collect()}
    assert got == {50: (3000, 0)} | {k: (1, gone) for k in range(others)}
