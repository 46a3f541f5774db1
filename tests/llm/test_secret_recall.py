"""Random tokens in real documents are found however few long words the corpus has, and its long words are not reported."""

import random

import pytest
from pyspark.sql import functions as F

from crossweave.llm import secret_scan

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER, DIGITS = UPPER.lower(), "0123456789"
DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def recall(spark, alphabet, lengths, docs=None, n=120):
    """The share of planted tokens that are reported, and documents with a random span that had none planted."""
    rng = random.Random(7)
    rows = [(-1 - i, "key " + "".join(rng.choice(alphabet) for _ in range(lengths[i % len(lengths)])) + " end") for i in range(n)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    found = secret_scan.secret_spans(rows if docs is None else docs.unionByName(rows)).where(F.exists("spans", lambda s: s["kind"] == "random"))
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    return sum(i < 0 for i in ids) / n, [i for i in ids if i >= 0]


def test_tokens_planted_in_documents_with_three_long_words(spark):
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", "text")
    share, others = recall(spark, UPPER + LOWER + DIGITS, (24, 32, 40, 64), docs)
    assert share >= 0.97 and not others
    assert recall(spark, UPPER + LOWER + DIGITS, (24, 32, 40, 64)) == (share, [])  # and alone


@pytest.mark.parametrize("alphabet", [LOWER, UPPER, UPPER + "234567", LOWER + "234567", UPPER + DIGITS, LOWER + DIGITS])
def test_keys_of_one_case(spark, alphabet):
    assert recall(spark, alphabet, (24, 32, 48, 64, 128))[0] >= 0.97


def test_long_words_are_not_reported(spark):
    words = ["internationalisierung", "Incomprehensibilities", "COUNTERREVOLUTIONARY", "donaudampfschifffahrt", "anticonstitutionnellement", "desproporcionadamente", "uncharacteristically", "precipitevolissimevolmente"]
    words += ["chpfheitschverheiten", "eauaitionouierelleaux", "losasmentementemente", "Thsttiontionthingesat", "some_long_name_of_a_column", "AbstractFactoryBeanProviders", "MAX_NUMBER_OF_ROWS_PER_TABLE", "usr/share/doc/packages/readme"]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secret_scan.secret_spans(rows).collect() if r.spans} == {}
