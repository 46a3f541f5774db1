"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from crossweave.llm import bpe, decontaminate, language_id, line_dedup, ngram_join, quality_rules, secret_scan, sharding, token_output, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 50_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "alpha beta gamma delta epsilon zeta", "en", "a", 5),
    (3, "alpha beta gamma delta epsilon zeta", "en", "a", 5),
    (4, "alpha beta gamma delta epsilon zeta", "de", None, 5),
    (None, "alpha beta gamma delta epsilon zeta", "de", "b", 5),
    (5, LONG, "en", "b", 9),
    (6, "\n\n\n", "en", "b", 3),
]
#: Columns with the names of outputs and of what operators use inside.
CLASH = ("n_lines", "n_dropped", "ids", "n_tokens", "decoded", "lang_pred", "score", "n_words", "kept", "failed_rule", "shard", "slot", "pos", "keep", "uid", "h1", "spans", "part", "row", "size")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def operators(spark, path):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta gamma delta epsilon zeta"), (3, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven")], "item_id long, text string")
    model = language_id.fit(spark.createDataFrame([(i, t, g) for i in range(40) for t, g in (("the cat and the dog sat", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string"))
    return {
        "op2": lambda d: bpe.round_trip(d, path),
        "op3": lambda d: language_id.predict(d, model),
        "op4": lambda d: line_dedup.dedup_lines(d),
        "op5": lambda d: ngram_join.gram_components(d),
        "op6": lambda d: decontaminate.contaminated(d, items),
        "op7": lambda d: sharding.sharded(d, sharding.Ring(shards=3)),
        "op9": lambda d: quality_rules.judged(d),
        "op10": lambda d: secret_scan.secret_spans(d),
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op9", "op10"])
def test_odd_rows_and_empty_tables(spark, docs, none, path, name):
    op = operators(spark, path)[name]
    got = op(docs)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name != "op6":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert op(none).collect() == []


def test_line_dedup_rows(spark, docs):
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert {(1, 1, 0), (2, 1, 0), (6, 4, 0), (None, 1, 0)} <= got


def test_line_dedup_keeps_the_largest_id_and_counts_ids_once(spark):
    line = "This is a line of well over forty code points, repeated."
    rows = [(i, f"own {i}\n  {line.upper()} ") for i in range(4)]
    same = spark.createDataFrame([*rows, *rows, (3, line)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(same).collect())  # four ids
    got = line_dedup.dedup_lines(spark.createDataFrame([*rows, *rows, (None, line)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_dropped, r.text) for r in got} == {(i, 1, f"own {i}") for i in range(3)} | {(3, 0, rows[3][1]), (None, 1, "")}


def test_line_dedup_splits_hot_lines_over_partitions(spark):
    line = "x" * 60
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(f"{line}\n{line}").alias("text"))
    got = line_dedup.dedup_lines(many).groupBy("n_dropped").count().collect()
    assert {(r["n_dropped"], r["count"]) for r in got} == {(2, 3999), (0, 1)}


def test_gram_components_rows(spark, docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.gram_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3), (4, 2, 3), (None, 2, 3), (5, 1, 5), (6, 0, 6)], key=str)


def test_decontamination_rows(spark, docs):
    items = spark.createDataFrame([(3, "Alpha beta gamma delta epsilon zeta"), (4, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(3, 3), (4, 3), (None, 3)}
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(docs, items).collect()) == ["1", "2", "5", "6", "None"]
    assert decontaminate.contaminated(docs, items.where("item_id = 4")).collect() == []


def test_language_of_nothing(spark, docs):
    none = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    model = language_id.fit(spark.createDataFrame([(i, "the cat", "en") for i in range(9)], "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, None), (2, "123 € …"), (3, "zq"), (4, "the cat")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(rows, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3] == ("en", 0.5) and got[4] == ("en", 1.0)


def test_urls(spark):
    rules = [url_filter.UrlRule("block", "com", "/en/"), url_filter.UrlRule("allow", "example.com", "/en/7"), url_filter.UrlRule("block", "bad.org", "")]
    bad = '<a href="http://bad.org/x">b</a>'
    pages = [(1, None, None), (2, "no url", bad), (3, "http://A.Example.com/en/71?q", None), (4, "https://example.com/en/1#f", ""), (5, "http://bad.org", None), (6, "http://friend.org/a", bad), (6, "http://friend.org/a", bad), (7, "http://clean.net?x", None), (8, "http://notexample.com/en/7", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[4] == ("example.com", "/en/1", "com/en/", "block")
    assert got[5] == ("bad.org", "", "bad.org", "block") and got[6] == ("friend.org", "/a", None, "block") and got[7] == ("clean.net", "", None, "allow")
    assert got[8][2] == "com/en/"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judged_urls(empty, rules).collect() == [] and {r.verdict for r in url_filter.judged_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), []).collect()} == {"allow"}


def test_shards_of_odd_rows(spark, docs, none, tmp_path):
    layout = token_output.Layout(length=16, rows=64)
    manifest = token_output.write_shards(docs, token_output.byte_tokens(), str(tmp_path / "a"), layout).collect()
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    assert sum(r.n_rows for r in manifest) == -(-total // 16)
    assert token_output.write_shards(none, token_output.byte_tokens(), str(tmp_path / "b"), layout).collect() == []


def test_pipeline_of_odd_rows(spark, docs, none, tmp_path):
    import corpus_pipeline as cp

    folder = str(tmp_path)
    spark.createDataFrame([(1, "nothing like the texts at all, really")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for start in (docs, none):
        now = start
        for name, stage in cp.STAGES:
            out = stage(spark, now, folder)
            if name != "bpe":
                assert out.schema.names == start.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in start.schema]
                assert {r["n_lines"] for r in out.select("n_lines").collect() if "n_lines" in start.columns} <= {"x"} if "n_lines" in start.columns else True
            now = out
        ids = {r.doc_id for r in now.collect()}
        assert ids == ({3, None, 5} if start is docs else set())


def test_a_slow_rule_comes_last(spark):
    """Measured over the sample, not by the job around it: the order is the same each time."""
    slow = quality_rules.Rule("slow", "length(sha2(repeat(text, 100), 512)) < 0 OR word_chars > 15 * n_words")
    rules = [slow, quality_rules.Rule("short", "n_words < 50"), quality_rules.Rule("digits", "10 * n_symbols > n_words")]
    words = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('word and word ', cast(id % 40 as int)), repeat('#', cast(id % 7 as int)))").alias("text"))
    for _ in range(3):
        assert quality_rules.plan(words, rules)[-1].name == "slow"
    assert [r.name for r in quality_rules.ordered(rules, [1.0, 1.0, 0.5], {"110": 4, "001": 2, "011": 1})] == ["digits", "slow", "short"]


def test_shards_refuse_a_folder_that_tasks_cannot_write(none):
    with pytest.raises(Exception, match="s3a"):
        token_output.write_shards(none, token_output.byte_tokens(), "s3a://bucket/x")


def test_shards_of_a_very_long_text(spark, tmp_path):
    import numpy as np

    text = "".join(chr(97 + i % 26) for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string").coalesce(1)
    layout = token_output.Layout(length=1000, rows=50)
    token_output.write_shards(docs, token_output.byte_tokens(), str(tmp_path / "long"), layout)
    records = list(token_output.read_slots(str(tmp_path / "long"), 0, 1 << 40, layout))
    order = token_output.Permutation(len(records), layout.key)
    stream = b"".join(records[s] for s in order.slots(np.arange(len(records))))
    assert stream.rstrip(b"\xff") == text.encode() + b"\xff\xff" + text.encode()
