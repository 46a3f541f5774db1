"""The registered rules are those of the contract, for hosts and subdomains, longest first."""

from crossweave.llm.queries import op8_url_filter


def test_registered_rules_give_their_verdicts(spark, tmp_path):
    wanted = {
        "http://a.com/en/1": ("com/en/", "block"), "https://www.example.com/en/7x?q": ("example.com/en/7", "allow"), "http://example.com/en/6": ("com/en/", "block"),
        "http://Some.NET/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://a.example.net/de/8#x": ("example.net/de/8", "block"), "http://b.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame([(i, u, None) for i, u in enumerate(wanted)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op8_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(wanted.values()))
