"""A host isn't blocked for one blocked page, nor for those of a sibling; one with mostly blocked pages is."""

from crossweave.llm import url_filter


def test_one_blocked_page_blocks_neither_its_host_nor_siblings(spark):
    rules = [url_filter.UrlRule("block", "org", "/es/"), url_filter.UrlRule("allow", "good.com", "")]
    urls = [f"http://big.example.org/{'es' if i == 0 else 'en'}/{i}" for i in range(1000)]
    urls += [f"http://clean.example.org/en/{i}" for i in range(5)] + ["http://example.org/en/0"]
    urls += [f"http://bad.other.org/{'es' if i < 9 else 'en'}/{i}" for i in range(10)] + ["http://tidy.other.org/en/1", "http://calm.other.org/en/2"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {(r.host, r.verdict) for r in url_filter.judged_urls(pages, rules).collect() if r.rule is None}
    assert got == {("big.example.org", "allow"), ("clean.example.org", "allow"), ("example.org", "allow"), ("bad.other.org", "block"), ("tidy.other.org", "allow"), ("calm.other.org", "allow")}
