"""Keys that hold most of a table are spread over tasks, and results are those of plain versions."""

import bisect
import collections
import zlib

import pytest
from pyspark.sql import functions as F

from crossweave.llm import common, graph, sharding, url_filter


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.fixture
def wide(spark):
    """Joins in 16 tasks that adaptive execution neither merges nor replaces by broadcasts."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("16", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_spread_join(wide):
    left = wide.range(100_000).select(F.when(F.col("id") < 99_000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = wide.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k % 3 <> 0")
    got = common.spread_join(left, right, ["k"], ["id"], "left")
    assert most_in_a_task(got) < 50_000 / 2
    assert got.where("v IS NULL").count() == sum(1 for i in range(99_000, 100_000) if i % 3 == 0) and got.where("v = 14").count() == 99_000


def test_components_of_a_star(wide):
    edges = wide.range(1, 30_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(wide.range(50_000, 50_010).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = graph.components(edges, edges_a_part=2_000)
    assert {(r["component"], r["count"]) for r in got.groupBy("component").count().collect()} == {(0, 30_001), (50_000, 11)}
    pairs = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    assert most_in_a_task(graph._star(pairs, True)) < 10_000


def plain_shards(rows, ring):
    """The ring row by row: keys in order of cell and rank take their node's shard, then those left over go on clockwise."""
    places, owner = ring.owners()
    quota = [len(rows) // ring.shards + (s < len(rows) % ring.shards) for s in range(ring.shards)]
    used, left, out = [0] * ring.shards, [], collections.Counter()
    for cell, n in sorted(collections.Counter(rows).items()):
        at = bisect.bisect_left(places, cell) % len(places)
        for _ in range(n):
            if used[owner[at]] < quota[owner[at]]:
                used[owner[at]] += 1
                out[cell, owner[at]] += 1
            else:
                left.append((cell, at))
    for cell, at in left:
        while used[owner[at]] >= quota[owner[at]]:
            at = (at + 1) % len(places)
        used[owner[at]] += 1
        out[cell, owner[at]] += 1
    return out


@pytest.mark.parametrize("shards", [40, 41])
def test_registered_ring_is_the_plain_one(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    ring = sharding.Ring(shards=shards)
    got = sharding.sharded(docs, ring).withColumn("cell", sharding._place(ring)).collect()
    cells = [r.cell for r in got]
    assert collections.Counter((r.cell, r.shard) for r in got) == plain_shards(cells, ring)
    texts = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == texts
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_few_rows_move_to_another_shard_count(spark):
    counts = collections.Counter(sharding._mix(i * 77 + 5) % (1 << 14) for i in range(60_000))
    place = lambda n: {(c, k): s for c, a, b, s, _ in sharding.stretches(counts, sharding.Ring(shards=n)) for k in range(a, b)}
    before, after = place(40), place(41)
    moved = sum(before[k] != after[k] for k in before) / len(before)
    assert 1 / 41 <= moved < 0.15  # exact evenness costs some moves beyond the new shard's share


def test_hot_ids_and_repeated_rows_are_spread(wide):
    null = wide.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    same = wide.range(40_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    rest = wide.range(10, 4_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ring = sharding.Ring(shards=7)
    got = sharding.sharded(null.unionByName(same).unionByName(rest), ring).cache()
    assert most_in_a_task(got) < 20_000
    by = got.groupBy("shard").agg(F.count("*"), F.min("slot"), F.max("slot"), F.countDistinct("slot")).collect()
    assert len(by) == 7 and all(r[1] == r[4] == r[3] + 1 and r[2] == 0 and r[1] - 83_990 // 7 in (0, 1) for r in by)
    runs = null.select("doc_id", F.lit(1).cast("long").alias("size"), F.crc32("text").alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").count().withColumn("cell", F.lit(3))
    ranked = sharding.ranked_runs(runs, {3: 40_000, **dict.fromkeys(range(10, 4_000), 1)}, ring)
    assert most_in_a_task(ranked) < 15_000 and ranked.agg(F.sum("count")).first()[0] == 40_000
    assert sorted(r.first + k for r in ranked.collect() for k in range(r["count"])) == list(range(40_000))


def test_a_host_with_most_pages(wide):
    rules = [url_filter.UrlRule("block", "hot.com", "/en/"), url_filter.UrlRule("allow", "com", "/en/7")]
    pages = wide.range(30_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.com/"), F.when(F.col("id") % 2 == 0, "en/").otherwise("de/"), "id").alias("url"), F.lit(None).cast("string").alias("html"))
    got = url_filter.judged_urls(pages, rules)
    assert most_in_a_task(got) < 10_000
    assert got.where("path LIKE '/en/%' AND (rule <> 'hot.com/en/' OR verdict <> 'block')").count() == 0 and got.count() == 30_000


def test_rules_and_links_against_a_plain_version(spark):
    """Whole table, with links between hosts: rules page by page, walks vertex by vertex, thresholds host by host."""
    rules = [url_filter.UrlRule("block", "bad.org", "/"), url_filter.UrlRule("allow", "good.com", "/"), url_filter.UrlRule("block", "good.com", "/spam"), url_filter.UrlRule("block", "com", "/en/")]
    hosts = ["bad.org", "x.bad.org", "good.com", "a.good.com", "farm1.net", "farm2.net", "ring.info", "calm.info", "b.example.com", "example.com"]
    links = {"farm1.net": ["bad.org"], "farm2.net": ["bad.org", "x.bad.org"], "ring.info": ["farm1.net"], "calm.info": ["good.com"], "a.good.com": ["calm.info", "bad.org"]}
    paths = ["/", "/es/1", "/en/2", "/spam/3", "/other"]
    pages = []
    for i in range(200):
        h = hosts[(i * 7) % 10]
        html = " ".join(f'<a href="https://{x.upper()}/p">t</a>' for x in links.get(h, []) if i % 3)
        pages.append((i, f"http://{h}{paths[(i * 3) % 5]}?q#f", html or None))
    pages += [(200, None, None), (200, "no", ""), (201, "http://HUGE.info/" + "p" * 50_000, '<a href="http://bad.org">' * 20_000)]
    split = lambda u: (u.split("://", 1)[1].split("/", 1)[0].lower(), "/" + u.split("://", 1)[1].split("/", 1)[1].split("?")[0]) if u and "://" in u else ("", "")

    def rule(h, p):
        fits = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)] if h else []
        return max(fits, key=lambda r: (len(r.text), r.verdict == "block"), default=None)

    edges = collections.Counter()
    for _, u, html in pages:
        h = split(u)[0]
        for x in {t.split('"')[0].split("/")[0].lower() for t in (html or "").split("://")[1:]}:
            if h and x != h:
                edges[h, x] += 1.0
    every = {split(u)[0] for _, u, _ in pages} - {""}
    for h in every:
        while h.count(".") > 1:
            up = h.split(".", 1)[1]
            for pair in ((h, up), (up, h)):
                edges["parent", *pair] = 1.0
            h = up
    both = collections.Counter()
    for k, w in edges.items():
        both[k[-2:]] += w

    def walk(pairs, seed):
        out = collections.Counter()
        for (a, _), w in pairs.items():
            out[a] += w
        score = dict(seed)
        for _ in range(url_filter.ROUNDS):
            new = collections.Counter({h: 0.3 * s for h, s in seed.items()})
            for (a, b), w in pairs.items():
                new[b] += 0.7 * score.get(a, 0.0) * w / out[a]
            score = new
        return score

    count, good, bad = collections.Counter(), collections.Counter(), collections.Counter()
    for _, u, _ in pages:
        h, p = split(u)
        if h:
            r = rule(h, p)
            count[h] += 1
            good[h] += r is not None and r.verdict == "allow"
            bad[h] += r is not None and r.verdict == "block"
    back = {(b, a): w for (a, b), w in both.items()}
    trust, distrust = walk(both, {h: n / good.total() for h, n in good.items()}), walk(back, {h: n / bad.total() for h, n in bad.items()})
    share, total = walk(back, {h: bad[h] / count[h] for h in count}), walk(back, dict.fromkeys(count, 1.0))
    want = collections.Counter()
    for i, u, _ in pages:
        h, p = split(u)
        r = rule(h, p)
        graph_says = "block" if h and distrust[h] > 2 * trust[h] and share[h] / total[h] > 0.25 else "allow"
        want[i, h, p, r.text if r else None, r.verdict if r else graph_says] += 1
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "best", "trust", "__part", "src")})
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged_urls(df, rules).collect())
    assert got == want
    assert {h for _, h, _, r, v in want if r is None and v == "block"} >= {"farm2.net"} and "calm.info" not in {h for _, h, _, _, v in want if v == "block"}
