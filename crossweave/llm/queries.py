"""The queries opN_<name> over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm import chat_format
from crossweave.llm.bpe import encode_documents, round_trip
from crossweave.llm.common import materialise
from crossweave.llm.decontaminate import contaminated
from crossweave.llm.language_id import fit, held_out, predict
from crossweave.llm.line_dedup import dedup_lines
from crossweave.llm.ngram_join import gram_components
from crossweave.llm.prefix_trie import conversations, rebuilt, trie
from crossweave.llm.quality_rules import base_failed, judged
from crossweave.llm.secret_scan import BASE, listed, of_kinds, secret_spans
from crossweave.llm.sharding import sharded
from crossweave.llm.token_output import id_layout, shard_folder, write_shards
from crossweave.llm.url_filter import UrlRule, judged_urls
from crossweave.llm.vector_codes import compressed

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the shards of word-piece ids; their bytes are in the shared folder."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    layout = id_layout(path)
    encoded = encode_documents(_table(spark, sf_dir, "documents").select("text"), path, width=layout.width)
    # encoded once: counts and shards both come from the written ids
    ids = materialise(encoded.select("ids"), "token-ids", compression="zstd")
    return write_shards(ids, F.col("ids"), shard_folder(ids), layout)


def token_digests(decoded: DataFrame) -> DataFrame:
    """doc_id and n_tokens, with digests of the ids and of the decoded text."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=5, num=75, den=100)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (F.size(of_kinds("spans", k)).cast("long").alias(f"n_{k}") for k in BASE)
    return rows.select("doc_id", *counts, F.sha2(listed(of_kinds("spans", *BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"  # the template's own control strings
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.chat_digests(rows.unionByName(extra))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(conversations(rows), family=5, most=9))


QUERIES: dict[str, Query] = {
    "op1_token_shards": op1_token_shards,
    "op2_bpe_encode_decode": op2_bpe_encode_decode,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_sharding": op7_sharding,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_chat_format": op11_chat_format,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, {_LOWER_AZ.format(r"trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.top IS NOT NULL AND k.doc_id <> c.top AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key AND length(k.key) >= 40
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP9_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) t(k) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, text, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         len(list_filter(list_zip(words[:-2], words[2:]), lambda x: x[1] = x[2])) AS n_stutters,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines) OR 5 * n_stutters > n_words
            OR 10 * len(regexp_extract_all(text, '\p{{Lu}}')) > 4 * word_chars OR 5 * len(regexp_extract_all(text, '[!?]')) > n_words
            OR 10 * len(regexp_extract_all(text, '[0-9]')) > 3 * word_chars OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM base
"""

OP5_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER_AZ.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, v.y FROM reach r JOIN ways v ON v.x = r.other
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

#: Openings by the role before and the role, closings by role, and one backslash for each control string, escaped or not, inside a text.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), s AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*(s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\]|ROLE\]|/ROLE\])')) AS chars,
         CASE WHEN pos = 1 AND role = 'system' THEN 18 WHEN pos = 1 AND role = 'user' OR before = 'assistant' AND role = 'user' THEN 10
              WHEN before = 'system' AND role = 'user' THEN 0 WHEN before = 'user' AND role = 'assistant' THEN 1 END AS opening,
         19 + length(role) + len(regexp_extract_all(role, '<\\*(s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\]|ROLE\]|/ROLE\])')) AS spelt,
         CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 8 ELSE 5 END AS closing
  FROM s
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(coalesce(opening, spelt) + chars + closing)::BIGINT AS formatted_chars, count(*) FILTER (opening IS NULL) = 0 AND arg_max(role, pos) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""

_OP12_NEAREST = """
  SELECT vec_id, label, p, x, e, d FROM (
    SELECT v.vec_id, v.label, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN {books} b ON b.p = v.p
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1
"""
_OP12_MEANS = """
  SELECT b.p, b.e, CASE WHEN n IS NULL THEN b.c ELSE list_transform(range(1, len(b.c) + 1), lambda i: (s[i] - ((s[i] % n) + n) % n) // n) END AS c FROM {books} b LEFT JOIN (
    SELECT p, e, count(*) AS n, list_transform(range(1, max(len(x)) + 1), lambda i: list_sum(list_transform(list(x), lambda y: y[i]))::BIGINT) AS s FROM {assigned} GROUP BY p, e
  ) m ON m.p = b.p AND m.e = b.e
"""
OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT vec_id, label, p, x[p * len(x) // 16 + 1:(p + 1) * len(x) // 16] AS x FROM kept, range(16) t(p)
), b0 AS (
  SELECT p, e, x AS c FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
), a0 AS ({_OP12_NEAREST.format(books="b0")}), b1 AS ({_OP12_MEANS.format(books="b0", assigned="a0")}), a1 AS ({_OP12_NEAREST.format(books="b1")}
), b2 AS ({_OP12_MEANS.format(books="b1", assigned="a1")}), a2 AS ({_OP12_NEAREST.format(books="b2")}
), out AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM out
"""

OP13_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, t.pos, 0 AS own, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= h
  UNION ALL SELECT c.conv_id, t.pos, 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h
), p AS (
  SELECT conv_id, row_number() OVER w AS d, strlen(text)::BIGINT AS n, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
), e AS (
  SELECT c.conv_id, coalesce(max_by(path, d), '') AS path FROM c LEFT JOIN p USING (conv_id) GROUP BY c.conv_id
), n AS (
  SELECT path, d::BIGINT AS depth, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(n) AS bytes FROM (SELECT * FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c) GROUP BY path, d
), leaves AS (
  SELECT path FROM n WHERE path NOT IN (SELECT path[1:32 * (depth - 1)] FROM n WHERE depth > 0)
)
SELECT n.conv_id, n.depth, (SELECT m.conv_id FROM n m WHERE m.path = n.path[1:32 * (n.depth - 1)] AND n.depth > 0) AS parent_conv_id, n.n_convs,
       (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND starts_with(m.path, n.path))::BIGINT AS n_children,
       (SELECT count(*) FROM leaves l WHERE starts_with(l.path, n.path))::BIGINT AS n_leaves,
       (SELECT sum((m.n_convs - 1) * m.bytes) FROM n m WHERE starts_with(m.path, n.path))::BIGINT AS saved_tokens,
       sha256(coalesce((SELECT string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id) FROM e WHERE e.path = n.path), '')) AS ends_sha256
FROM n
"""

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_chat_format": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
