"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, kneser_ney, line_dedup, line_quality, packing, parity_join, prefix_trie, spelling, token_records, toxicity, url_filter
from .scratch import new_path
from .tokens import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return parity_join.jaccard_components(docs, k=4, threshold=parity_join.Threshold(85, 100)).select("doc_id", "n_shingles", "component_id")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-records")
    token_records.write_records(_table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"), end_id=2)
    read = token_records.read_sequences(spark, path)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = kneser_ney.fold_of("doc_id", 3) == 1
    chain = toxicity.train(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    out = toxicity.score(docs, chain)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_toxic_tokens", F.transform("spans", lambda x: F.array(x["start"], x["end"])).alias("spans"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality.line_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "lost_lines", "lost_words")
    return out.select("doc_id", *(F.col(f"q_{x}").alias(x) for x in names))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=0, capacity=2048)
    return places.withColumnRenamed("id", "doc_id")


def op6_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(kneser_ney.fold_of("doc_id", 7) != 2))
    held_out = kneser_ney.fold_of("doc_id", 7) == 2
    return kneser_ney.score(docs, model).withColumn("held_out", held_out).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_conversations(turns, vocabulary_path("byte_bpe_50k.json")))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), text_col="text")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("q_n_lines").alias("n_lines"), F.col("q_removed_lines").alias("n_removed"), "text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


#: The rules (host, path, verdict) of op11, and the names whose registered hosts its method blocks.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BLOCKED_NAMES = ("adult-x", "casino-win", "cheap-pills", "free-bets")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list has every host of the corpus whose own name is one of ``BLOCKED_NAMES``; where no rule fits, the cascade's answer counts."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts = pages.select(F.explode(url_filter.domains(url_filter.parsed(F.col("url"))[0])).alias("host")).where(F.substring_index("host", ".", 1).isin(*BLOCKED_NAMES)).distinct()
    out = url_filter.judge_urls(pages, rules, hosts)
    return out.select("page_id", *(F.col(f"q_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.count_words(_table(spark, sf_dir, "documents"), spoil=199, least_chars=6, least_count=5), times=5)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_records, op3_toxicity, op4_line_quality, op5_best_fit_packing, op6_kneser_ney_scores, op7_chat_format, op8_html_extract, op9_line_dedup, op10_decontaminate, op11_url_filter, op12_prefix_trie, op13_spelling_variants)}
#: The unsigned CRC-32 of a text's UTF-8 bytes, where a row of ``crc`` has the table t of its 256 steps.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) g(i))"


def _crc(text: str) -> str:
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda j: ('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in line_quality.BOILERPLATE)

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS n, count(*) AS k FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id""",
    "op4_line_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \t-\r]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, a, lead(a, 1) OVER x AS b, lead(a, 2) OVER x AS c FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS again FROM g),
v AS (SELECT doc_id, again OR coalesce(lag(again, 1) OVER x, false) OR coalesce(lag(again, 2) OVER x, false) AS inside
      FROM r WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, count(*) FILTER (inside) AS n_repeat_words FROM v GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
k AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^ \t-\r]+')) AS nw FROM l WHERE regexp_matches(l, '[^ \t-\r]')),
b AS (SELECT doc_id, l, nw,
        len(regexp_extract_all(l, ' [|>»•·] ')) >= 3 OR len(regexp_extract_all(l, '[#*$%&|<>]')) * 100 > nw * 20
        OR NOT regexp_matches(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?…:;]["''”’»)\]]*$') OR {_PHRASES} AS bad FROM k),
q AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (bad) AS lost_lines,
        coalesce(sum(nw) FILTER (bad), 0)::BIGINT AS lost_words FROM b GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(lost_lines, 0) AS lost_lines,
        coalesce(lost_words, 0) AS lost_words FROM w LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * lost_words <= 30 * n_words AS kept FROM f""",
    "op11_url_filter": rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
k(rh, rp, v) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
f AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
      FROM h JOIN k ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(string_split(host, '.'), {list(BLOCKED_NAMES)}) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f USING (page_id)""",
    "op12_prefix_trie": rf"""
WITH {_CRC_TABLE},
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r FROM conversations),
b AS (SELECT c.conv_id, t.r, role, text FROM c JOIN t ON t.conv_id = base AND t.r <= h),
k AS (SELECT conv_id, h, (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id) AS k FROM c),
p AS (SELECT * FROM b UNION ALL SELECT t.conv_id, t.r - h + k, role, text FROM t JOIN k ON k.conv_id = t.conv_id AND t.r > h),
x AS MATERIALIZED (SELECT conv_id, r AS d, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY r)) AS key FROM p
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT d, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM x JOIN (SELECT conv_id, max(d) AS d FROM x GROUP BY conv_id) USING (conv_id, d) GROUP BY d, key),
n AS MATERIALIZED (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(chars) AS cost FROM x GROUP BY d, key),
q AS MATERIALIZED (SELECT n.*, p.key AS pkey, m.conv_id AS parent FROM n LEFT JOIN x p ON p.conv_id = n.conv_id AND p.d = n.d - 1 LEFT JOIN n m ON m.d = p.d AND m.key = p.key),
ch AS (SELECT d - 1 AS d, pkey AS key, count(*) AS k FROM q WHERE d > 0 GROUP BY d, pkey),
s AS (SELECT a.d, a.key, sum(q.cost) AS cost, count(*) FILTER (ch.k IS NULL) AS leaves FROM q JOIN x a ON a.conv_id = q.conv_id AND a.d <= q.d LEFT JOIN ch ON ch.d = q.d AND ch.key = q.key GROUP BY a.d, a.key)
SELECT q.conv_id, q.d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(ch.k, 0) AS n_children, leaves AS n_leaves, s.cost::BIGINT AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM q JOIN s USING (d, key) LEFT JOIN ch USING (d, key) LEFT JOIN e USING (d, key)""",
    "op13_spelling_variants": rf"""
WITH {_CRC_TABLE},
r AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents) GROUP BY doc_id, w),
h AS (SELECT w, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM r, crc),
v AS MATERIALIZED (SELECT w AS word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM h)
      WHERE length(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
g AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM v, range(1, 10000) x(i) WHERE i <= length(word)),
p AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
      UNION SELECT g.word, v.word FROM g JOIN v ON v.word = cut UNION SELECT v.word, g.word FROM g JOIN v ON v.word = cut),
m AS (SELECT a, count(*) AS n_near, max(n) AS top, min_by(b, (-n, b)) AS b FROM p JOIN v ON v.word = p.b GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN b END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN m ON m.a = v.word),
z AS (WITH RECURSIVE c AS (SELECT word, form AS up FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.up WHERE f.form IS NOT NULL)
      SELECT c.word, up AS root FROM c JOIN f ON f.word = c.up WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z ON z.word = f.word""",
}
