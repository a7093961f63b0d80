"""The registered queries of the subpackage, one per operator and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat, core, decontaminate, fingerprints, jaccard_join, katz, line_dedup, merkle, packing, prefix_trie, quality, repair, token_counts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = core.shared_dir(spark, "token-ids")
    repair.write_ids(core.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), path)
    return repair.read_ids(spark, path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = core.documents(spark, sf_dir, "pages").select("page_id", "url", line_dedup.page_lines(F.col("html")).alias("text"))
    out = line_dedup.drop_lines(pages, line_dedup.page_host(F.col("url")))
    return out.select("page_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(core.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_decode(core.documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(core.documents(spark, sf_dir), quality.trusted_ids(core.documents(spark, sf_dir, "labels")))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(core.documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(core.documents(spark, sf_dir))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = core.documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_back(core.materialise(chat.format_messages(chat.text_messages(turns.unionByName(extra))), "chat-turns"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(core.documents(spark, sf_dir), n=4, percent=85)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(core.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=512)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.audit(core.documents(spark, sf_dir), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = prefix_trie.placed_turns(core.documents(spark, sf_dir, "conversations"))
    c = F.col("conv")
    return prefix_trie.trie(prefix_trie.rebuilt(own, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.rate(core.documents(spark, sf_dir), core.documents(spark, sf_dir, "benchmark"), window=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_repair_ids, op2_line_dedup, op3_packing, op4_byte_bpe, op5_quality, op6_katz, op7_fingerprints, op8_chat, op9_jaccard_join, op10_token_counts, op11_merkle, op12_prefix_trie, op13_decontamination, pipeline]
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS row, page_id, coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), ''), '') AS host,
         html IS NULL AS missing, string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS lines
  FROM pages),
l AS (SELECT row, page_id, host, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM p),
t AS (SELECT row, page_id, host, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS body FROM l),
n AS (SELECT host, body, count(DISTINCT row) AS n FROM t WHERE body <> '' GROUP BY ALL),
s AS (SELECT host, count(*) AS total FROM p GROUP BY ALL),
c AS (SELECT n.host, n.body FROM n JOIN s USING (host) WHERE n.n >= 3 AND n.n > s.total * 0.1),
k AS (SELECT t.*, c.body IS NOT NULL AS gone FROM t LEFT JOIN c ON t.host = c.host AND t.body = c.body)
SELECT page_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM k GROUP BY row, page_id
UNION ALL
SELECT page_id, 0, 0, NULL FROM p WHERE missing
"""

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '<(\|+)', '<\1|', 'g'))
            + length(regexp_replace(text, '<(\|+)', '<\1|', 'g')) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a AND l.b > r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_concat([4294967295], range(8 * length({text}))), lambda c, i:
      CASE WHEN i % 8 = 0 THEN (CASE WHEN xor(c, ord({text}[i // 8 + 1])) & 1 = 1 THEN xor(xor(c, ord({text}[i // 8 + 1])) >> 1, 3988292384) ELSE xor(c, ord({text}[i // 8 + 1])) >> 1 END)
           ELSE (CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) END), 4294967295)"""


def _encoded(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


OP11_SQL = f"""
WITH RECURSIVE i AS (SELECT row_number() OVER () AS r, doc_id, source, text, CAST(doc_id AS VARCHAR) AS name,
    {_encoded('CAST(doc_id AS VARCHAR)')} || {_encoded('source')} || {_encoded('lang')} || {_encoded('CAST(n_chars AS VARCHAR)')} AS head FROM documents),
f AS (SELECT r, doc_id, source, sha256(head || {_encoded('text')}) AS leaf, sha256(head || {_encoded("CASE WHEN " + _crc32_sql('name') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS shown FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM f),
t AS (SELECT source, 0 AS lvl, pos, leaf AS h, n FROM p
  UNION ALL SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, h, n FROM s
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
runs AS (SELECT source, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL),
tops AS (SELECT lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM u WHERE n > 1 GROUP BY ALL),
a AS (SELECT r, source, 0 AS lvl, pos, shown AS h, '' AS proof FROM p
  UNION ALL SELECT a.r, a.source, a.lvl + 1, a.pos // 3, sha256(array_to_string(hs[1:a.pos % 3], '') || h || array_to_string(hs[a.pos % 3 + 2:], '')),
    proof || array_to_string(hs[1:a.pos % 3], '') || array_to_string(hs[a.pos % 3 + 2:], '')
  FROM a JOIN runs ON runs.source IS NOT DISTINCT FROM a.source AND runs.lvl = a.lvl AND runs.run = a.pos // 3),
b AS (SELECT a.r, a.source, 0 AS lvl, s.pos, a.h, proof FROM (SELECT *, max(lvl) OVER (PARTITION BY r) AS most FROM a) a JOIN s ON s.source IS NOT DISTINCT FROM a.source WHERE a.lvl = most
  UNION ALL SELECT b.r, b.source, b.lvl + 1, b.pos // 3, sha256(array_to_string(hs[1:b.pos % 3], '') || h || array_to_string(hs[b.pos % 3 + 2:], '')),
    proof || array_to_string(hs[1:b.pos % 3], '') || array_to_string(hs[b.pos % 3 + 2:], '')
  FROM b JOIN tops ON tops.lvl = b.lvl AND tops.run = b.pos // 3),
e AS (SELECT r, h, proof FROM (SELECT *, max(lvl) OVER (PARTITION BY r) AS most FROM b) WHERE lvl = most)
SELECT p.doc_id, p.leaf, s.h AS subroot, u.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = u.h AS verified
FROM p JOIN e USING (r) JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN u ON u.n = 1
"""

OP12_SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM o),
c AS (SELECT conv_id, {_crc32_sql('name')} % 6 AS h FROM i),
b AS (SELECT c.conv_id, o.pos, o.k, o.len FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos <= h
  UNION ALL SELECT c.conv_id, 10 + o.pos, o.k, o.len FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > h),
r AS (SELECT c.conv_id, coalesce(list(b.k ORDER BY b.pos) FILTER (b.k IS NOT NULL), []) AS ks, coalesce(list(b.len ORDER BY b.pos) FILTER (b.k IS NOT NULL), []) AS lens FROM c LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY c.conv_id),
e AS (SELECT conv_id, ks, lens, unnest(range(len(ks) + 1)) AS d FROM r),
n AS (SELECT array_to_string(ks[1:d], ',') AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d = 0 THEN 0 ELSE lens[d] END) AS len,
    array_to_string(any_value(ks[1:d - 1]), ',') AS up, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len(ks)), '') AS ends, any_value(ks[1:d]) AS path FROM e GROUP BY ALL),
m AS (SELECT k, d, conv_id, n_convs, len, ends, path, CASE WHEN d > 0 THEN up END AS up FROM n),
ch AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0 GROUP BY ALL),
x AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN ch USING (k, d)),
y AS (SELECT array_to_string(path[1:j], ',') AS k, j AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * len) AS saved FROM (SELECT *, unnest(range(d + 1)) AS j FROM x) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, y.n_leaves, CAST(y.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN y USING (k, d) LEFT JOIN m p ON p.k = x.up AND p.d = x.d - 1
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(len(ws), 10) AS m, array_to_string(ws[j + 1:j + least(len(ws), 10)], ' ') AS g FROM (SELECT *, unnest(range(len(ws) - least(len(ws), 10) + 1)) AS j FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
v AS (SELECT r, m, j, array_to_string(ws[j + 1:j + m], ' ') AS g FROM (SELECT r, ws, m, unnest(range(greatest(len(ws) - m + 1, 0))) AS j FROM d, (SELECT DISTINCT m FROM w))),
f AS (SELECT v.r, v.j, v.m, w.item FROM v JOIN w ON w.m = v.m AND w.g = v.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(j, j + m)) AS p FROM f) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op8_chat": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_merkle": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_decontamination": OP13_SQL}
