"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factorseg.llm import ann, chat_format, embedding_dedup, jaccard_join, license_scan, mixing, ngram_model, packing, prefix_trie, substring_dedup, toxicity, vector_codes, warc_bundles
from factorseg.operators.lineage import Scratch, cut_lineage, drop_written

ENGLISH = ("'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'")
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {ENGLISH}), '[^\\x20\\x09-\\x0D]+')"


LICENSES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), k=3, similarity=(9, 10)).select(
        "doc_id", "n_shingles", "component_id")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.scores(_read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(_read(spark, sf_dir, "documents")).drop("start", "end")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_format.read_back(chat_format.examples(turns.unionByName(extra)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(_read(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    out = prefix_trie.trie(prefix_trie.shared_heads(_read(spark, sf_dir, "conversations"), scratch))
    scratch.drop()
    return out


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_bundles.new_folder(spark)
    records = warc_bundles.read_bundles(warc_bundles.write_bundles(_read(spark, sf_dir, "pages"), folder))
    out = cut_lineage(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    drop_written(spark, folder)
    return out


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_ann": op2_ann,
    "op3_ngram_model": op3_ngram_model,
    "op4_license_scan": op4_license_scan,
    "op5_mixing": op5_mixing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_chat_format": op8_chat_format,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_warc": op13_warc,
}


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round's codebooks as one step; exact integers throughout."""
    near = """SELECT vec_id, label, p, v, arg_min(k, d * 256 + k) AS k, min(d) AS d FROM (
  SELECT x.*, c.k, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d
  FROM parts x JOIN c{n} c USING (p)) GROUP BY ALL"""
    steps = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
parts AS (SELECT vec_id, label, p, e[p * len(e) // {parts} + 1:(p + 1) * len(e) // {parts}] AS v FROM v, range({parts}) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT p, k, v AS c FROM parts JOIN first USING (vec_id))"""]
    for n in range(rounds):
        steps.append(f"a{n} AS ({near.format(n=n)})")
        steps.append(f"""u{n} AS (SELECT p, k, i, sum(x) AS s, count(*) AS m FROM (
  SELECT p, k, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{n}) GROUP BY ALL)""")
        steps.append(f"""c{n + 1} AS (SELECT p, k, coalesce(f.c, o.c) AS c FROM c{n} o LEFT JOIN (
  SELECT p, k, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS c FROM u{n} GROUP BY p, k) f USING (p, k))""")
    steps.append(f"a AS ({near.format(n=rounds)})")
    return "WITH " + ",\n".join(steps) + f""",
codes AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY vec_id, label),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS sha FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM codes, sha"""


# the unsigned CRC-32 of the decimal conv_id, bit by bit
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)),
  4294967295)"""

ORACLES = {
    "op1_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3
        THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS items FROM w),
n AS (SELECT doc_id, len(items)::BIGINT AS n_shingles, list_sort(items)::VARCHAR AS same, items FROM s),
r AS (SELECT same, min(doc_id) AS rep, any_value(n_shingles) AS n, any_value(items) AS items FROM n
      WHERE n_shingles > 0 GROUP BY same),
t AS (SELECT rep, n, unnest(items) AS t FROM r),
common AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.t = b.t
      AND a.rep < b.rep AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9 GROUP BY ALL),
l AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, low) AS (SELECT rep, rep FROM r UNION SELECT e.b, low FROM reach JOIN e ON reach.node = e.a),
c AS (SELECT node, min(low) AS component FROM reach GROUP BY node)
SELECT doc_id, n_shingles, coalesce(component, doc_id) AS component_id
FROM n LEFT JOIN r USING (same) LEFT JOIN c ON r.rep = c.node""",
    "op5_mixing": """
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT *, pow(n::DOUBLE, 0.9) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM c),
q AS (SELECT source, n, i, greatest(1, round(w * 1000 / sum(w) OVER ()))::BIGINT AS q FROM w),
a AS (SELECT list(q ORDER BY i) AS q, sum(q)::BIGINT AS p FROM q),
e(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(q, lambda x: 0::BIGINT), 0::BIGINT FROM a
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, k: d + CASE WHEN k = best THEN 1 ELSE 0 END), best FROM (
    SELECT t, done, list_min(list_filter(list_transform(range(1, len(done) + 1), lambda k:
        CASE WHEN (done[k] * p) // q[k] <= t + 1 THEN ((done[k] + 1) * p + q[k] - 1) // q[k] * 1000000 + k END),
        lambda x: x IS NOT NULL)) % 1000000 AS best
    FROM e, a WHERE t + 1 < p)),
s AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM e WHERE t >= 0),
b AS (SELECT q.*, a.p, (n + 15) // 16 AS blocks FROM q, a),
stop AS (SELECT max((blocks - 1) // b.q * p + t + 1) AS stop FROM b JOIN s ON b.i = s.i AND s.j = (blocks - 1) % b.q),
used AS (SELECT b.*, stop // p * b.q + (SELECT count(*) FROM s WHERE s.i = b.i AND s.t < stop % p) AS used FROM b, stop),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM documents),
o AS (SELECT r.doc_id, r.source, u.q, u.p, u.n, u.i, unnest(range(k, used * 16, n)) AS o
      FROM r JOIN used u ON r.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, source, o // n AS mix_epoch, (o // 16 // q * p + t) * 16 + o % 16 AS mix_position
FROM o JOIN s ON o.i = s.i AND s.j = o.o // 16 % o.q""",
    "op4_license_scan": f"""
WITH templates(license, text) AS (VALUES {LICENSES}),
shingled AS (SELECT 't' AS kind, license AS id, text, NULL AS doc_id FROM templates
             UNION ALL SELECT 'd', NULL, text, doc_id FROM documents),
w AS (SELECT kind, id, doc_id, {WORDS} AS ws FROM shingled),
s AS (SELECT kind, id, doc_id, len(ws) AS n, CASE WHEN len(ws) >= 5
        THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS items FROM w),
t AS (SELECT id AS license, len(items) AS m, len(list_distinct(items)) AS n_template, unnest(list_distinct(items)) AS item
      FROM s WHERE kind = 't'),
p AS (SELECT doc_id, n, unnest(items) AS item, unnest(range(len(items))) AS pos FROM s WHERE kind = 'd'),
h AS (SELECT doc_id, n, license, m, n_template, item, pos, unnest([pos // m - 1, pos // m]) AS win FROM p JOIN t USING (item)),
g AS (SELECT doc_id, n, license, win, n_template, count(DISTINCT item) AS n_shared, min(pos) AS low, max(pos) AS high
      FROM h WHERE win >= 0 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY n_shared DESC, win) AS rank
      FROM g WHERE 5 * n_shared >= 4 * n_template)
SELECT doc_id, license, n_shared, n_template, low AS first_word, least(high + 5, n) - 1 AS last_word FROM b WHERE rank = 1""",
    "op8_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n,
             length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 16 AS chars FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(prefix) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""",
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach(node, low) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, low FROM reach JOIN l ON node = l.a),
c AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = node""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, md5(text)) AS steps, {CRC32} % 6 AS h
        FROM t GROUP BY conv_id),
c AS (SELECT o.conv_id, list_concat(coalesce(b.steps[1:o.h], []), o.steps[o.h + 1:]) AS steps
      FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
m AS (SELECT conv_id, len(steps) AS len, d, steps[1:d] AS path FROM c, range((SELECT max(len(steps)) + 1 FROM c)) r(d) WHERE d <= len(steps)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(path[-1].t), 0) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256
      FROM m GROUP BY path, d),
k AS (SELECT p.path, count(c.path) AS n_children FROM n p LEFT JOIN n c ON c.d = p.d + 1 AND c.path[1:p.d] = p.path GROUP BY p.path),
s AS (SELECT a.path, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens
      FROM n b JOIN k USING (path) CROSS JOIN range((SELECT max(d) + 1 FROM n)) r(x) JOIN n a ON x <= b.d AND a.d = x AND a.path = b.path[1:x]
      GROUP BY a.path)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN k USING (path) JOIN s USING (path) LEFT JOIN n p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha FROM p),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(sha, j // 4 * 5 + 1, 5))::BIGINT >> (15 - j % 4 * 5)) & 31) + 1, 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first_id FROM h),
r AS (SELECT *, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to FROM r""",
}
