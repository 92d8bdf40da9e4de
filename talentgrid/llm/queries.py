"""Registered queries of the text operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm import bpe, caps, centroids, lines, manifest, mixing, neardup, pages, passages, posting_lists, quality, radix, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.doc_id AND r.root < p.y),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""")
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=2, per_cent=80)


@query()
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ids = bpe.encoded(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.prefix_counts(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, budgets=(1024,))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "chars_within_1024", "steps")


@query("""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS k
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY k) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS kept, sha256(k) AS text_sha256
FROM n""")
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return radix.exact_groups(table(spark, folder, "documents"))


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


@query()
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), ~held_out("doc_id"))
    return quality.scored(docs, model).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_content")


@query("""
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS line_no, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)),
d AS (SELECT line, row_number() OVER (ORDER BY line) AS node FROM (SELECT DISTINCT line FROM l WHERE line <> '')),
w AS (
  SELECT node, list_distinct(list_transform(range(1, greatest(length(line) - 9, 1) + 1), lambda i: substr(line, i, 10))) AS ws FROM d),
e AS (SELECT node, len(ws) AS n, unnest(ws) AS g FROM w),
p AS (
  SELECT a.node AS x, b.node AS y FROM e a JOIN e b ON a.g = b.g AND a.node <> b.node AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT node, node AS root FROM d UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.node AND r.root < p.y),
c AS (SELECT line, min(root) AS root FROM r JOIN d USING (node) GROUP BY line),
k AS (SELECT *, coalesce(root, -row_number() OVER (ORDER BY doc_id, line_no)) AS part FROM l LEFT JOIN c USING (line))
SELECT doc_id, line_no, first_value(doc_id) OVER g AS keep_doc_id, first_value(line_no) OVER g AS keep_line_no,
  count(*) OVER (PARTITION BY part) AS copies, row_number() OVER g = 1 AS kept
FROM k WINDOW g AS (PARTITION BY part ORDER BY doc_id, line_no)""")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_groups(table(spark, folder, "documents"))


@query("""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.vec_id AND r.root < p.y),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
d AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN d ON d.x = e.vec_id""")
def op6_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_vectors(table(spark, folder, "embeddings"), cosine=0.98)


@query()
def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, folder, "documents"))
    return found.select("doc_id", "start_word", "end_word", "n_words", F.sha2("passage", 256).alias("passage_sha256"))


DOMAINS = ["web", "books", "code", "forum"]
WEIGHTS = {("web",): 0.5, ("books",): 0.2, ("code",): 0.2, ("forum",): 0.1} | {
    (d, lang): w for d in DOMAINS for lang, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))}


def tree() -> dict[str, Column]:
    """The tables name no domains: sources are dealt to them by their number."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    return {"domain": F.element_at(F.array(*map(F.lit, DOMAINS)), (number % 4 + 1).cast("int")), "lang": F.col("lang"), "source": F.col("source")}


def _level(name: str, keys: str, above: str, weight: str) -> str:
    """SQL of one level's shares: children up to the highest filled one are full, the others share the rest by weight."""
    up = keys.rpartition(", ")[0]
    by = f"PARTITION BY {up} " if up else ""
    join = f"JOIN {above} USING ({up})" if up else f", {above}"
    return f"""
{name}0 AS (SELECT {keys}, sum(tokens) * 3.0::DOUBLE AS room, {weight} AS w FROM leaf GROUP BY {keys}),
{name}1 AS (SELECT {name}0.*, budget AS b, sum(room) OVER ({by}ORDER BY room / w RANGE UNBOUNDED PRECEDING) AS r,
  sum(w) OVER ({by}) - sum(w) OVER ({by}ORDER BY room / w RANGE UNBOUNDED PRECEDING) AS v FROM {name}0 {join}),
{name}2 AS (SELECT *, r + room / w * v <= b * (1 + 1e-12) AS full_ FROM {name}1),
{name} AS (SELECT {keys}, CASE WHEN full_ THEN room ELSE w * (b - coalesce(sum(room) FILTER (full_) OVER ({by}), 0))
  / sum(w) FILTER (NOT full_) OVER ({by}) END AS budget FROM {name}2)"""


@query(f"""
WITH base AS (
  SELECT doc_id, ['web', 'books', 'code', 'forum'][1 + coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4] AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM base GROUP BY ALL),
top AS (SELECT sum(tokens) * 0.6::DOUBLE AS budget FROM leaf),
{_level("d", "domain", "top", "CASE domain WHEN 'web' THEN 0.5 WHEN 'forum' THEN 0.1 ELSE 0.2 END::DOUBLE")},
{_level("g", "domain, lang", "d", "CASE WHEN lang = 'en' THEN 0.55 WHEN lang IN ('de', 'fr', 'es') THEN 0.15 ELSE 1 END::DOUBLE")},
{_level("s", "domain, lang, source", "g", "1.0::DOUBLE")},
t AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens + 1e-12) AS BIGINT) ELSE 0 END AS epochs FROM leaf JOIN s USING (domain, lang, source)),
o AS (SELECT base.*, epochs, CAST(floor(budget + 1e-6) AS BIGINT) - epochs * tokens AS rest, sum(n_tokens) OVER (
    PARTITION BY domain, lang, source ORDER BY md5('7|' || epochs || '|' || doc_id), n_tokens ROWS UNBOUNDED PRECEDING) AS taken
  FROM base JOIN t USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, epochs + CAST(taken <= rest AS BIGINT) AS copies FROM o""")
def op4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), tree(), WEIGHTS, share=0.6, max_epochs=3, seed=7)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


@query(f"""
WITH RECURSIVE b AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
    sha256({" || ".join(_field(f) if f != "text" else _field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") for f in FIELDS)}) AS changed,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS c FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM b),
n AS (
  SELECT tree, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS total FROM l
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (max(total) + 15) // 16 FROM n WHERE total > 1 GROUP BY tree, lvl, pos // 16),
s AS (SELECT tree, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM n WHERE total = 1),
m AS (
  SELECT 0 AS lvl, pos, node, count(*) OVER () AS total FROM s
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (max(total) + 15) // 16 FROM m WHERE total > 1 GROUP BY lvl, pos // 16),
h AS (SELECT tree, max(lvl) AS height FROM n GROUP BY tree),
o AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos < a.pos), '') AS before,
    coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos > a.pos), '') AS after
  FROM n a JOIN n x ON a.tree = x.tree AND a.lvl = x.lvl AND a.pos // 16 = x.pos // 16 WHERE a.total > 1 GROUP BY a.tree, a.lvl, a.pos
  UNION ALL
  SELECT s.tree, height + a.lvl, s.pos, coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos < a.pos), ''),
    coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos > a.pos), '')
  FROM s JOIN h USING (tree) JOIN m a ON a.pos = s.pos >> 4 * a.lvl JOIN m x ON a.lvl = x.lvl AND a.pos // 16 = x.pos // 16
  WHERE a.total > 1 GROUP BY s.tree, height, a.lvl, s.pos),
f AS (
  SELECT doc_id, leaf, tree, pos, 0 AS lvl, '' AS proof, CASE WHEN xor(c, 4294967295) % 5 = 0 THEN changed ELSE leaf END AS now FROM l
  UNION ALL
  SELECT doc_id, leaf, f.tree, f.pos, f.lvl + 1, proof || before || after, sha256(before || now || after)
  FROM f JOIN h USING (tree) JOIN o ON o.tree = f.tree AND o.lvl = f.lvl AND (f.lvl >= height OR o.pos = f.pos >> 4 * f.lvl)),
e AS (SELECT h.tree, height + (SELECT max(lvl) FROM m) AS ends FROM h)
SELECT doc_id, leaf, s.node AS subroot, (SELECT node FROM m WHERE total = 1) AS root, sha256(proof) AS proof_sha256, now AS folded_root,
  now = (SELECT node FROM m WHERE total = 1) AS verified
FROM f JOIN e ON e.tree = f.tree AND ends = f.lvl JOIN s ON s.tree = f.tree""")
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(
        table(spark, folder, "documents"), FIELDS, {"text": manifest.folded_case(F.col("text"))},
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def _rounds(k: int, rounds: int) -> str:
    """SQL of all assignments and moves: a0, c1, a1, c2, ..."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""
a{i} AS MATERIALIZED (
  SELECT row_no, vec_id, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c)) AS b
  FROM v, c{i} GROUP BY row_no, vec_id, x)""")
        if i < rounds:
            out.append(f"""
s{i} AS (SELECT b.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) AS r(i) GROUP BY b.c, i),
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c AS c, coalesce(m, c{i}.v) AS v
  FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{i} GROUP BY c) USING (c))""")
    return ",".join(out)


@query(f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS v FROM (
  SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 40)),{_rounds(40, 5)}
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.c = b.c""")
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_report(*centroids.clusters(table(spark, folder, "embeddings"), k=40, rounds=5, seed=2))


@query()
def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = posting_lists.nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.withColumn("query_id", F.col("query_id").cast("long"))
