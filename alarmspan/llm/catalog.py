"""Queries of the operators over whole tables, each beside its SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmspan.llm import (ann, exact_topk, html_text, hyperminhash, line_dedup, mixing, packing, periodic_runs, secret_scan,
                           signatures, simhash, token_counts, toxicity)
from alarmspan.llm.common import in_fold, table

# The mix of the registered query and the pipeline.
TARGET = mixing.Target(evenness=0.97, most_passes=2.0)
LEAST_WORDS = 50


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, TARGET).select("doc_id", "source", "n_tokens", F.col("pass").alias("pass_no"), "block", "block_key", "doc_key")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.largest_products(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, LEAST_WORDS)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "sequence_tokens")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, net)
    return scored.select("doc_id", in_fold("doc_id").alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
                         F.col("toxic").alias("over_language_threshold"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                        "spans", "n_random")


def op9_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return signatures.ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), 10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs, least_words=24, least_powers=3)
    # Exact order of length / period without dividing.
    ahead = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    best = F.get(F.array_sort("runs", lambda a, b: F.when(ahead(a, b) != 0, -F.sign(ahead(a, b)).cast("int"))
                              .when(a["start"] != b["start"], F.sign(a["start"] - b["start"]).cast("int"))
                              .otherwise(F.sign(a["period"] - b["period"]).cast("int"))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
                        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, least=0.8)


# Bisection written as recursion over brackets of the exponent; 48 halvings, as twelve passes of sixteen parts are.
_SQL_MIX = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
size AS (SELECT greatest(1, ceil(count(*) / 1000.0))::BIGINT AS n FROM d),
b AS (
  SELECT d.*, (('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT) % size.n AS block FROM d, size),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
g AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS n, max(tokens) AS most, min(tokens) AS least FROM s WHERE tokens > 0),
p AS (SELECT tokens / g.total AS p FROM s, g WHERE tokens > 0),
even(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN e >= {TARGET.evenness} THEN m ELSE lo END, CASE WHEN e >= {TARGET.evenness} THEN hi ELSE m END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS m,
      (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM p)
        / (SELECT ln(n) FROM g) AS e FROM even WHERE i < 48)),
flat AS (SELECT (SELECT CASE WHEN n = 1 THEN 1.0 ELSE -sum(p * ln(p)) / ln(n) END FROM p, g GROUP BY n) >= {TARGET.evenness} AS ok),
a1 AS (SELECT CASE WHEN flat.ok THEN 1.0 ELSE hi END AS a FROM even, flat WHERE i = 48),
limited(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN r > {TARGET.most_passes} THEN m ELSE lo END, CASE WHEN r > {TARGET.most_passes} THEN hi ELSE m END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS m, pow(g.most / g.least::DOUBLE, 1 - (lo + hi) / 2) AS r FROM limited, g WHERE i < 48)),
a AS (SELECT CASE WHEN a1.a < 1 AND pow(g.most / g.least::DOUBLE, 1 - a1.a) > {TARGET.most_passes} THEN l.hi ELSE a1.a END AS a
      FROM a1, g, limited l WHERE l.i = 48),
q AS (
  SELECT source, coalesce(quota // tokens, 1)::BIGINT AS whole, coalesce(quota % tokens, 0)::BIGINT AS rest FROM (
    SELECT source, tokens, CASE WHEN tokens > 0 THEN floor(tokens::DOUBLE * pow(g.most::DOUBLE / tokens, 1 - a.a))::BIGINT END AS quota
    FROM s, g, a)),
sums AS (SELECT source, block, sum(n_tokens) AS tokens FROM b GROUP BY source, block),
places AS (
  SELECT sums.source, sums.block, q.whole, q.rest - coalesce(sum(sums.tokens) OVER (
      PARTITION BY sums.source ORDER BY ('0x' || substr(md5('1|' || q.whole || '|' || coalesce(sums.source, '') || '|' || sums.block), 1, 15))::BIGINT,
      sums.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM sums JOIN q ON sums.source IS NOT DISTINCT FROM q.source),
t AS (
  SELECT b.*, whole, room, coalesce(sum(n_tokens) OVER (
      PARTITION BY b.source, b.block ORDER BY ('0x' || substr(md5('1|' || whole || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM b JOIN places ON b.source IS NOT DISTINCT FROM places.source AND b.block = places.block),
e AS (SELECT *, unnest(range(whole + CASE WHEN ahead < room THEN 1 ELSE 0 END)) AS pass_no FROM t)
SELECT doc_id, source, n_tokens, pass_no::BIGINT AS pass_no, block,
  ('0x' || substr(md5('1|' || pass_no || '|' || coalesce(source, '') || '|' || block), 1, 15))::BIGINT AS block_key,
  ('0x' || substr(md5('1|' || pass_no || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS doc_key
FROM e
"""

# Straight from the definition: every window of whole lines, and whether the same lines stood earlier; no hashes.
_SQL_LINES = f"""
WITH l AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
w AS (
  SELECT doc_id, i, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
    sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l WHERE words > 0),
spans AS (
  SELECT a.doc_id, a.i AS first, min(b.i) AS last, min(b.k) AS last_k, any_value(a.k) AS first_k
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.words >= {LEAST_WORDS} GROUP BY a.doc_id, a.i),
bodies AS (
  SELECT s.doc_id, s.first, s.last, string_agg(w.line, chr(10) ORDER BY w.k) AS body
  FROM spans s JOIN w ON w.doc_id = s.doc_id AND w.k BETWEEN s.first_k AND s.last_k GROUP BY s.doc_id, s.first, s.last),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS nth FROM bodies),
gone AS (SELECT DISTINCT r.doc_id, l.i FROM ranked r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN r.first AND r.last WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS text, count(*) AS n_lines, count(gone.i) AS n_removed
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# Every query against every vector, nothing else.
_SQL_PRODUCTS = """
WITH v AS (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.nth, q.vec_id AS query_id, x.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.e) = len(x.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

# Every term of every text counted, every document scored.
_SQL_RANKED = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS places FROM d),
t AS (
  SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  GROUP BY doc_id, term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s
  WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // places))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_html_text, op3_exact_topk, op4_line_dedup, op5_packing, op6_simhash, op7_toxicity, op8_secret_scan,
    op9_near_neighbours, op10_token_counts, op11_ranked_search, op12_periodic_runs, op13_hyperminhash)}
ORACLES = {"op1_source_mix": _SQL_MIX, "op3_exact_topk": _SQL_PRODUCTS, "op4_line_dedup": _SQL_LINES,
           "op11_ranked_search": _SQL_RANKED}
