"""The queries op1 to op13 and the pipeline, with the SQL that DuckDB can run against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import codes, jaccard, langid, lm, media, minhash, mixing, packing, pii, quality, ranked, substring, urlfilter
from quorumlake.llm.common import documents

def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), k=2, least=(80, 100))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality.judge(docs, carried=("doc_id",)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without a doc_id isn't held out: it trains."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    model = langid.train(docs.where(fold != 2))
    return langid.predict(docs, model).withColumn("held_out", fold == 2).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = lm.score(docs, train=F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir), keep_bytes=False)


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir), k=4, least=(85, 100))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.withColumn("codebooks_sha256", F.lit(codes.digest(books)))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash, op2_substring, op3_quality, op4_mixing, op5_pii, op6_packing, op7_urlfilter, op8_langid, op9_lm, op10_media, op11_jaccard, op12_codes, op13_ranked)}


# ---- SQL for DuckDB ------------------------------------------------------------------------------------------------

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
TEXT_SQL = "coalesce(text, '')"

OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS_SQL.format(f"translate({TEXT_SQL}, '{UPPER}', '{UPPER.lower()}')")} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, b AS node FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.node = e.a
), least AS (
  SELECT doc_id, min(node) AS node FROM reached GROUP BY doc_id
)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.node, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(l.node, s.doc_id) AS kept
FROM sets s LEFT JOIN least l ON s.doc_id = l.doc_id
"""

OP2_SQL = f"""
WITH words AS (
  SELECT doc_id, {WORDS_SQL.format(TEXT_SQL)} AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM words WHERE len(w) >= 20
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY md5(array_to_string(w[p : p + 19], ' ')) ORDER BY doc_id, p) AS r FROM windows
), gone AS (
  SELECT DISTINCT doc_id, p + unnest(range(20)) AS p FROM ranked WHERE r > 1
), placed AS (
  SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM words
), kept AS (
  SELECT placed.doc_id, string_agg(x, ' ' ORDER BY placed.p) AS t, count(*) AS n
  FROM placed LEFT JOIN gone ON placed.doc_id = gone.doc_id AND placed.p = gone.p WHERE gone.p IS NULL GROUP BY placed.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""

OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS_SQL.format(TEXT_SQL)})::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM by_source
), levels AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM weighed WINDOW before AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT coalesce(min_by(share, cap / weight), 0) AS level FROM (SELECT *, (total - cap_before) / (weights - weight_before) AS share FROM levels) WHERE share <= cap / weight
), rated AS (
  SELECT source, source_size, least(cap, weight * level) AS target, CASE WHEN source_size > 0 THEN least(cap, weight * level) / source_size ELSE 0 END AS rate FROM levels, water
)
SELECT doc_id, size, source_size, target,
  (size * least(3, floor(rate) + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 12))::BIGINT / {float(1 << 48)} < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""

OP7_SQL = f"""
WITH rules(verdict, host, path) AS (
  VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)}
), split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), fitting AS (
  SELECT page_id, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN {" OR ".join(f"p.host = '{h}' OR ends_with(p.host, '.{h}')" for h in urlfilter.BLOCKED_HOSTS)} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fitting f ON p.page_id = f.page_id
"""

OP11_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS_SQL.format(f"translate({TEXT_SQL}, '{UPPER}', '{UPPER.lower()}')")} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS c, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT c, len(s) AS n, unnest(s) AS x FROM classes
), shared AS (
  SELECT * FROM shingles WHERE x IN (SELECT x FROM shingles GROUP BY x HAVING count(*) > 1)
), links AS (
  SELECT a.c AS a, b.c AS b FROM shared a JOIN shared b ON a.x = b.x AND a.c < b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS c, b AS node FROM edges UNION SELECT r.c, e.b FROM reached r JOIN edges e ON r.node = e.a
), least AS (
  SELECT c, min(node) AS node FROM reached GROUP BY c
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(least(l.node, k.c), k.c, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes k ON list_sort(d.s) = k.s LEFT JOIN least l ON k.c = l.c
"""

OP12_ROUND = """
), near{r} AS MATERIALIZED (
  SELECT v.vec_id, v.part, min_by(b.entry, (d, b.entry)) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM places x JOIN book{r} b ON x.part = b.part AND x.place = b.place GROUP BY ALL
  ) v JOIN (SELECT DISTINCT part, entry FROM book{r}) b ON v.part = b.part AND v.entry = b.entry GROUP BY ALL
), book{next} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT n.part, n.entry, x.place, CASE WHEN sum(x.v) % count(*) < 0 THEN sum(x.v) // count(*) - 1 ELSE sum(x.v) // count(*) END AS v
    FROM near{r} n JOIN places x ON n.vec_id = x.vec_id AND n.part = x.part GROUP BY ALL
  ) m ON b.part = m.part AND b.entry = m.entry AND b.place = m.place"""

OP12_SQL = (
    """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), places AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (n // 8) AS part, (i - 1) % (n // 8) AS place, v FROM (SELECT vec_id, len(x) AS n, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY row_number() OVER (ORDER BY vec_id) <= 16
), book0 AS MATERIALIZED (
  SELECT part, entry, place, v FROM places JOIN firsts USING (vec_id)"""
    + "".join(OP12_ROUND.format(r=r, next=r + 1) for r in range(6))
    + OP12_ROUND.format(r=6, next=7).split("), book7")[0]
    + """), coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near6 GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) FROM book6) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
)

TERMS_SQL = r"regexp_extract_all(translate({}, '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH docs AS (
  SELECT doc_id, {TERMS_SQL.format(TEXT_SQL, UPPER, UPPER.lower())} AS t FROM documents
), sized AS (
  SELECT doc_id, len(t)::BIGINT AS n, t FROM docs WHERE len(t) > 0
), totals AS (
  SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sized
), occurring AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sized) GROUP BY ALL
), asked AS (
  SELECT DISTINCT item_id, unnest({TERMS_SQL.format(TEXT_SQL, UPPER, UPPER.lower())}) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM occurring, totals GROUP BY term, nn
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN occurring USING (term) JOIN weights USING (term), totals GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op2_substring": OP2_SQL, "op4_mixing": OP4_SQL, "op7_urlfilter": OP7_SQL, "op11_jaccard": OP11_SQL, "op12_codes": OP12_SQL, "op13_ranked": OP13_SQL}
