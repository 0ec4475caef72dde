"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, collocations, filter_audit, fingerprints, in_sql, line_dedup, minhash, mixing, pii, quality_bayes, quality_rules, sharding, toxicity, warc
from tessera.llm.common import documents, shared_folder, text_or_empty, words


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as the compacted store holds it, with the shard that it lies in."""
    store = sharding.shard(documents(spark, sf_dir), f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.delete_at_end()
    return store.placed().select("doc_id", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "shard")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(fingerprints.with_edited(documents(spark, sf_dir, "doc_id", "text")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.learn(docs, toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op6_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is a document's host; the language's part of it is its path."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    return quality_bayes.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    size = F.size(words(text_or_empty())).cast("long")
    taken, sizes, targets = mixing.mix(docs, size, F.array("source"), mixing.by_order())
    return mixing.with_targets(taken, sizes, targets)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir, "doc_id", "text")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    rules = quality_rules.learn(*quality_rules.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality_rules.SAMPLE))
    return quality_rules.judge(docs, rules)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir, "text", "lang"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back: all urls are looked up in the index, all places that it gives are read."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    archive = warc.write(pages, folder)
    kind = pages.schema["page_id"].dataType
    return archive.read(archive.find(pages), payload=False).select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return filter_audit.audit(filter_audit.histograms(filter_audit.masks(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_line_dedup": op2_line_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_minhash": op5_minhash,
    "op6_quality_bayes": op6_quality_bayes,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
    **in_sql.QUERIES,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
WITH rows AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), often AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::int) >= 10
)
SELECT doc_id, count(*)::bigint AS n_lines, (count(*) FILTER (WHERE often.key IS NOT NULL))::bigint AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.key = often.key GROUP BY doc_id, r
""",
    "op11_collocations": r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents
), line AS (
  SELECT lang, row_number() OVER () AS line, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece
), word AS (
  SELECT lang, line, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM line
), next AS (
  SELECT lang, w, lead(w) OVER here AS w2, lead(w, 2) OVER here AS w3 FROM word WINDOW here AS (PARTITION BY line ORDER BY place)
), f AS MATERIALIZED (
  SELECT lang, 1 AS words, w AS p, count(*)::hugeint AS f FROM next GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM next WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM next WHERE w3 IS NOT NULL GROUP BY ALL
), total AS (
  SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang
), candidate AS MATERIALIZED (
  SELECT lang, words, p, string_split(p, ' ') AS w, f AS a FROM f WHERE words > 1 AND f >= 10
), cut AS MATERIALIZED (
  SELECT lang, p, a, 1 AS k, w[1] AS first, array_to_string(w[2 :], ' ') AS rest FROM candidate
  UNION ALL SELECT lang, p, a, 2, array_to_string(w[1 : 2], ' '), w[3] FROM candidate WHERE words = 3
), lowest AS (
  SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.p = c.first JOIN f y ON y.lang = c.lang AND y.p = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, k) = 1
), outer_most AS (
  SELECT lang, p, max(a) AS outer_a FROM (SELECT lang, array_to_string(w[1 : 2], ' ') AS p, a FROM candidate WHERE words = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM candidate WHERE words = 3) GROUP BY lang, p
), kept AS (
  SELECT lang, p AS phrase, a, l, r, score FROM lowest LEFT JOIN outer_most USING (lang, p) WHERE outer_a IS NULL OR 100 * outer_a < 50 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::bigint AS rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n::bigint AS n, score::bigint AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
    # base32 as SQL: the digest's hex digits as bits, five of them for each sign
    "op12_warc": r"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS b FROM page
)
SELECT page_id, strlen(payload)::bigint AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(b, (5 * k + 1)::bigint, 1)::int + 8 * substr(b, (5 * k + 2)::bigint, 1)::int + 4 * substr(b, (5 * k + 3)::bigint, 1)::int + 2 * substr(b, (5 * k + 4)::bigint, 1)::int + substr(b, (5 * k + 5)::bigint, 1)::int)::bigint, 1)), '') AS payload_digest,
  CASE WHEN first < page_id OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to
FROM bits
""",
    "op13_filter_audit": r"""
WITH text AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), counted AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM text
), doc AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM counted
), label AS (
  SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), mask AS (
  SELECT part, a, b, c, d, e, a::int + b::int + c::int + d::int + e::int AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM doc LEFT JOIN label USING (doc_id) GROUP BY ALL
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), permutation AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS o FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), step AS (
  SELECT o AS filter_order, step, o[step] AS f, o[1 : step - 1] AS before FROM permutation, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), hit AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
    CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS own,
    (a AND contains(before, 'A')) OR (b AND contains(before, 'B')) OR (c AND contains(before, 'C')) OR (d AND contains(before, 'D')) OR (e AND contains(before, 'E')) AS gone
  FROM mask, step
), total AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM hit GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley FROM total
""",
    **in_sql.ORACLES,
}
