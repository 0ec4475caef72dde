"""Queries for those parts of operators' results that SQL can express, where it can't express the whole result.

Each runs its operator over the whole table and returns the columns that the
operator's own query derives them from: edited texts (fingerprints), sizes,
targets and words taken by source (mixing), base spans (personal data) and base
statistics (quality rules). Cases are the operators'; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fingerprints, mixing, pii, quality_rules
from tessera.llm.common import documents, text_or_empty, words


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited text of every document, as the fingerprints see it."""
    pairs = fingerprints.edited(documents(spark, sf_dir, "doc_id", "text"))
    return pairs.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


def mixing_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, target and words taken of each source, and whether no document is taken more than twice."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    size = F.size(words(text_or_empty())).cast("long")
    taken, sizes, targets = mixing.mix(docs, size, F.array("source"), mixing.by_order())
    # a row for each source on both sides
    by_source = taken.groupBy(F.col("sources")[0].alias("source")).agg(F.count("*").alias("n_docs"), F.sum("taken").alias("taken"), F.bool_and(F.col("taken").between(0, 2 * F.col("size"))).alias("within_twice"))
    wanted = spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "of string, source_size long, target double")
    return by_source.join(wanted, F.col("source").eqNullSafe(F.col("of"))).select("source", "n_docs", "source_size", "target", "taken", "within_twice")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document."""
    found = pii.digests(pii.find(documents(spark, sf_dir, "doc_id", "text")))
    return found.select("doc_id", *(f"n_{k}" for k in pii.BASE), "base_sha256")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of every document, and whether the base limits reject it."""
    stats = quality_rules.statistics(documents(spark, sf_dir, "doc_id", "text"))
    return stats.select("doc_id", *quality_rules.BASE, quality_rules.base_failed().alias("base_failed"))


QUERIES = {
    "edited_texts": edited_texts,
    "mixing_by_source": mixing_by_source,
    "pii_base_spans": pii_base_spans,
    "quality_statistics": quality_statistics,
}
ORACLES: dict[str, str] = {
    "edited_texts": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), after AS (
  SELECT doc_id, t, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next_t FROM d
)
SELECT doc_id, next_id, length(t)::bigint AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(next_t, 1, length(t) // 2)) AS edited_sha256 FROM after
""",
    # sources in the order of what a part of their weight may take at most: those that stop at it come first
    "mixing_by_source": r"""
WITH sized AS (
  SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), by_source AS (
  SELECT source, count(*) AS n_docs, sum(size)::bigint AS size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM by_source
), before AS (
  SELECT *, coalesce(sum(2 * size) OVER earlier, 0)::double AS spent, sum(w) OVER () - coalesce(sum(w) OVER earlier, 0) AS open_w, 1.5::double * sum(size) OVER () AS share
  FROM weighed WINDOW earlier AS (ORDER BY size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, (share - spent) * w > 2.0::double * size * open_w AS stops FROM before
), wanted AS (
  SELECT *, CASE WHEN stops THEN 2.0::double * size ELSE (share - coalesce(sum(2 * size) FILTER (WHERE stops) OVER (), 0)::double) * w / (sum(w) FILTER (WHERE NOT stops) OVER ())::double END AS target FROM stopped
)
SELECT source, n_docs::bigint AS n_docs, size AS source_size, target, round_even(target, 0)::bigint AS taken, true AS within_twice FROM wanted
""",
    # where a match starts: what was split off before it and the earlier matches
    "pii_base_spans": r"""
WITH kinds(no, kind) AS (
  VALUES (1, 'email'), (2, 'ip'), (3, 'card'), (4, 'phone')
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), matched AS (
  SELECT r, 1 AS no, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS s FROM doc WHERE contains(t, '@')
  UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), string_split_regex(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM doc
  UNION ALL SELECT r, 3, regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(t, '[0-9](?:[\x20-]?[0-9])+') FROM doc
  UNION ALL SELECT r, 4, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM doc
), each AS (
  SELECT r, no, unnest(m) AS m, unnest(s[1 : len(m)]) AS s, generate_subscripts(m, 1) AS k FROM matched WHERE len(m) > 0
), placed AS (
  SELECT r, no, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits, (sum(length(s) + length(m)) OVER (PARTITION BY r, no ORDER BY k))::bigint AS ends FROM each
), doubled AS (
  SELECT *, list_transform(range(0, length(digits)), lambda k: substr(digits, (length(digits) - k)::bigint, 1)::int * (1 + k % 2)) AS luhn FROM placed
), span AS (
  SELECT r, no, ends - length(m) AS starts, ends FROM doubled WHERE CASE no WHEN 1 THEN true WHEN 4 THEN length(digits) BETWEEN 8 AND 15
    WHEN 2 THEN list_max(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS hugeint), 256))) <= 255
    ELSE length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(luhn, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0 END
), joined AS (
  SELECT r, count(*) FILTER (WHERE no = 1) AS n1, count(*) FILTER (WHERE no = 2) AS n2, count(*) FILTER (WHERE no = 3) AS n3, count(*) FILTER (WHERE no = 4) AS n4,
    string_agg(kind || ':' || starts || ':' || ends, ',' ORDER BY no, starts) AS spans FROM span JOIN kinds USING (no) GROUP BY r
)
SELECT doc_id, coalesce(n1, 0)::bigint AS n_email, coalesce(n2, 0)::bigint AS n_ip, coalesce(n3, 0)::bigint AS n_card, coalesce(n4, 0)::bigint AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM doc LEFT JOIN joined USING (r)
""",
    "quality_statistics": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc
), word AS (
  SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM found
), windows AS (
  SELECT r, place, w || ' ' || lead(w) OVER here || ' ' || lead(w, 2) OVER here AS three FROM word WINDOW here AS (PARTITION BY r ORDER BY place)
), twice AS (
  SELECT r, place FROM windows WHERE three IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, three) > 1
), inside AS (
  SELECT r, count(DISTINCT place + step) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS step) GROUP BY r
)
SELECT doc_id, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols,
  (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(n, 0)::bigint AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM found LEFT JOIN inside USING (r)
""",
}
