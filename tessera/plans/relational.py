"""Relational queries as SQL that Catalyst plans; the independent engine runs the same text unless another is given."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import functions
from tessera.sources.tables import TABLES, table

MONEY = "CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double)"

#: Text that both engines run alike. Sums of money are decimals, so that the order of rows doesn't matter.
SAME: dict[str, str] = {
    "pricing_summary": f"""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS decimal(18,2))) AS double) AS sum_qty, {MONEY} AS sum_price,
  CAST(sum(CAST(CAST(l_extendedprice AS decimal(18,2)) * (1 - CAST(l_discount AS decimal(18,2))) AS decimal(18,4))) AS double) AS sum_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "region_revenue_six_way": f"""
SELECT n_name, {MONEY} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""",
    # projection, filter, predicates
    "project_filter": "SELECT l_orderkey, l_partkey, l_quantity * 2 AS twice, l_tax FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.04",
    "like_predicates": "SELECT p_partkey, p_name FROM part WHERE p_brand LIKE 'Brand#1%' OR lower(p_type) LIKE '%ss' OR p_name LIKE '_a%'",
    "in_between_null": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority IS NOT NULL",
    "conditionals": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_acctbal, 0.0) AS up, least(c_acctbal, 100.0) AS down FROM customer",
    "null_safe_equality": "SELECT c_custkey, a IS NOT DISTINCT FROM b AS same, a = b AS equal FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS a, nullif(c_mktsegment, CASE WHEN c_nationkey < 12 THEN 'BUILDING' ELSE 'MACHINERY' END) AS b FROM customer) AS t",
    "try_casts": "SELECT c_custkey, try_cast(c_mktsegment AS int) AS i, try_cast(split_part(c_name, '#', 2) AS int) AS n, try_cast(CASE WHEN c_nationkey % 3 = 0 THEN concat(CAST(c_nationkey AS string), '.5') ELSE c_mktsegment END AS double) AS d, try_cast(nullif(c_mktsegment, 'BUILDING') AS date) AS day FROM customer",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "qualify_by_subquery": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) AS t WHERE k = 1",
    # joins
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "anti_join": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "left_join": "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "right_join": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "full_join": "SELECT a.k AS ak, b.k AS bk, o_orderkey, c_name FROM (SELECT nullif(o_custkey % 60, 7) AS k, o_orderkey FROM orders) AS a FULL OUTER JOIN (SELECT nullif(c_custkey, 9) AS k, c_name FROM customer WHERE c_custkey % 3 = 0) AS b ON a.k = b.k",
    "null_keys_dont_match": "SELECT a.k, o_orderkey, c_name FROM (SELECT nullif(o_custkey, 7) AS k, o_orderkey FROM orders) AS a JOIN (SELECT nullif(c_custkey, 9) AS k, c_name FROM customer) AS b ON a.k = b.k",
    "not_in_with_null": "SELECT 'with null' AS list, c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 10) UNION ALL SELECT 'without', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 10 AND n_nationkey <> 3) UNION ALL SELECT 'null asks', c_custkey FROM customer WHERE nullif(c_nationkey, 20) NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 10)",
    "using_join": "SELECT r_name, n_name FROM (SELECT n_regionkey AS k, n_name FROM nation) AS n JOIN (SELECT r_regionkey AS k, r_name FROM region) AS r USING (k)",
    "theta_join_small": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "self_join_pairs": "SELECT a.o_custkey, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey",
    # aggregation
    "counts_distinct_filter": "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders GROUP BY o_orderpriority",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS int) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "cube_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup_shipping": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50",
    "moments": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cv FROM lineitem GROUP BY l_returnflag",
    "booleans_and_bits": "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS every_one, bool_or(o_totalprice > 400000) AS any_one, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx FROM orders GROUP BY o_orderstatus",
    "aggregate_of_nothing": "SELECT count(*) AS n, sum(l_linenumber) IS NULL AS no_sum, max(l_tax) AS top FROM lineitem WHERE l_quantity < 0",
    "null_group_key": "SELECT k, count(*) AS n, count(x) AS xs, max(x) AS top FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS k, nullif(c_nationkey, 5) AS x FROM customer) AS t GROUP BY k",
    # windows
    "window_ranks": "SELECT o_orderkey, CAST(row_number() OVER w AS bigint) AS rn, CAST(rank() OVER w AS bigint) AS rk, CAST(dense_rank() OVER w AS bigint) AS dr, CAST(ntile(4) OVER w AS bigint) AS nt, cume_dist() OVER w AS cd, percent_rank() OVER w AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    "window_lag_lead": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
    "window_rows_frame": "SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "window_range_interval": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS recent FROM events",
    "window_nth": "SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_order FROM orders",
    # GROUPS frame: ranks, then a range over them
    "window_groups_frame": "SELECT l_orderkey, n, sum(n) OVER (PARTITION BY l_orderkey ORDER BY k RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM (SELECT l_orderkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS k, l_linenumber AS n FROM lineitem) AS t".replace("sum(n) OVER", "CAST(sum(n) OVER").replace("CURRENT ROW) AS near", "CURRENT ROW) AS bigint) AS near"),
    "window_exclude_current": "SELECT event_id, count(*) OVER w - 1 AS others FROM events WINDOW w AS (PARTITION BY user_id, event_type)",
    # sort, limit, top-k
    "sort_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5",
    "topk_per_group": "SELECT l_suppkey, l_orderkey, l_extendedprice, CAST(k AS bigint) AS k FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) AS t WHERE k <= 3",
    "distinct_on": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events) AS t WHERE k = 1",
    # set operations
    "union_distinct": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    "union_all": "SELECT l_returnflag AS f FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT o_orderstatus FROM orders WHERE o_totalprice > 400000",
    "intersect_distinct": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "intersect_all": "SELECT l_linenumber AS k FROM lineitem WHERE l_quantity > 45 INTERSECT ALL SELECT CAST(p_size AS int) FROM part",
    "except_distinct": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "except_all": "SELECT o_orderstatus AS s FROM orders EXCEPT ALL SELECT l_linestatus FROM lineitem WHERE l_quantity > 49",
    "recursive_turns": "WITH RECURSIVE walk(conv_id, turn, said, chars) AS (SELECT conv_id, turn, CAST(role AS string), CAST(length(text) AS bigint) FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, concat(w.said, ' ', c.role), w.chars + length(c.text) FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1) SELECT conv_id, turn, said, chars FROM walk",
    # subqueries
    "scalar_subquery": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "correlated_scalar": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "exists_non_equi": "SELECT a.o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_totalprice > a.o_totalprice * 10)",
    "cte_reused": "WITH spent AS (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS double) AS s FROM orders GROUP BY o_custkey) SELECT a.k, a.s FROM spent a WHERE a.s > (SELECT avg(s) * 2 FROM spent)",
    # scalar functions
    "string_functions": "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 3, 4) AS s, CAST(length(c_name) AS int) AS n, reverse(c_name) AS r, replace(c_name, '0', 'o') AS z, lpad(c_mktsegment, 12, '*') AS l, concat_ws('-', c_name, c_mktsegment) AS c, trim('  x ') AS t, split_part(c_name, '#', 2) AS p, md5(c_name) AS m, CAST(levenshtein(c_name, c_mktsegment) AS int) AS d, CAST(ascii(c_name) AS int) AS a, repeat('ab', 2) AS ab FROM customer",
    "math_functions": "SELECT p_partkey, round(ln(p_retailprice), 9) AS ln, round(sqrt(p_retailprice), 9) AS rt, round(power(p_size, 2), 6) AS p2, abs(10 - p_size) AS ab, p_size % 7 AS md, CAST(sign(p_size - 25) AS int) AS sg, CAST(floor(p_retailprice) AS bigint) AS fl, CAST(ceil(p_retailprice) AS bigint) AS ce, round(exp(p_size / 50.0), 9) AS ex FROM part",
    "date_functions": "SELECT o_orderkey, CAST(year(o_orderdate) AS int) AS y, CAST(month(o_orderdate) AS int) AS m, CAST(day(o_orderdate) AS int) AS d, CAST(quarter(o_orderdate) AS int) AS q, CAST(o_orderdate AS date) AS day, CAST(date_trunc('month', o_orderdate) AS date) AS first, last_day(CAST(o_orderdate AS date)) AS last, CAST(weekofyear(o_orderdate) AS int) AS w FROM orders",
    # text and conversations
    "exact_copies": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1",
    "label_rates": "SELECT source, count(*) AS n, count(l.doc_id) AS known, CAST(sum(l.toxic) AS bigint) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source",
    "pages_by_host": "SELECT split_part(split_part(url, '//', 2), '/', 1) AS host, count(*) AS n, CAST(max(length(html)) AS bigint) AS longest FROM pages GROUP BY split_part(split_part(url, '//', 2), '/', 1)",
}

#: (Spark's text, the other engine's text) where they differ.
PAIRS: dict[str, tuple[str, str]] = {
    "percentiles": (
        "SELECT l_returnflag, median(l_quantity) AS md, percentile(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, median(l_quantity) AS md, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag",
    ),
    "list_aggregate": (
        "SELECT o_custkey, array_join(transform(array_sort(collect_list(o_orderkey)), x -> CAST(x AS string)), ',') AS keys FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey",
    ),
    "last_known_value": (
        "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts) AS v FROM events",
        "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS v FROM events",
    ),
    "json_fields": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS int) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS int) AS k FROM events",
    ),
    "higher_order": (
        "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS positive, exists(embedding, x -> x > 0.3) AS any_large, CAST(round(aggregate(transform(embedding, x -> CAST(x AS double) * x), CAST(0 AS double), (a, x) -> a + x), 5) AS double) AS norm FROM embeddings",
        "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::int AS positive, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_large, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 5) AS norm FROM embeddings",
    ),
    "explode_words": (
        "SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM part) GROUP BY word",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word",
    ),
    # the limit takes its order from the sort right below it: with a select between them Spark numbers the rows as they arrive
    "lateral_top2": (
        "SELECT c_custkey, o_orderkey FROM customer JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)",
        "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) ON o_custkey = c_custkey AND k <= 2",
    ),
    "pivot_status": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1",
    ),
    "unpivot_prices": (
        "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem) UNPIVOT (v FOR what IN (l_quantity, l_extendedprice))",
        "SELECT l_orderkey, l_linenumber, 'l_quantity' AS what, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem",
    ),
    "tumbling_windows": (
        "SELECT CAST(window.start AS timestamp_ntz) AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type",
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    ),
    "session_windows": (
        "SELECT user_id, CAST(session_window.start AS timestamp_ntz) AS start, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')",
        "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s",
    ),
    "turns_assembled": (
        "SELECT conv_id, md5(array_join(transform(array_sort(collect_list(struct(turn, role, text))), x -> x.role || ': ' || x.text), '\\n')) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id",
        "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id",
    ),
    "benchmark_overlap": (
        """WITH grams AS (SELECT doc_id AS id, explode(transform(sequence(0, greatest(size(w) - 5, 0)), i -> array_join(slice(w, i + 1, 5), ' '))) AS g FROM (SELECT doc_id, split(text, ' ') AS w FROM documents)),
items AS (SELECT item_id, explode(transform(sequence(0, greatest(size(w) - 5, 0)), i -> array_join(slice(w, i + 1, 5), ' '))) AS g FROM (SELECT item_id, split(text, ' ') AS w FROM benchmark))
SELECT DISTINCT id AS doc_id, item_id FROM grams JOIN items ON grams.g = items.g""",
        """WITH grams AS (SELECT doc_id AS id, unnest(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS g FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
items AS (SELECT item_id, unnest(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS g FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))
SELECT DISTINCT id AS doc_id, item_id FROM grams JOIN items ON grams.g = items.g""",
    ),
}


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the SQL text over the tables that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


SAME |= functions.SAME
PAIRS |= functions.PAIRS
QUERIES = {name: query(text) for name, text in SAME.items()} | {name: query(pair[0]) for name, pair in PAIRS.items()}
ORACLES = dict(SAME) | {name: pair[1] for name, pair in PAIRS.items()}
