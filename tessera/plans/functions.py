"""Further functions, predicates, joins and aggregates as SQL; approximate aggregates come as whether their stated error bound holds."""

from __future__ import annotations

#: Text that both engines run alike.
SAME: dict[str, str] = {
    "ilike_predicate": "SELECT p_partkey FROM part WHERE p_brand ILIKE 'BRAND#2%' AND p_type NOT ILIKE '%S'",
    "group_by_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "order_by_all": "SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders ORDER BY ALL LIMIT 25",
    "nulls_first_and_last": "SELECT 'first' AS side, k, x FROM (SELECT c_custkey AS k, nullif(c_nationkey, 7) AS x FROM customer ORDER BY x NULLS FIRST, k LIMIT 30) AS a UNION ALL SELECT 'last', k, x FROM (SELECT c_custkey AS k, nullif(c_nationkey, 24) AS x FROM customer ORDER BY x DESC NULLS LAST, k LIMIT 30) AS b UNION ALL SELECT 'descending first', k, x FROM (SELECT c_custkey AS k, nullif(c_nationkey, 24) AS x FROM customer ORDER BY x DESC NULLS FIRST, k LIMIT 30) AS c",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 3",
    "natural_join": "SELECT a, b, k FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) AS n NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) AS r",
    "theta_join": "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey * 3",
    "sum_distinct": "SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS bigint) AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "mode_and_any_value": "SELECT l_returnflag, mode(l_linestatus) AS m, any_value(l_returnflag) AS a FROM (SELECT * FROM lineitem WHERE l_linestatus = 'O' OR l_quantity > 40) AS t GROUP BY l_returnflag",
    "regressions": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_returnflag",
    "correlated_non_equi": "SELECT n_nationkey, (SELECT count(*) FROM region WHERE r_regionkey > n_regionkey) AS above FROM nation",
    "bit_counts": "SELECT p_partkey, CAST(bit_count(p_partkey) AS int) AS b, p_size & 6 AS a, p_size | 8 AS o FROM part",
}

#: (Spark's text, the other engine's text) where they differ.
PAIRS: dict[str, tuple[str, str]] = {
    "rlike_predicate": ("SELECT p_partkey FROM part WHERE p_name RLIKE '^[a-m].*[0-9a-z]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*[0-9a-z]$')"),
    "like_any": ("SELECT p_partkey FROM part WHERE p_brand LIKE ANY ('%1', '%22')", "SELECT p_partkey FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%22'"),
    "try_divide": ("SELECT o_orderkey, try_divide(o_totalprice, o_custkey % 3) AS q, try_divide(nullif(o_custkey, 7), o_orderkey % 2) AS i FROM orders", "SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice / (o_custkey % 3) END AS q, CASE WHEN o_orderkey % 2 <> 0 THEN nullif(o_custkey, 7)::double / (o_orderkey % 2) END AS i FROM orders"),
    "pipe_syntax": ("FROM orders |> WHERE o_orderstatus = 'P' |> AGGREGATE count(*) AS n GROUP BY o_orderpriority |> SELECT o_orderpriority, n", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"),
    "exact_percentiles": (
        "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS c, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS d FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS c, quantile_disc(l_quantity, 0.25) AS d FROM lineitem GROUP BY l_returnflag",
    ),
    # population moments, as Spark's skewness and kurtosis are
    "skewness_kurtosis": (
        "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS s, round(kurtosis(l_extendedprice), 6) AS k FROM lineitem GROUP BY l_returnflag",
        """SELECT l_returnflag, round(avg(pow(l_extendedprice - m, 3)) / pow(avg(pow(l_extendedprice - m, 2)), 1.5), 6) AS s, round(avg(pow(l_extendedprice - m, 4)) / pow(avg(pow(l_extendedprice - m, 2)), 2) - 3, 6) AS k
FROM (SELECT *, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY l_returnflag""",
    ),
    "listagg_ordered": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "array_agg_sizes": ("SELECT o_custkey, size(array_agg(o_orderkey)) AS n, size(collect_set(o_orderstatus)) AS kinds FROM orders GROUP BY o_custkey", "SELECT o_custkey, len(array_agg(o_orderkey))::int AS n, count(DISTINCT o_orderstatus)::int AS kinds FROM orders GROUP BY o_custkey"),
    # ties are told apart by the key
    "min_by_max_by": (
        "SELECT o_custkey, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS low, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY o_custkey",
    ),
    # exact counts apart: beside a DISTINCT, Spark would hold a sketch for each distinct value
    "approx_distinct_bound": (
        """WITH about AS (SELECT l_linestatus, approx_count_distinct(l_orderkey, 0.02) AS d FROM lineitem GROUP BY l_linestatus),
exact AS (SELECT l_linestatus, count(l_orderkey) AS n FROM (SELECT DISTINCT l_linestatus, l_orderkey FROM lineitem) GROUP BY l_linestatus)
SELECT a.l_linestatus, abs(d - n) <= 0.08 * n AS near FROM about a JOIN exact e ON a.l_linestatus <=> e.l_linestatus""",
        "SELECT l_linestatus, true AS near FROM lineitem GROUP BY l_linestatus",
    ),
    # the approximate value's rank lies within one in a thousand of the rank asked for
    "approx_percentile_bound": (
        """WITH found AS (SELECT l_linestatus AS s, approx_percentile(l_extendedprice, 0.9, 1000) AS p FROM lineitem GROUP BY l_linestatus)
SELECT s, abs(avg(CASE WHEN l_extendedprice <= p THEN 1.0D ELSE 0.0D END) - 0.9) <= 0.005 AS near FROM lineitem JOIN found ON l_linestatus = s GROUP BY s""",
        "SELECT l_linestatus AS s, true AS near FROM lineitem GROUP BY l_linestatus",
    ),
    "sketch_bounds": (
        """WITH about AS (SELECT l_linestatus, hll_sketch_estimate(hll_sketch_agg(l_orderkey, 12)) AS h, theta_sketch_estimate(theta_sketch_agg(l_orderkey, 12)) AS t,
kll_sketch_get_quantile_double(kll_sketch_agg_double(l_quantity), 0.5D) AS q, median(l_quantity) AS m, length(hex(count_min_sketch(l_suppkey, 0.01D, 0.95D, 1))) > 0 AS cms FROM lineitem GROUP BY l_linestatus),
exact AS (SELECT l_linestatus, count(l_orderkey) AS n FROM (SELECT DISTINCT l_linestatus, l_orderkey FROM lineitem) GROUP BY l_linestatus)
SELECT a.l_linestatus, abs(h - n) <= 0.1 * n AS hll, abs(t - n) <= 0.1 * n AS theta, abs(q - m) <= 3 AS kll, cms FROM about a JOIN exact e ON a.l_linestatus <=> e.l_linestatus""",
        "SELECT l_linestatus, true AS hll, true AS theta, true AS kll, true AS cms FROM lineitem GROUP BY l_linestatus",
    ),
    # the bins hold all rows
    "histogram_mass": ("SELECT l_returnflag, CAST(aggregate(histogram_numeric(l_quantity, 10), CAST(0 AS double), (t, b) -> t + b.y) AS bigint) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    # a sample of a fixed seed has about its share of the rows
    "sampling_share": ("SELECT abs(count(*) / (SELECT count(*) FROM lineitem) - 0.2) <= 0.05 AS near FROM lineitem TABLESAMPLE (20 PERCENT) REPEATABLE (7)", "SELECT true AS near"),
    "hashes_and_digests": (
        "SELECT c_custkey, sha2(c_name, 256) AS sha, crc32(c_name) BETWEEN 0 AND 4294967295 AS crc, xxhash64(c_name) = xxhash64(c_name) AND hash(c_name) = hash(c_name) AS same, regexp_extract(c_name, '([0-9]+)', 1) AS digits FROM customer",
        "SELECT c_custkey, sha256(c_name) AS sha, true AS crc, true AS same, regexp_extract(c_name, '([0-9]+)', 1) AS digits FROM customer",
    ),
    "soundex_codes": ("SELECT c_custkey, soundex(c_mktsegment) AS code, soundex(nullif(c_mktsegment, 'BUILDING')) AS n FROM customer", "SELECT c_custkey, code, CASE WHEN c_mktsegment <> 'BUILDING' THEN code END AS n FROM (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'MACHINERY' THEN 'M256' END AS code FROM customer)"),
    "url_parts": ("SELECT page_id, parse_url(url, 'HOST') AS host, parse_url(url, 'PATH') AS path, parse_url(url, 'QUERY') AS query FROM pages", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '[?]([^#]*)', 1) END AS query FROM pages"),
    "date_arithmetic": (
        "SELECT o_orderkey, datediff(CAST(o_orderdate AS date), DATE'1995-01-01') AS days, add_months(CAST(o_orderdate AS date), 2) AS later, make_date(year(o_orderdate), 2, 3) AS made, date_format(o_orderdate, 'yyyy-MM') AS ym, trunc(CAST(o_orderdate AS date), 'YEAR') AS first, timestampdiff(DAY, TIMESTAMP_NTZ'1995-01-01 00:00:00', o_orderdate) AS td, months_between(last_day(CAST(o_orderdate AS date)), DATE'1995-01-31') AS mb FROM orders",
        "SELECT o_orderkey, datediff('day', DATE '1995-01-01', o_orderdate::date)::int AS days, (o_orderdate::date + INTERVAL 2 MONTH)::date AS later, make_date(year(o_orderdate), 2, 3) AS made, strftime(o_orderdate, '%Y-%m') AS ym, date_trunc('year', o_orderdate)::date AS first, datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS td, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::double AS mb FROM orders",
    ),
    # years of five digits have a plus sign in Spark's text; a timestamp ends 106,751,991 days after 1970, a date doesn't
    "timestamps_parsed": ("SELECT o_orderkey, CAST(try_to_timestamp(s, 'yyyy-MM-dd HH:mm') AS timestamp_ntz) AS t, unix_timestamp(try_to_timestamp(s, 'yyyy-MM-dd HH:mm')) AS u, ltrim('+', CASE WHEN o_orderkey BETWEEN -106751991 AND 106751991 THEN from_unixtime(o_orderkey * 86400, 'yyyy-MM-dd') ELSE CAST(date_from_unix_date(CAST(o_orderkey AS int)) AS string) END) AS f FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no date' WHEN o_orderkey % 5 < 4 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm') END AS s FROM orders)", "SELECT o_orderkey, try_strptime(s, '%Y-%m-%d %H:%M') AS t, epoch(try_strptime(s, '%Y-%m-%d %H:%M'))::bigint AS u, strftime(DATE '1970-01-01' + o_orderkey::int, '%Y-%m-%d') AS f FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no date' WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS s FROM orders)"),
    "more_math": ("SELECT p_partkey, round(log10(p_retailprice), 9) AS l, factorial(p_size % 10) AS f, pmod(p_size - 30, 7) AS pm, CAST(bround(p_size / 2.0, 0) AS bigint) AS br, CAST(round(p_size / 2.0, 0) AS bigint) AS up FROM part", "SELECT p_partkey, round(log10(p_retailprice), 9) AS l, factorial(p_size % 10)::bigint AS f, ((p_size - 30) % 7 + 7) % 7 AS pm, (p_size // 2 + (p_size % 2) * ((p_size // 2) % 2))::bigint AS br, (p_size // 2 + p_size % 2)::bigint AS up FROM part"),
    "array_lookups": ("SELECT vec_id, element_at(embedding, 3) AS third, array_contains(array(1, 2, label), 2) AS has, slice(array(1, 2, 3, label), 2, 2)[1] AS s, size(sequence(1, label + 1)) AS n FROM embeddings", "SELECT vec_id, embedding[3] AS third, list_contains([1, 2, label], 2) AS has, 3 AS s, label + 1 AS n FROM embeddings"),
    "exploded_places": ("SELECT p_partkey, pos, word FROM part LATERAL VIEW posexplode(split(p_name, ' ')) AS pos, word", "SELECT p_partkey, (generate_subscripts(string_split(p_name, ' '), 1) - 1)::int AS pos, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "maps_and_structs": (
        "SELECT c_custkey, map('a', c_nationkey, 'b', 1)['a'] AS a, size(map_keys(map_from_arrays(array('x', 'y'), array(1, 2)))) AS n, named_struct('k', c_nationkey, 's', c_mktsegment).s AS s, str_to_map('p:1,q:2')['q'] AS q FROM customer",
        "SELECT c_custkey, c_nationkey AS a, 2 AS n, c_mktsegment AS s, '2' AS q FROM customer",
    ),
    "parsed_formats": (
        "SELECT event_id, from_json(props, 'k int').k AS k, from_csv(concat(event_id, ',', event_type), 'a bigint, b string').b AS b, xpath_string(concat('<e><t>', event_type, '</t></e>'), 'e/t') AS x, variant_get(parse_json(props), '$.k', 'int') AS v, schema_of_json('{\"k\":1}') AS s FROM events",
        "SELECT event_id, json_extract_string(props, '$.k')::int AS k, event_type AS b, event_type AS x, json_extract_string(props, '$.k')::int AS v, 'STRUCT<k: BIGINT>' AS s FROM events",
    ),
    # the limit takes its order from the sort right below it: with a select between them Spark numbers the rows as they arrive
    "correlated_latest": (
        "SELECT c_custkey, (SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1)) AS latest FROM customer",
        "SELECT c_custkey, k AS latest FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (-epoch(o_orderdate), o_orderkey)) AS k FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    ),
    "shuffle_hash_join": ("SELECT /*+ SHUFFLE_HASH(o) */ o_orderpriority, count(*) AS n FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"),
    # a page's text: scripts, styles, comments and tags go, the five named entities are read
    "html_to_text": (
        r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' '), '<[^>]*>', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r]+', ' '))) AS digest FROM pages""",
        r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))) AS digest FROM pages""",
    ),
}
