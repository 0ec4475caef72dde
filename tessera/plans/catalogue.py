"""Named queries over the relational tables, each with the SQL an independent engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import html, user
from tessera.operators import excluded, joins, samples, sketches, vectors
from tessera.plans import frames, relational
from tessera.sources import formats
from tessera.sources.scratch import written
from tessera.sources.tables import table
from tessera.streaming import arrivals
from tessera.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = relational.QUERIES | formats.QUERIES | user.QUERIES | streams.QUERIES | arrivals.QUERIES | frames.QUERIES
ORACLES: dict[str, str] = relational.ORACLES | formats.ORACLES | user.ORACLES | streams.ORACLES | arrivals.ORACLES | frames.ORACLES


def customer_revenue_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each customer's lines, the ten highest."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    # decimals add up to the same total in any order of the rows
    revenue = F.sum((F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))).cast("decimal(18,4)"))
    per_customer = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(revenue.cast("double").alias("revenue"))
    top = per_customer.orderBy(F.desc("revenue"), "o_custkey").limit(10)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return top.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "revenue")


QUERIES["customer_revenue_top10"] = customer_revenue_top10
ORACLES["customer_revenue_top10"] = """
SELECT c_custkey, c_name, revenue FROM (
  SELECT o_custkey, sum((l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(18,2)))::decimal(18,4))::double AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey ORDER BY 2 DESC, 1 LIMIT 10
) JOIN customer ON o_custkey = c_custkey
"""


def asof_purchase_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view before it."""
    events = table(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.asof_in_slices(purchases, views, ["user_id"], "ts", "view_id", 86_400).select("event_id", "view_id_asof")


QUERIES["asof_purchase_view"] = asof_purchase_view
ORACLES["asof_purchase_view"] = """
SELECT p.event_id, v.event_id AS view_id_asof FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
"""


def range_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors at most two minutes apart, whoever they are of."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    purchases = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("at").alias("a"))
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error"), F.col("at").alias("b"))
    return joins.within_range(purchases, errors, "a", "b", 120).select("purchase", "error")


QUERIES["range_join_events"] = range_join_events
ORACLES["range_join_events"] = """
SELECT p.event_id AS purchase, e.event_id AS error FROM events p JOIN events e
ON abs(floor(epoch(p.ts)) - floor(epoch(e.ts))) <= 120 WHERE p.event_type = 'purchase' AND e.event_type = 'error'
"""


def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by nation of their supplier, with the hot suppliers spread."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return joins.salted(lines, suppliers, "k").groupBy("s_nationkey").agg(F.count("*").alias("n"))


QUERIES["salted_join"] = salted_join
ORACLES["salted_join"] = "SELECT s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey"


def upsert_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after those in debt are set to zero and the buildings' are deleted."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = customer.filter("c_acctbal < 0 OR c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(0.0))
    return joins.upsert(customer, changes, ["c_custkey"], F.col("c_mktsegment") == "BUILDING")


QUERIES["upsert_balances"] = upsert_balances
ORACLES["upsert_balances"] = "SELECT c_custkey, greatest(c_acctbal, 0.0::double) AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations under each other, columns by name, absent ones null."""
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return regions.unionByName(nations, allowMissingColumns=True)


QUERIES["union_by_name"] = union_by_name
ORACLES["union_by_name"] = "SELECT r_name AS name, r_regionkey, n_nationkey FROM region LEFT JOIN (SELECT NULL::int AS n_nationkey) ON true UNION ALL SELECT n_name, NULL, n_nationkey FROM nation"


def overlap_sessions_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (half an hour without an event ends one) and the hours with errors that they reach into."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sessions = events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first"), F.max("ts").alias("last")).select("user_id", "first", "last").withColumns({"a": micros("first"), "b": micros("last")})
    hours = events.filter("event_type = 'error'").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("errors")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "errors")
    # the hour's last microsecond still belongs to it
    hours = hours.withColumn("c", micros("hour")).withColumn("d", F.col("c") + 3_599_999_999)
    return joins.overlapping(sessions, hours, ("a", "b"), ("c", "d"), 60_000_000.0).select("user_id", "first", "hour", "errors")


QUERIES["overlap_sessions_errors"] = overlap_sessions_errors
ORACLES["overlap_sessions_errors"] = """
WITH sessions AS (
  SELECT user_id, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s
), hours AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1
)
SELECT user_id, first, hour, errors FROM sessions JOIN hours ON first < hour + INTERVAL 1 HOUR AND hour <= last
"""


def overlap_own_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of ten days from an order on meet the years' quarters: long spans against short ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("a")).withColumn("b", F.col("a") + 9)
    day = F.col("o_orderdate").cast("date")
    quarters = table(spark, sf_dir, "orders").select(F.date_trunc("quarter", day).cast("date").alias("quarter")).distinct()
    quarters = quarters.withColumns({"c": F.unix_date("quarter"), "d": F.unix_date(F.add_months("quarter", 3)) - 1})
    return joins.overlapping(orders, quarters, ("a", "b"), ("c", "d"), 8.0).groupBy("quarter").agg(F.count("*").alias("n"))


QUERIES["overlap_own_orders"] = overlap_own_orders
ORACLES["overlap_own_orders"] = """
WITH quarters AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::date AS quarter FROM orders)
SELECT quarter, count(*) AS n FROM orders JOIN quarters ON o_orderdate::date < (quarter + INTERVAL 3 MONTH)::date AND o_orderdate::date + 9 >= quarter GROUP BY quarter
"""


def vector_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of each whose id is divisible by 20, of all pairs."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest_of_all(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding").withColumn("likeness", F.round("likeness", 5))


QUERIES["vector_top1"] = vector_top1
ORACLES["vector_top1"] = "SELECT q, arg_max(v, (s, -v)) AS nearest, round(max(s), 5) AS likeness FROM (SELECT a.vec_id AS q, b.vec_id AS v, list_inner_product(a.embedding::double[], b.embedding::double[]) AS s FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id) GROUP BY q"


def vector_index_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of each whose id is divisible by 20, by the index of all rows; ``vector_top1`` has the exact answer."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vectors.build(rows, "vec_id", "embedding")
    return index.search(rows.filter("vec_id % 20 = 0"), "vec_id", "embedding").select("q", "nearest", F.round("likeness", 5).alias("likeness"))


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds a vector as near as the exact search's for nine in ten queries or more."""
    exact = QUERIES["vector_top1"](spark, sf_dir).select("q", F.col("likeness").alias("best"))
    found = exact.join(vector_index_top1(spark, sf_dir), "q", "left")
    return found.agg((F.avg((F.coalesce("likeness", F.lit(-2.0)) >= F.col("best")).cast("double")) >= 0.9).alias("near"))


QUERIES |= {"vector_index_top1": vector_index_top1, "vector_index_recall": vector_index_recall}
ORACLES["vector_index_recall"] = "SELECT true AS near"


def sample_per_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty orders of each priority, the same on every run."""
    return samples.stratified(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], 40, seed=7).select("o_orderpriority", "o_orderkey")


def sample_by_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many orders of each status as are asked for."""
    return samples.stratified(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey"], {"F": 100, "P": 25}, seed=1).select("o_orderstatus", "o_orderkey")


def sample_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders of each status, to the row."""
    return samples.shares(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey"], 0.1, seed=3).select("o_orderstatus", "o_orderkey")


QUERIES |= {"sample_per_priority": sample_per_priority, "sample_by_sizes": sample_by_sizes, "sample_shares": sample_shares}
ORACLES |= {
    "sample_per_priority": "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey)) <= 40",
    "sample_by_sizes": "SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('1|' || o_orderkey)) <= CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 25 ELSE 0 END",
    "sample_shares": "SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('3|' || o_orderkey)) <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.1)",
}


def extremes_query(by: str, exclude: str, frame: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Dearest and cheapest order of the frame, the current row's peers left out."""
        return excluded.extremes(table(spark, sf_dir, "orders"), [by], "o_orderdate", "o_totalprice", exclude, frame).select("o_orderkey", "x_max", "x_min")

    return run


def extremes_sql(by: str, exclude: str, frame: str) -> str:
    reach = {"all": "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "so_far": "UNBOUNDED PRECEDING AND CURRENT ROW", "from_here": "CURRENT ROW AND UNBOUNDED FOLLOWING"}[frame]
    return f"SELECT o_orderkey, max(o_totalprice) OVER w AS x_max, min(o_totalprice) OVER w AS x_min FROM orders WINDOW w AS (PARTITION BY {by} ORDER BY o_orderdate RANGE BETWEEN {reach} EXCLUDE {exclude})"


for _name, _of in {"exclude_group_extremes": ("o_orderstatus", "GROUP", "all"), "exclude_ties_extremes": ("o_orderpriority", "TIES", "so_far"), "exclude_current_extremes": ("o_custkey", "CURRENT ROW", "from_here")}.items():
    QUERIES[_name], ORACLES[_name] = extremes_query(*_of), extremes_sql(*_of)


def day_of(column: str) -> Column:
    return F.col(column).cast("date")


def sketch_store_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each run of days up to a day, from sketches of single days that are stored and united: whether both estimates lie within five in a hundred."""
    events = table(spark, sf_dir, "events").select("ts", "user_id")
    days = written(sketches.distinct_by(events, day_of("ts"), "user_id"), "distinct")
    ends = ("2024-01-02", "2024-01-09", "2024-01-30")
    found = None
    for end in ends:
        one = sketches.united(days.filter(F.col("period") <= end)).crossJoin(events.filter(day_of("ts") <= end).agg(F.countDistinct("user_id").alias("n")))
        close = lambda c: F.abs(F.col(c) - F.col("n")) <= 0.05 * F.col("n")
        one = one.select(F.lit(end).alias("until"), close("hll").alias("hll"), close("theta").alias("theta"))
        found = one if found is None else found.unionByName(one)
    return found


def sketch_store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user over ten days, from count-min tables of single days: whether the estimate isn't too low and within its bound."""
    events = table(spark, sf_dir, "events").select("ts", "user_id")
    stored = written(sketches.frequencies_by(events, day_of("ts"), "user_id"), "frequencies")
    until = "2024-01-10"
    exact = events.filter(day_of("ts") <= until).groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("n"))
    found = sketches.estimated(stored.filter(F.col("period") <= until), exact).join(exact, "item")
    near = (F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + F.lit(sketches.slack()) * F.col("total"))
    return found.select(F.col("item").alias("user_id"), near.alias("near"))


def sketch_store_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of event that make up a fifth of thirty days, from tables of single days alone; so few that their counts are exact."""
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    stored = written(sketches.frequencies_by(events, day_of("ts"), "event_type"), "frequencies")
    candidates = written(sketches.frequent_by(events, day_of("ts"), "event_type", 0.2), "frequent")
    return sketches.heavy(stored, candidates, 0.2).select(F.col("item").alias("event_type"), F.col("estimate").alias("n"))


QUERIES |= {"sketch_store_distinct": sketch_store_distinct, "sketch_store_counts": sketch_store_counts, "sketch_store_heavy": sketch_store_heavy}
ORACLES |= {
    "sketch_store_distinct": "SELECT unnest(['2024-01-02', '2024-01-09', '2024-01-30']) AS until, true AS hll, true AS theta",
    "sketch_store_counts": "SELECT DISTINCT user_id, true AS near FROM events WHERE ts < TIMESTAMP '2024-01-11'",
    "sketch_store_heavy": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= 0.2 * (SELECT count(*) FROM events)",
}


def html_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each page, by a tokenizer; tests hold it against the standard library's parser on all pages."""
    return table(spark, sf_dir, "pages").select("page_id", html.page_text("html").alias("text"))


QUERIES["html_page_text"] = html_page_text
