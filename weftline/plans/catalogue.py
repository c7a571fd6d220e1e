"""The catalogue of registered queries and the DuckDB statements that check them.

Most entries are one statement for both engines; where names or types differ, each has its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import pages, udfs
from weftline.operators import evaluation, redaction
from weftline.operators.contamination import run_counts, shared_runs
from weftline.operators.joins import as_of, soon_after, theta
from weftline.operators.quantiles import quantile
from weftline.operators.similarity import cosine_top_k
from weftline.operators.windows import over_ranges
from weftline.sources.tables import read_lines, scratch, table, through, through_text, views, write_buckets, write_parts
from weftline.streaming import events

SQL: dict[str, tuple[str, str]] = {}
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def both(name: str, text: str, oracle: str | None = None) -> None:
    SQL[name] = (text, oracle or text)


def frame(name: str, oracle: str):
    def put(f):
        FRAMES[name] = (f, oracle)
        return f

    return put


both("r1_literal", "SELECT 'www.hello' AS line")
# Scans, projections, filters
both("p01_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
both("p03_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity < 5 AND l_shipdate >= CAST('1998-01-01' AS TIMESTAMP_NTZ)", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity < 5 AND l_shipdate >= TIMESTAMP '1998-01-01'")
both("p04_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' OR p_name ILIKE 'a%'")
both("p05_regex", "SELECT c_custkey FROM customer WHERE c_name RLIKE '[0-9]*7$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[0-9]*7$')")
both("p06_in_between_case", "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 100000 THEN 'low' ELSE 'high' END AS band FROM orders WHERE o_orderstatus IN ('O', 'F')")
# Joins; both sides are filtered, so that every kind gives another result
SIDES = "(SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000) o {} JOIN (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25) l ON o_orderkey = l_orderkey"
for kind in ("inner", "left", "right", "full"):
    both(f"p10_{kind}_join", f"SELECT o_orderkey, l_orderkey, l_linenumber FROM {SIDES.format(kind.upper())}")
for kind in ("semi", "anti"):
    both(f"p11_{kind}_join", f"SELECT o_orderkey FROM {SIDES.format('LEFT ' + kind.upper())}", f"SELECT o_orderkey FROM {SIDES.format(kind.upper())}")
both("p12_small_product", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("p14_interval_join", "SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
both("p16_lateral", "SELECT r_name, top.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 2) top")
both("p17_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
both("p17_scalar_subquery", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)")
both("p18_recursive", "WITH RECURSIVE link AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), chain(event_id, user_id, place) AS (SELECT event_id, user_id, 1 FROM link WHERE before IS NULL UNION ALL SELECT l.event_id, l.user_id, c.place + 1 FROM chain c JOIN link l ON l.before = c.event_id WHERE c.place < 10) SELECT user_id, event_id, place FROM chain")
HINTS = {"broadcast": "BroadcastHashJoin", "merge": "SortMergeJoin", "shuffle_hash": "ShuffledHashJoin", "shuffle_replicate_nl": "CartesianProduct"}
for hint in HINTS:
    both(f"p19_{hint}_hint", f"SELECT /*+ {hint.upper()}(customer) */ n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
# Aggregation
both("p20_group_aggregate", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= CAST('2001-06-01' AS TIMESTAMP_NTZ) GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY l_returnflag, l_linestatus")
both("p21_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY o_orderpriority")
both("p22_filter_having", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM orders GROUP BY o_custkey HAVING count(*) > 12")
for kind, text in (("rollup", "ROLLUP(n_regionkey, c_mktsegment)"), ("cube", "CUBE(n_regionkey, c_mktsegment)"), ("grouping_sets", "GROUPING SETS ((n_regionkey), (c_mktsegment), ())")):
    both(f"p23_{kind}", f"SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY {text}")
both("p24_grouping", "SELECT n_regionkey, CAST(grouping(n_regionkey) AS INT) AS g, count(*) AS n FROM nation GROUP BY ROLLUP(n_regionkey)")
both("p26_unpivot", "SELECT c_custkey, name, value FROM (SELECT c_custkey, c_acctbal AS a, c_acctbal * 2 AS b FROM customer) UNPIVOT (value FOR name IN (a, b))")
both("p27_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag")
both("p28_percentile", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 4) AS m FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS m FROM orders GROUP BY o_orderpriority")
both("p29_arg_max", "SELECT c_nationkey, max_by(c_custkey, c_acctbal) AS best FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS best FROM customer GROUP BY c_nationkey")
both("p30_ordered_list", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
# Windows, order, sets
both("p40_ranking", "SELECT l_orderkey, l_linenumber, l_quantity, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)")
both("p40_row_number_ntile", "SELECT event_id, CAST(row_number() OVER w AS INT) AS rn, CAST(ntile(4) OVER w AS INT) AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
both("p41_offsets", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
both("p42_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s FROM events")
both("p43_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS n FROM orders")
both("p44_interval_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
both("p45_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
both("p46_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
A, B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 3000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 7000"
for name, word in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    both(f"p48_{name}", f"({A}) {word} ({B})")
# Scalars
both("p50_strings", "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 3, 5) AS s, replace(c_name, '0', 'x') AS r, lpad(c_mktsegment, 12, '*') AS l, concat_ws('-', c_name, c_mktsegment) AS j, CAST(length(c_name) AS INT) AS n FROM customer")
both("p51_case", "SELECT doc_id, lower(text) AS low, upper(replace(text, 'ß', 'ss')) AS up FROM documents")
both("p52_regex_functions", "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '#') AS a, regexp_extract(c_name, '([0-9]+)', 1) AS b FROM customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '#', 'g') AS a, regexp_extract(c_name, '([0-9]+)', 1) AS b FROM customer")
both("p53_hashes", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
both("p53_trim_levenshtein", "SELECT p_partkey, trim(p_name) AS t, CAST(levenshtein(p_name, p_type) AS INT) AS d FROM part")
both("p54_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q, CAST(datediff(o_orderdate, DATE '1995-01-01') AS INT) AS d FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS d FROM orders")
both("p55_date_trunc", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m FROM orders")
both("p56_day_of_week", "SELECT o_orderkey, dayofweek(o_orderdate) - 1 AS d FROM orders", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS INT) AS d FROM orders")
both("p57_math", "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS s, round(ln(l_extendedprice), 6) AS g, CAST(floor(l_extendedprice) AS DOUBLE) AS f, CAST(ceil(l_extendedprice) AS DOUBLE) AS c, round(power(l_quantity, 1.5), 6) AS p FROM lineitem")
both("p58_division", "SELECT o_orderkey, o_orderkey % 7 AS m, o_orderkey / 4 AS q FROM orders")
both("p59_decimal_sum", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS s, round(avg(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE)), 4) AS a FROM lineitem GROUP BY l_returnflag")
both("p60_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
both("p61_arrays", "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 6) AS norm2 FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm2 FROM embeddings")
both("p61_explode", "SELECT conv_id, turn, word FROM conversations LATERAL VIEW explode(split(text, ' ')) AS word", "SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations")
both("p62_maps", "SELECT n_nationkey, map_from_arrays(array('a', 'b'), array(n_nationkey, n_regionkey))['b'] AS v FROM nation", "SELECT n_nationkey, n_regionkey AS v FROM nation")
# Event time, in batch
both("p70_tumbling", "SELECT window.start AS start, count(*) AS n FROM events GROUP BY window(ts, '1 hour')", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1")
both("p71_sliding", "SELECT window.start AS start, count(*) AS n FROM events GROUP BY window(ts, '1 hour', '30 minutes')", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS start FROM events UNION ALL SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' FROM events) GROUP BY start")
both("p72_session", "SELECT user_id, session_window.start AS start, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
both("p95_tags_stripped", "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '')) AS n FROM pages", "SELECT page_id, CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS INT) AS n FROM pages")
both("p96_conversations", "SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), '>') AS roles FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")


# Text and labels, as plain statements
both("p90_least_id_of_text", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text)")
DUCK_GRAMS = "SELECT DISTINCT {0}, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {0}, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM {1}) WHERE len(w) >= 8)"
SHARED = "SELECT doc_id, item_id, count(*) AS shared FROM ({}) d JOIN ({}) b ON d.g = b.g GROUP BY doc_id, item_id".format(DUCK_GRAMS.format("doc_id", "documents"), DUCK_GRAMS.format("item_id", "benchmark"))
both("p94_lines_once", "SELECT doc_id, array_join(array_distinct(split(text, '\\n')), '\\n') AS text FROM documents", "SELECT doc_id, array_to_string(list_transform(list_filter(lines, lambda x, i: list_position(lines, x) = i), lambda x: x), chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)")
both("p98_rates_by_label", "SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE n_chars < 200) AS short, round(avg(CAST(n_chars AS DOUBLE)), 6) AS mean_chars, count(*) FILTER (WHERE text LIKE '%@%') AS with_at FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic")


@frame("p02_formats", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after csv, json and orc files."""
    return through(through(through(table(spark, sf_dir, "nation"), "csv", header=True), "json"), "orc")


@frame("p02_text", "SELECT n_name FROM nation")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_text(table(spark, sf_dir, "nation"), "n_name")


@frame("p15_as_of_join", "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    probes = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views_ = rows.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return as_of(probes, views_, "user_id", "ts", "view_id").select("event_id", "view_id")


@frame("p13_theta_equi_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal")
def richer_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return theta(customers, suppliers, F.col("c_acctbal") < F.col("s_acctbal"), ("c_nationkey", "s_nationkey"), by="s_acctbal").select("c_custkey", "s_suppkey")


@frame("p14_interval_in_buckets", SQL["p14_interval_join"][1])
def soon_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    pairs = soon_after(rows.where("event_type = 'view'"), rows.where("event_type = 'purchase'"), "user_id", "ts", 3600)
    return pairs.select(F.col("first.event_id").alias("view_id"), F.col("then.event_id").alias("purchase_id"))


@frame("p25_pivot", "SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_nationkey")
def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    counts = rows.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)))
    return counts.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


#: What an estimate may be off by, as a share of the exact figure. A sketch's standard error has to be a small part of it, or some groups miss it by chance.
WITHIN = 0.1


def about(column: str) -> Column:
    return F.abs(F.col(column) - F.col("exact")) <= WITHIN * F.col("exact")


@frame("p31_approximate_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY l_returnflag")
def about_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of distinct values of each group, and whether the approximate one, of a standard error of a hundredth, is within a tenth of it.

    Each has its own aggregation: beside an exact count the sketch would be built anew for every distinct value of a group.
    """
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey")
    estimates = rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.approx_count_distinct("l_partkey", WITHIN / 10).alias("a"))
    counts = rows.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return counts.join(estimates, F.col("l_returnflag").eqNullSafe(F.col("flag"))).select("l_returnflag", "exact", about("a").alias("close"))


@frame("p32_merged_sketches", "SELECT count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem")
def sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog sketches of groups, merged: their estimate against the exact count of all."""
    rows = table(spark, sf_dir, "lineitem")
    parts = rows.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey").alias("s"))
    whole = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("a"))
    return whole.join(F.broadcast(rows.agg(F.count_distinct("l_partkey").alias("exact")))).select("exact", about("a").alias("close"))


@frame("p32_quantile_sketch", "SELECT o_orderpriority, count(*) AS n, true AS close FROM orders GROUP BY o_orderpriority")
def quantile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each group, and whether the median by a KLL sketch has a rank within a twentieth of the middle."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey")
    medians = rows.groupBy("o_orderpriority").agg(F.expr("kll_sketch_get_quantile_bigint(kll_sketch_agg_bigint(o_custkey), 0.5D)").alias("m"))
    ranks = rows.join(F.broadcast(medians), "o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg((F.col("o_custkey") <= F.col("m")).cast("double")).alias("rank"))
    return ranks.select("o_orderpriority", "n", (F.abs(F.col("rank") - 0.5) <= 0.05).alias("close"))


@frame("p73_stream_tumbling", SQL["p70_tumbling"][1])
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.tumbling(spark, sf_dir)


CLOSED = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"


@frame("p73_stream_closed_hours", CLOSED)
def stream_closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.closed_hours(events.stream(spark, sf_dir))


@frame("p78_late_dropped", CLOSED)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.late_dropped(spark, sf_dir)


@frame("p79_restart", CLOSED)
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.restarted(spark, sf_dir)


@frame("p74_stream_closed_sessions", f"SELECT * FROM ({SQL['p72_session'][1].replace('count(*) AS n FROM', 'count(*) AS n, max(ts) AS last FROM', 1)}) WHERE last + INTERVAL '30 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)".replace("SELECT *", "SELECT user_id, start, n", 1))
def stream_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.closed_sessions(events.stream(spark, sf_dir))


@frame("p75_stream_join", "SELECT a.event_id AS view_id, b.event_id AS purchase_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.purchases_after_views(spark, sf_dir)


@frame("p76_stream_distinct", "SELECT event_id, user_id FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.distinct_events(spark, sf_dir)


@frame("p74_stream_session", SQL["p72_session"][1])
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(spark, sf_dir)


@frame("p77_stream_state", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.running_totals(spark, sf_dir)


@frame("p79_stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_segment(spark, sf_dir)


@frame("p82_table_function", "SELECT p_partkey, word, CAST(place - 1 AS INTEGER) AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part)")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.lateralJoin(udfs.Words(F.col("p_name").outer())).select("p_partkey", "word", "place")


@frame("p80_pandas_udf", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem")
def pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(udfs.with_tax("l_extendedprice", "l_tax"), 4).alias("gross"))


GROSS = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem"


@frame("p80_scalar_udf", GROSS)
def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(udfs.with_tax_by_row("l_extendedprice", "l_tax"), 4).alias("gross"))


@frame("p80_arrow_udf", GROSS)
def arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(udfs.with_tax_arrow("l_extendedprice", "l_tax"), 4).alias("gross"))


@frame("p81_grouped_map", "SELECT user_id, event_id, round(value / sum(value) OVER (PARTITION BY user_id), 8) AS share FROM events")
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    shares = rows.groupBy("user_id").applyInPandas(udfs.share_of_group, "user_id long, event_id long, share double")
    return shares.select("user_id", "event_id", F.round("share", 8).alias("share"))


@frame("p83_udaf", "SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 4) AS spread FROM orders GROUP BY o_orderpriority")
def udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(udfs.spread("o_totalprice"), 4).alias("spread"))


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
found AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 8], ' ') AS run FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS p FROM d WHERE len(w) >= 8)),
runs AS (SELECT item_id, len(w) AS item_words, p AS at_, array_to_string(w[p + 1:p + 8], ' ') AS run FROM (SELECT item_id, w, unnest(range(len(w) - 7)) AS p FROM i WHERE len(w) >= 8)),
hits AS (SELECT *, coalesce(lead(at_) OVER (PARTITION BY doc_id, item_id ORDER BY at_) - at_, 9) AS gap FROM found JOIN runs USING (run))
SELECT doc_id, item_id, count(DISTINCT run) AS shared, CAST(sum(least(gap, 8)) AS BIGINT) AS covered, max(item_words) AS item_words, round(sum(least(gap, 8)) / max(item_words), 6) AS share, count(*) FILTER (WHERE gap > 8) AS passages
FROM hits GROUP BY doc_id, item_id
"""


@frame("p92_shared_word_runs", SHARED)
def shared_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), lambda text: F.split(F.lower(text), "[^a-z0-9]+"))


@frame("p92_contamination", CONTAMINATION)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@frame("p28_exact_quantile", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.9), 4) AS q FROM lineitem GROUP BY l_returnflag")
def exact_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 0.9).select("l_returnflag", "n", F.round("quantile", 4).alias("q"))


@frame("p28_text_length_quantile", "SELECT source, count(*) AS n, round(quantile_cont(CAST(length(text) AS DOUBLE), 0.5), 4) AS q FROM documents GROUP BY source")
def length_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.length("text").alias("n_chars"))
    return quantile(docs, "source", "n_chars", 0.5).select("source", "n", F.round("quantile", 4).alias("q"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score that has many ties: the share of letters and spaces in the first hundredths."""
    # Runs of them are taken out and what is left is counted: far fewer and longer matches than the other characters one by one.
    plain = F.length("text") - F.length(F.regexp_replace("text", "[a-zA-Z ]+", ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.round(F.try_divide(plain * 100, F.length("text"))) / 100).alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


SCORED = "SELECT round(length(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) * 100 / length(text)) / 100 AS score, quality AS y FROM documents JOIN labels USING (doc_id)"
POINTS = f"SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM ({SCORED}) GROUP BY score"
CURVE = f"SELECT score AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS all_pos, CAST(sum(neg) OVER () AS BIGINT) AS all_neg, pos, neg FROM ({POINTS}) WINDOW w AS (ORDER BY score DESC)"


@frame("p98_curve", f"SELECT threshold, tp, fp, all_pos - tp AS fn, all_neg - fp AS tn, round(tp / (tp + fp), 9) AS precision, round(tp / all_pos, 9) AS recall, round(fp / all_neg, 9) AS fall_out FROM ({CURVE})")
def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = ("precision", "recall", "fall_out")
    return evaluation.curve(scored(spark, sf_dir), "score", "quality").withColumns({c: F.round(c, 9) for c in rates})


@frame("p98_areas", f"SELECT CAST(max(all_pos) AS BIGINT) AS positives, CAST(max(all_neg) AS BIGINT) AS negatives, round(sum(neg * (tp - pos + pos / 2)) / max(all_pos) / max(all_neg), 9) AS auc, round(sum(pos * (tp / (tp + fp))) / max(all_pos), 9) AS average_precision FROM ({CURVE})")
def score_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.areas(scored(spark, sf_dir), "score", "quality").withColumns({c: F.round(c, 9) for c in ("auc", "average_precision")})


@frame("p98_calibration", f"SELECT CAST(least(9, floor(score * 10)) AS INT) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(y), 9) AS rate FROM ({SCORED}) GROUP BY 1")
def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration(scored(spark, sf_dir), "score", "quality").withColumns({c: F.round(c, 9) for c in ("mean_score", "rate")})


def page_oracle() -> str:
    """Blocks by the same patterns; references by name replaced one after the other, `amp` last."""
    quoted = lambda x: x.replace("'", "''")
    text = f"regexp_replace(html, '[{pages.BLOCK}{pages.OPEN}{pages.CLOSE}]', '', 'g')"
    text = f"regexp_replace({text}, '{quoted(pages.tokenizer(''))}', '\\1\\2', 'g')"
    for tag, mark in pages.TAGS.items():
        text = f"regexp_replace({text}, '{quoted(tag)}', '{mark}', 'g')"

    def plain(c: str) -> str:
        for name in [*(n for n in pages.ENTITIES if n != "amp"), "amp"]:
            c = f"replace({c}, '&{name};', '{pages.ENTITIES[name].replace(chr(39), chr(39) * 2)}')"
        return f"trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"

    links = f"array_to_string(regexp_extract_all(raw, '{pages.OPEN}([^{pages.CLOSE}]*)', 1), ' ')"
    unmarked = f"regexp_replace(raw, '[{pages.OPEN}{pages.CLOSE}]', '', 'g')"
    return f"""
WITH parts AS (SELECT page_id, string_split({text}, '{pages.BLOCK}') AS p FROM pages),
raw AS (SELECT page_id, unnest(p) AS raw, generate_subscripts(p, 1) AS block FROM parts),
blocks AS (SELECT page_id, block, {plain(unmarked)} AS text, length({plain(links)}) AS link_chars FROM raw),
good AS (SELECT *, link_chars <= 0.5 * length(text) AND length(text) >= 20 AS good FROM blocks WHERE text <> '')
SELECT page_id, coalesce(string_agg(text, chr(10) ORDER BY block) FILTER (WHERE good), '') AS text, count(*) AS n_blocks, count(*) FILTER (WHERE good) AS n_kept FROM good GROUP BY page_id
"""


@frame("p95_page_texts", page_oracle())
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(table(spark, sf_dir, "pages"))


LINES = "SELECT DISTINCT doc_id, regexp_replace(lower(trim(line)), '[0-9]+', '0', 'g') AS shape FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''"
FREQUENT = f"SELECT shape, count(*) AS docs FROM ({LINES}) GROUP BY shape HAVING count(*) >= greatest({redaction.LEAST}, (SELECT ceil({redaction.SHARE} * count(*)) FROM documents))"


@frame("p93_frequent_lines", FREQUENT)
def frequent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.frequent_shapes(table(spark, sf_dir, "documents"))


def redaction_oracle() -> str:
    text = "string_agg(CASE WHEN regexp_replace(lower(trim(line)), '[0-9]+', '0', 'g') IN (SELECT shape FROM known) THEN '[licence]' ELSE line END, chr(10) ORDER BY place)"
    for kind, pattern in redaction.KINDS.items():
        text = f"regexp_replace({text}, '{pattern}', '[{kind}]', 'g')"
    lines = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents"
    return f"WITH known AS (SELECT shape FROM ({FREQUENT}) WHERE regexp_matches(shape, '{redaction.LICENCE}')) SELECT doc_id, {text} AS text FROM ({lines}) GROUP BY doc_id"


@frame("p93_redacted", redaction_oracle())
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"))


@frame("p97_cosine_top_k", "SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10")
def nearest_by_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@frame("p40_large_partitions", "SELECT l_returnflag, l_extendedprice, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, sum(l_quantity) OVER w AS so_far, lag(l_extendedprice, 1) OVER w AS before, lead(l_extendedprice, 3) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC)")
def large_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    out = over_ranges(rows, "l_returnflag", [("l_extendedprice", False)], ("rank", "dense_rank"), {"so_far": "l_quantity"}, {"before": ("l_extendedprice", 1), "after": ("l_extendedprice", -3)})
    return out.drop("l_quantity")


VISITS = "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, lead(min(ts)) OVER (PARTITION BY user_id ORDER BY min(ts)) AS later FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"


@frame("p77_visits_by_timer", f"SELECT user_id, first, last, n FROM ({VISITS}) WHERE later IS NOT NULL OR last + INTERVAL '12 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def visits_by_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.closed_visits(spark, sf_dir)


@frame("p77_map_state", "SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY user_id")
def map_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.kinds_so_far(spark, sf_dir)


@frame("p82_table_argument", SQL["p72_session"][1])
def table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return udfs.Sessions(rows.asTable(), F.lit("user_id"), F.lit("ts"), F.lit(30))


@frame("p02_partitions_overwritten", "SELECT o_orderkey, o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_totalprice, o_orderstatus FROM orders")
def partitions_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by status, then one status written anew: the others stay."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), scratch(spark, "orders-by-status")
    write_parts(orders, path, "o_orderstatus")
    write_parts(orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), path, "o_orderstatus")
    return spark.read.schema(orders.schema).parquet(path)


@frame("p02_bucketed_join", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in buckets of the join key: the join and the count behind it move no row."""
    mark = scratch(spark, "b").rsplit("-", 1)[1]
    orders = write_buckets(table(spark, sf_dir, "orders").select("o_orderkey"), f"orders_{mark}", "o_orderkey", 8)
    lines = write_buckets(table(spark, sf_dir, "lineitem").select("l_orderkey"), f"lines_{mark}", "l_orderkey", 8)
    return orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@frame("p02_corrupt_rows", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN event_id || ',?' END AS raw FROM events")
def corrupt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through csv with every seventh value broken: broken lines come back as they are."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit("?")).otherwise(F.col("value").cast("string"))
    path = scratch(spark, "broken")
    table(spark, sf_dir, "events").select(F.concat_ws(",", "event_id", value).alias("value")).write.text(path)
    good, bad = read_lines(spark, path, "csv", "event_id long, value double")
    broken = bad.select(F.split("_corrupt", ",")[0].cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"), F.col("_corrupt").alias("raw"))
    return good.withColumn("raw", F.lit(None).cast("string")).unionByName(broken)


@frame("p94_without_frequent_lines", f"WITH known AS ({FREQUENT}) SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE regexp_replace(lower(trim(line)), '[0-9]+', '0', 'g') NOT IN (SELECT shape FROM known)), '') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents) GROUP BY doc_id")
def without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.without_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: statement(text) for k, (text, _) in SQL.items()} | {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in (SQL | FRAMES).items()}
