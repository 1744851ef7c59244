"""Relational queries: one text for Spark and DuckDB, or one for each where dialects differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import positions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name: SQL that both engines read alike.
SAME = {
    "scan_all": "SELECT r_regionkey, r_name FROM region",
    "project": "SELECT c_custkey, c_name FROM customer",
    "eq_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "range_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00'",
    "in_like_between": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') OR p_type LIKE '%BRASS' OR p_size BETWEEN 5 AND 8",
    "null_logic": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS NULL AS blank, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer WHERE NOT c_acctbal < 0",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey",
    "join_right": "SELECT n.n_name, count(s.s_suppkey) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_full": "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) b ON a.o_orderkey = b.o_orderkey",
    "join_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "join_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "join_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "join_theta": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a CROSS JOIN nation b WHERE a.n_regionkey = b.n_regionkey + 1 AND a.n_nationkey < b.n_nationkey",
    "join_using": "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM (SELECT o_orderkey AS k FROM orders) o JOIN (SELECT l_orderkey AS k, l_linenumber FROM lineitem) l USING (k)",
    "join_multi_way": "SELECT r.r_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "agg_sum_count_avg": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n, round(avg(l_discount), 6) AS avg_disc, count(l_tax) AS n_tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_min_max": "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_orderdate) AS last FROM orders GROUP BY o_orderpriority",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14",
    "agg_distinct": "SELECT count(DISTINCT l_suppkey) AS n_supp, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "agg_stats": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 9) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_tax), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag",
    "agg_median": "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o_total FROM orders GROUP BY o_orderpriority",
    "agg_bool_bit": "SELECT l_returnflag, bool_and(l_quantity > 0) AS every_one, bool_or(l_tax > 0.07) AS some, bit_or(l_linenumber) AS bits FROM lineitem GROUP BY l_returnflag",
    "agg_total_rows": "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events",
    "agg_first_last": "SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS first_key, max_by(o_orderkey, o_orderkey) AS last_key, max_by(o_orderpriority, o_orderkey) AS last_priority FROM orders GROUP BY o_custkey",
    "window_ranking": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)",
    "window_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM customer",
    "window_lag_lead": "SELECT event_id, lag(event_id) OVER w AS before_id, lead(event_id, 2) OVER w AS later_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_running_sum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS run FROM events",
    "window_moving_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS ma FROM events",
    "window_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING) AS near FROM orders",
    "window_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key, nth_value(o_orderkey, 2) OVER w AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_groups_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT p_partkey, p_brand, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part) x",
    "window_qualify": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 2",
    "latest_per_key": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1",
    "set_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 35",
    "order_nulls": "SELECT k, row_number() OVER (ORDER BY k ASC NULLS LAST) AS nth FROM (SELECT nullif(n_nationkey, 7) AS k FROM nation) x",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE t > 1000000) SELECT count(*) AS n FROM top",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "values_list": "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS t(k, v)",
    "fn_string": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS lo, length(c_name) AS n, substring(c_name, 1, 8) AS s, concat(c_name, '-', c_mktsegment) AS cc, replace(c_name, '0', 'o') AS rp, lpad(c_mktsegment, 12, '*') AS lp, reverse(c_name) AS rv, repeat('ab', 2) AS rpt, translate(c_name, '019', 'xyz') AS tr, ascii(c_name) AS a, levenshtein(c_mktsegment, 'BUILDING') AS lev FROM customer",
    "fn_math": "SELECT o_orderkey, abs(o_totalprice - 100000) AS a, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, round(sqrt(o_totalprice), 6) AS s, round(ln(o_totalprice), 6) AS l, round(power(o_totalprice, 0.5), 6) AS p, round(exp(1.5), 9) AS e, round(sin(o_totalprice), 6) AS sn, o_orderkey % 7 AS m FROM orders",
    "fn_conditional": "SELECT p_partkey, coalesce(nullif(p_size, 1), -1) AS c, greatest(p_size, 20) AS g, least(p_size, 20) AS l FROM part",
    "fn_date": "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mon FROM orders",
    "fn_hash": "SELECT c_custkey, md5(c_name) AS m FROM customer",
    "tpch_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_volume": "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
}

#: name: (Spark SQL, DuckDB SQL).
EACH = {
    # Spark numbers the rows of an ORDER BY with LIMIT as they come out of an exchange, so a cluster or a spill loses their order; a window has its own
    "join_lateral": (
        "SELECT c.c_custkey, x.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM (SELECT o.o_orderkey, row_number() OVER (ORDER BY o.o_totalprice DESC, o.o_orderkey NULLS LAST) AS rn FROM orders o WHERE o.o_custkey = c.c_custkey) WHERE rn <= 2) x",
        "SELECT c.c_custkey, x.o_orderkey FROM customer c, LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 2) x",
    ),
    "join_natural": ("SELECT n, r_name FROM (SELECT n_name AS n, n_regionkey AS r_regionkey FROM nation) NATURAL JOIN region", "SELECT n, r_name FROM (SELECT n_name AS n, n_regionkey AS r_regionkey FROM nation) x NATURAL JOIN region"),
    "join_interval": (
        "SELECT a.event_id AS a_id, b.event_id AS b_id FROM (SELECT *, explode(array(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 600000000) - 1, floor(unix_micros(CAST(ts AS TIMESTAMP)) / 600000000))) AS slot FROM events WHERE event_type = 'purchase') a JOIN (SELECT *, floor(unix_micros(CAST(ts AS TIMESTAMP)) / 600000000) AS slot FROM events) b ON a.user_id = b.user_id AND a.slot = b.slot WHERE b.ts >= a.ts - INTERVAL 10 MINUTES AND b.ts < a.ts",
        "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 10 MINUTES AND b.ts < a.ts WHERE a.event_type = 'purchase'",
    ),
    "agg_percentile": ("SELECT o_orderstatus, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus"),
    "agg_approximate": (
        "SELECT l_returnflag, abs(approx_count_distinct(l_partkey, 0.02) / count(DISTINCT l_partkey) - 1) < 0.1 AS near, abs(approx_percentile(l_quantity, 0.5, 10000) - percentile(l_quantity, 0.5)) <= 1 AS mid FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, true AS near, true AS mid FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_nth": (
        "SELECT o_custkey, try_element_at(sort_array(collect_list(o_orderkey)), 2) AS second_key, listagg(o_orderstatus, '') WITHIN GROUP (ORDER BY o_orderkey) AS line FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, list_sort(list(o_orderkey))[2] AS second_key, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS line FROM orders GROUP BY o_custkey",
    ),
    "window_exclude": (
        "SELECT o_orderkey, (count(*) OVER w) - 1 AS others, round((sum(o_totalprice) OVER w) - o_totalprice, 2) AS rest FROM orders WINDOW w AS (PARTITION BY o_custkey)",
        "SELECT o_orderkey, count(*) OVER w AS others, round(coalesce(sum(o_totalprice) OVER w, 0), 2) AS rest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)",
    ),
    "fn_math_more": (
        "SELECT p_partkey, round(cos(p_size), 9) AS c, round(atan2(p_size, 3), 9) AS a, round(degrees(p_size), 6) AS d, regexp_count(p_type, 'S') AS s FROM part",
        "SELECT p_partkey, round(cos(p_size), 9) AS c, round(atan2(p_size, 3), 9) AS a, round(degrees(p_size), 6) AS d, CAST(len(regexp_extract_all(p_type, 'S')) AS INT) AS s FROM part",
    ),
    "agg_lists": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "fn_string_more": (
        "SELECT p_partkey, split_part(p_type, ' ', 2) AS w2, instr(p_type, 'S') AS pos, left(p_name, 5) AS l, right(p_name, 4) AS r, startswith(p_type, 'SMALL') AS st, endswith(p_type, 'TIN') AS en, chr(65 + p_size % 26) AS c, concat_ws('/', p_brand, p_type) AS cw, ltrim(concat('  ', p_brand)) AS lt FROM part",
        "SELECT p_partkey, split_part(p_type, ' ', 2) AS w2, CAST(instr(p_type, 'S') AS INT) AS pos, left(p_name, 5) AS l, right(p_name, 4) AS r, starts_with(p_type, 'SMALL') AS st, ends_with(p_type, 'TIN') AS en, chr(65 + p_size % 26) AS c, concat_ws('/', p_brand, p_type) AS cw, ltrim(concat('  ', p_brand)) AS lt FROM part",
    ),
    "fn_regex": (
        "SELECT p_partkey, p_type RLIKE 'BR.*S' AS m, regexp_replace(p_brand, '[0-9]+', 'N') AS r, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS e FROM part",
        "SELECT p_partkey, regexp_matches(p_type, 'BR.*S') AS m, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS r, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS e FROM part",
    ),
    "fn_date_more": (
        "SELECT event_id, date_format(ts, 'yyyy-MM-dd') AS d, CAST(dayofyear(ts) AS INT) AS doy, CAST(unix_micros(CAST(ts AS TIMESTAMP)) div 900000000 AS BIGINT) AS bin, CAST(make_date(2024, 1, 1 + CAST(event_id % 28 AS INT)) AS STRING) AS md FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, CAST(dayofyear(ts) AS INT) AS doy, CAST(epoch_us(ts) // 900000000 AS BIGINT) AS bin, CAST(make_date(2024, 1, 1 + CAST(event_id % 28 AS INT)) AS VARCHAR) AS md FROM events",
    ),
    "fn_array": (
        "SELECT k, size(a) AS n, array_contains(a, 3) AS has, element_at(a, 1) AS first_item, array_join(transform(array_distinct(array_sort(array_append(a, 1))), x -> CAST(x AS STRING)), ',') AS s, array_join(transform(slice(a, 1, 2), x -> CAST(x AS STRING)), ',') AS two FROM (SELECT n_nationkey AS k, array(n_regionkey, n_nationkey % 4, 3) AS a FROM nation)",
        "SELECT k, CAST(len(a) AS INT) AS n, list_contains(a, 3) AS has, a[1] AS first_item, array_to_string(list_sort(list_distinct(list_append(a, 1))), ',') AS s, array_to_string(a[1:2], ',') AS two FROM (SELECT n_nationkey AS k, [n_regionkey, n_nationkey % 4, 3] AS a FROM nation)",
    ),
    "fn_unnest": ("SELECT n_nationkey, w FROM nation LATERAL VIEW explode(split(n_name, ' ')) t AS w", "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation"),
    "fn_map_struct": (
        "SELECT n_nationkey, map('r', n_regionkey, 'k', n_nationkey)['r'] AS r, named_struct('a', n_name, 'b', 1).a AS a, size(map_keys(map('r', 1, 'k', 2))) AS n FROM nation",
        "SELECT n_nationkey, map {'r': n_regionkey, 'k': n_nationkey}['r'] AS r, {'a': n_name, 'b': 1}.a AS a, CAST(len(map_keys(map {'r': 1, 'k': 2})) AS INT) AS n FROM nation",
    ),
    "fn_sha_binary": ("SELECT c_custkey, sha2(c_name, 256) AS s, lower(hex(c_name)) AS h, base64(c_name) AS b FROM customer", "SELECT c_custkey, sha256(c_name) AS s, lower(hex(c_name)) AS h, base64(c_name::BLOB) AS b FROM customer"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "fn_cast": ("SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS b, try_cast(c_name AS BIGINT) AS n, CAST(c_custkey AS STRING) AS s FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS b, try_cast(c_name AS BIGINT) AS n, CAST(c_custkey AS VARCHAR) AS s FROM customer"),
    "fn_trunc_sign": ("SELECT o_orderkey, CAST(sign(o_totalprice - 150000) AS INT) AS s, CAST(o_orderkey & 12 AS BIGINT) AS bits, bround(0.5) = 0 AS half FROM orders", "SELECT o_orderkey, CAST(sign(o_totalprice - 150000) AS INT) AS s, CAST(o_orderkey & 12 AS BIGINT) AS bits, true AS half FROM orders"),
}


def relational(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return query


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event the latest order of its customer up to its time, the greatest key of those at one time.

    Both sides are one line for each customer and day, in which the last order so far is carried
    on; what is known at the end of a day is carried over days by one row for each of them. So no
    event is paired with all orders before it, and a hot customer is spread over days.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 100).alias("k"), "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey IS NOT NULL").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    line = events.unionByName(orders).where("ts IS NOT NULL").withColumn("day", F.to_date("ts"))
    days = line.groupBy("k", "day").agg(F.max(F.when(F.col("side") == 0, F.struct("ts", "o_orderkey"))).alias("m"))
    ahead = Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("k", "day", F.last("m", ignorenulls=True).over(ahead)["o_orderkey"].alias("carried"))
    so_far = Window.partitionBy("k", "day").orderBy("ts", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.withColumn("found", F.last("o_orderkey", ignorenulls=True).over(so_far)).where("side = 1").join(days, ["k", "day"])
    return found.select("event_id", F.coalesce("found", "carried").alias("o_orderkey")).where("o_orderkey IS NOT NULL")


def pk_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its place in the text order of keys, counted by ranges of texts."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").cast("string").alias("text"))
    return positions(keys, "text", "nth").select("o_orderkey", (F.col("nth") + 1).alias("nth"))


#: Queries that are more than one statement, and SQL for them.
WHOLE = {"join_asof": join_asof, "pk_text_order": pk_text_order, "fn_sha_more": relational("SELECT c_custkey, sha2(c_name, 224) AS s224, sha2(c_name, 384) AS s384, sha2(c_name, 512) AS s512 FROM customer")}
WHOLE_SQL = {
    "join_asof": "SELECT event_id, o_orderkey FROM events e ASOF JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate) o ON o.o_custkey = e.event_id % 100 AND o.o_orderdate <= e.ts",
    "pk_text_order": "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR(20))) AS nth FROM orders",
}
QUERIES = {k: relational(v) for k, v in SAME.items()} | {k: relational(v[0]) for k, v in EACH.items()} | WHOLE
ORACLES = SAME | {k: v[1] for k, v in EACH.items()} | WHOLE_SQL
