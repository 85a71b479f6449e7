"""Queries over the driver's tables, each through the engine, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import paths
from tessella.functions.aggregates import retained
from tessella.operators.dataset import Dataset
from tessella.plans import discovery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def data(spark: SparkSession, sf_dir: str, name: str, order: list[str] | None = None) -> Dataset:
    return Dataset.table(table(spark, sf_dir, name), order)


def money(column: str) -> F.Column:
    return F.col(column).cast("decimal(18,2)").alias(column)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def q01_filter_num(spark, d):
    return data(spark, d, "lineitem").query(["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity > 45", limit=None).rows


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'FURNITURE'")
def q02_filter_eq_str(spark, d):
    return data(spark, d, "customer").query(["c_custkey", "c_name"], 'c_mktsegment = "FURNITURE"', limit=None).rows


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def q03_filter_date(spark, d):
    return data(spark, d, "orders").query(["o_orderkey", "o_orderdate"], "o_orderdate >= 1997-01-01", limit=None).rows


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'widget')")
def q04_contains(spark, d):
    return data(spark, d, "part").query(["p_partkey", "p_name"], "p_name contains widget", limit=None).rows


@query("SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1') AND ends_with(p_brand, '3')")
def q05_starts_ends(spark, d):
    return data(spark, d, "part").query(["p_partkey", "p_brand"], ["p_brand startsWith Brand#1", 'p_brand endsWith "3"'], limit=None).rows


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def q06_limit_offset(spark, d):
    return data(spark, d, "orders", ["o_orderkey"]).query(["o_orderkey", "o_custkey", "o_orderstatus"], limit=100, offset=50).rows


@query("SELECT count(*) FILTER (WHERE event_type = 'purchase') AS total, count(*) AS scanned FROM events")
def q07_count(spark, d):
    return data(spark, d, "events").count("event_type = purchase")


@query("SELECT coalesce(event_type, 'null') AS key, count(*) AS count FROM events GROUP BY 1")
def q08_group(spark, d):
    return data(spark, d, "events").group_by("event_type", sort=None)


@query(
    "SELECT count(value) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sum, CAST(avg(value) AS DECIMAL(18,2)) AS avg, "
    "CAST(min(value) AS DECIMAL(18,2)) AS min, CAST(max(value) AS DECIMAL(18,2)) AS max FROM events"
)
def q09_stats(spark, d):
    found = data(spark, d, "events").stats("value")
    return found.select("count", money("sum"), money("avg"), money("min"), money("max"))


@query(
    """WITH m AS (SELECT min(value) lo, max(value) hi, count(value) n FROM events), w AS (SELECT *, coalesce(nullif((hi - lo) / 10, 0), 1) w FROM m),
    b AS (SELECT CAST(least(floor((value - lo) / w), 9) AS INTEGER) bucket, count(*) c FROM events, w WHERE value IS NOT NULL GROUP BY 1)
    SELECT CAST(r.range AS INTEGER) AS bucket, CAST(lo + r.range * w AS DECIMAL(18,2)) AS low, CAST(lo + (r.range + 1) * w AS DECIMAL(18,2)) AS high, coalesce(c, 0) AS count,
    CAST(coalesce(c, 0) / n * 100 AS DECIMAL(18,2)) AS percentage FROM range(10) r CROSS JOIN w LEFT JOIN b ON b.bucket = r.range"""
)
def q10_distribution(spark, d):
    found = data(spark, d, "events").distribution("value", 10)
    return found.select("bucket", money("low"), money("high"), "count", money("percentage"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def q11_json_path(spark, d):
    found = Dataset.json_text(table(spark, d, "events").select("event_id", "props"), "props")
    rows = found.where("k >= 50")
    return rows.df.select("event_id", paths.as_number(rows.values("k").first(), paths.VARIANT).cast("bigint").alias("k"))


def _nested_orders(spark: SparkSession, d: str) -> Dataset:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_partkey")).alias("lines"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return Dataset.table(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def q12_wildcard_any(spark, d):
    return _nested_orders(spark, d).query(["o_orderkey", "o_custkey"], "lines[*].l_quantity > 49", limit=None).rows


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)")
def q13_join(spark, d):
    return data(spark, d, "orders").join(data(spark, d, "customer"), left_key="o_custkey", right_key="c_custkey", select=["a.o_orderkey", "b.c_name"], limit=None).rows


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 AND c_mktsegment = 'BUILDING'")
def q14_join_filter(spark, d):
    filters = ["a.o_totalprice > 300000", "b.c_mktsegment = BUILDING"]
    return data(spark, d, "orders").join(data(spark, d, "customer"), left_key="o_custkey", right_key="c_custkey", select=["a.o_orderkey", "b.c_name"], filter=filters, limit=None).rows


@query(
    "SELECT c_mktsegment AS key, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total, CAST(avg(o_totalprice) AS DECIMAL(18,2)) AS mean, "
    "CAST(min(o_totalprice) AS DECIMAL(18,2)) AS least, CAST(max(o_totalprice) AS DECIMAL(18,2)) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"
)
def q15_agg_join(spark, d):
    wanted = {"n": "COUNT(*)", "total": "SUM(a.o_totalprice)", "mean": "AVG(a.o_totalprice)", "least": "MIN(a.o_totalprice)", "most": "MAX(a.o_totalprice)"}
    groups, _ = data(spark, d, "orders").aggregate_join(data(spark, d, "customer"), group_by="b.c_mktsegment", aggregate=wanted, left_key="o_custkey", right_key="c_custkey")
    return groups.select("key", "n", money("total"), money("mean"), money("least"), money("most"))


@query("SELECT o_orderpriority AS key, count(*) FILTER (WHERE l_discount > 0) AS discounted FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def q16_count_if(spark, d):
    groups, _ = data(spark, d, "lineitem").aggregate_join(data(spark, d, "orders"), group_by="b.o_orderpriority", aggregate={"discounted": "COUNT_IF(a.l_discount)"}, left_key="l_orderkey", right_key="o_orderkey")
    return groups


@query(
    """WITH u AS (SELECT user_id, count(*) n, min(ts) lo, max(ts) hi FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT CAST(user_id % 5 AS VARCHAR) AS key, count(*) AS users, count(*) FILTER (WHERE n > 1 AND epoch_ms(hi) - epoch_ms(lo) >= 86400000) AS d1, count(*) FILTER (WHERE n > 1 AND epoch_ms(hi) - epoch_ms(lo) >= 7 * 86400000) AS d7 FROM u GROUP BY 1"""
)
def q17_retention(spark, d):
    """Retention of all who signed up, by their first and last time."""
    ends = F.when(F.count("*") > 1, F.array(F.min("ts"), F.max("ts"))).otherwise(F.array(F.min("ts")))
    logins = table(spark, d, "events").filter("event_type = 'signup'").groupBy("user_id").agg(ends.alias("logins"))
    users = Dataset.table(logins.withColumn("cohort", F.col("user_id") % 5))
    found = users.values("logins")
    return users.df.groupBy(paths.key_text(F.col("cohort"), users.df.schema["cohort"].dataType).alias("key")).agg(
        F.count("*").alias("users"), F.count_if(retained(found, 1)).alias("d1"), F.count_if(retained(found, 7)).alias("d7")
    )


@query(
    """WITH g AS (SELECT c_mktsegment, count(*) n, sum(CAST(o_totalprice AS DECIMAL(18,2))) total, avg(o_totalprice) mean, min(o_totalprice) least, max(o_totalprice) most
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DECIMAL(18,2)) AS total, CAST(avg(mean) AS DECIMAL(18,2)) AS mean, CAST(min(least) AS DECIMAL(18,2)) AS least, CAST(max(most) AS DECIMAL(18,2)) AS most FROM g"""
)
def q18_totals(spark, d):
    wanted = {"n": "COUNT(*)", "total": "SUM(a.o_totalprice)", "mean": "AVG(a.o_totalprice)", "least": "MIN(a.o_totalprice)", "most": "MAX(a.o_totalprice)"}
    _, totals = data(spark, d, "orders").aggregate_join(data(spark, d, "customer"), group_by="b.c_mktsegment", aggregate=wanted, left_key="o_custkey", right_key="c_custkey")
    return totals.select("n", money("total"), money("mean"), money("least"), money("most"))


@query("SELECT 'doc_id' AS path, CAST(doc_id AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY ALL")
def q19_id_fields(spark, d):
    labels = data(spark, d, "labels")
    return discovery.id_values(labels).groupBy("path", "value").agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents)
    SELECT 'doc_id' AS left_path, 'doc_id' AS right_path, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS matched, (SELECT count(*) FROM a) AS left_count,
    (SELECT count(*) FROM b) AS right_count, CAST((SELECT count(*) FROM a JOIN b USING (doc_id)) / (SELECT count(*) FROM a) * 100 AS DECIMAL(18,2)) AS coverage,
    CASE WHEN (SELECT count(*) FROM a) = (SELECT count(*) FROM b) THEN 'one-to-one' ELSE 'many-to-one' END AS kind"""
)
def q20_relationships(spark, d):
    left, right = data(spark, d, "labels"), Dataset.table(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"))
    return discovery.find_relationships(left, right).withColumn("coverage", F.col("coverage").cast("decimal(18,2)"))


@query(
    """SELECT * FROM (SELECT '' AS path, 'object' AS kind, count(*) AS n FROM events UNION ALL
    SELECT 'k', 'number', count(json_extract(props, '$.k')) FROM events) WHERE n > 0"""
)
def q21_schema_profile(spark, d):
    found = Dataset.json_text(table(spark, d, "events").select("props"), "props")
    return discovery.profile(found).select("path", "kind", "n")


@query()
def q22_sample(spark, d):
    return data(spark, d, "customer", ["c_custkey"]).sample(25, seed=7)


@query("SELECT count(*) AS total, (SELECT count(*) FROM events) AS scanned FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 7")
def q31_not_equal_variant(spark, d):
    return Dataset.json_text(table(spark, d, "events").select("props"), "props").count("k != 7")


@query("SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS key, count(*) AS count FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1")
def q32_group_variant(spark, d):
    return Dataset.json_text(table(spark, d, "events").select("props"), "props").group_by("k", sort=None)


@query("SELECT l_returnflag AS key, count(*) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def q33_group_multi(spark, d):
    return _nested_orders(spark, d).group_by("lines[*].l_returnflag", 'o_orderpriority = "1-URGENT"', sort=None)


@query(
    """SELECT count(*) AS count, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sum, CAST(avg(l_quantity) AS DECIMAL(18,2)) AS avg,
    CAST(min(l_quantity) AS DECIMAL(18,2)) AS min, CAST(max(l_quantity) AS DECIMAL(18,2)) AS max FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""
)
def q34_stats_multi(spark, d):
    return _nested_orders(spark, d).stats("lines[*].l_quantity").select("count", money("sum"), money("avg"), money("min"), money("max"))


@query("SELECT o_orderkey, CAST(n AS INTEGER) AS length FROM orders JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n >= 7")
def q35_length(spark, d):
    return _nested_orders(spark, d).query(["o_orderkey", "lines.length"], "lines.length >= 7", limit=None).rows


@query("SELECT s_name, n_name FROM supplier JOIN nation ON CAST(s_nationkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR) ORDER BY s_suppkey, n_nationkey LIMIT 50")
def q37_join_limit(spark, d):
    return data(spark, d, "supplier", ["s_suppkey"]).join(data(spark, d, "nation", ["n_nationkey"]), left_key="s_nationkey", right_key="n_nationkey", select=["a.s_name", "b.n_name"], limit=50).rows


from tessella import input_queries  # noqa: E402, F401  registers the queries over files
