"""Registration of queries, and the frames that stand in for a catalog, ratings and an event log.

The stand-ins are defined twice on purpose: as DataFrames for the engine and as
SQL for the check.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import shared_dir

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its function's name, with its SQL where there is one."""

    def register(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of a table that is derived from ``sf_dir`` and kept for this application; ``write`` makes it on first use.

    It lies in the folder of ``spark.checkpoint.dir``, which driver and executors share; a ``local[...]`` master may use its own.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}-{name}"
        write(_STORED[key])
    return _STORED[key]


_STORED: dict[tuple[str, str, str], str] = {}


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating 0.5 to 5.0, rated_at, line_id): order lines as ratings of parts by customers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.ceil(F.col("l_quantity") / 5) * 0.5).cast("double").alias("rating"),
        F.col("o_orderdate").cast("date").alias("rated_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
    )


RATINGS = """ratings AS (
    SELECT o_custkey AS user_id, l_partkey AS item_id, (ceil(l_quantity / 5) * 0.5)::DOUBLE AS rating, o_orderdate::DATE AS rated_at, l_orderkey * 10 + l_linenumber AS line_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title, genre, brand, year, price, votes, score): parts with the counts and means of their ratings.

    score is on a scale of 10, votes counts order lines, year is 1950 + size.
    """
    voted = ratings(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("votes"), (F.avg("rating") * 2).alias("score"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("genre"), F.col("p_brand").alias("brand"), (F.col("p_size") + 1950).alias("year"), F.col("p_retailprice").alias("price")
    )
    return parts.join(voted, "item_id", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))


CATALOG = RATINGS + """, catalog AS (
    SELECT p_partkey AS item_id, p_name AS title, p_type AS genre, p_brand AS brand, p_size + 1950 AS year, p_retailprice AS price, coalesce(votes, 0) AS votes, score
    FROM part LEFT JOIN (SELECT item_id, count(*) AS votes, avg(rating) * 2 AS score FROM ratings GROUP BY item_id) v ON v.item_id = p_partkey)"""


def credit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, person_id, role, rank): the credits without names, of people that need not be known."""
    role = F.create_map(*[F.lit(x) for x in ("A", "actor", "N", "director", "R", "writer")])
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("person_id"), role[F.col("l_returnflag")].alias("role")).agg(F.min("l_linenumber").alias("rank"))


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, person_id, person, role, rank): suppliers as people of the parts, with a role by return flag."""
    lines = credit_lines(spark, sf_dir)
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("person"))
    return lines.join(people, "person_id").select("item_id", "person_id", "person", "role", "rank")


CREDITS = """credits AS (
    SELECT l_partkey AS item_id, l_suppkey AS person_id, s_name AS person, CASE l_returnflag WHEN 'A' THEN 'actor' WHEN 'N' THEN 'director' ELSE 'writer' END AS role, min(l_linenumber) AS rank
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log: views and errors are searches (an error found nothing), clicks are opens, purchases are recommendations."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").withColumn("k", k)
    kind = F.expr("CASE event_type WHEN 'view' THEN 'search' WHEN 'error' THEN 'search' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'rec' ELSE event_type END")
    search = F.col("event_type").isin("view", "error")
    return events.select(
        "event_id", "ts", F.to_date("ts").alias("day"), kind.alias("kind"),
        F.when(search, F.concat(F.when(F.col("k") % 2 == 0, "The Red ").otherwise("blue "), F.lit("item "), (F.col("k") % 37).cast("string"))).alias("query"),
        F.when(search, F.col("event_type") == "view").alias("found"),
        F.when(F.col("event_type") == "click", F.when(F.col("k") % 3 == 0, "similar").otherwise("search")).alias("ref"),
        F.when(F.col("event_type") == "click", F.col("k") % 15 + 1).alias("pos"),
        (F.col("k") + 1).alias("item_id"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("sid"),
        "user_id", F.col("value").alias("latency"),
        F.when(search & (F.col("k") % 4 != 0), F.concat(F.lit('{"genre": "g'), (F.col("k") % 7).cast("string"), F.lit('"'), F.when(F.col("k") % 4 == 1, ', "year_min": 1990').otherwise(""), F.when(F.col("k") % 5 == 1, ', "language": "en"').otherwise(""), F.when(F.col("k") % 13 == 0, "").otherwise("}"))).alias("filters"),
    )


LOG = """log AS (
    SELECT event_id, ts, ts::DATE AS day,
           CASE event_type WHEN 'view' THEN 'search' WHEN 'error' THEN 'search' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'rec' ELSE event_type END AS kind,
           CASE WHEN event_type IN ('view', 'error') THEN CASE WHEN k % 2 = 0 THEN 'The Red ' ELSE 'blue ' END || 'item ' || (k % 37)::VARCHAR END AS query,
           CASE WHEN event_type IN ('view', 'error') THEN event_type = 'view' END AS found,
           CASE WHEN event_type = 'click' THEN CASE WHEN k % 3 = 0 THEN 'similar' ELSE 'search' END END AS ref,
           CASE WHEN event_type = 'click' THEN k % 15 + 1 END AS pos,
           k + 1 AS item_id, CASE WHEN user_id % 11 <> 0 THEN 's' || user_id::VARCHAR END AS sid, user_id, value AS latency,
           CASE WHEN event_type IN ('view', 'error') AND k % 4 <> 0 THEN '{"genre": "g' || (k % 7)::VARCHAR || '"' || CASE WHEN k % 4 = 1 THEN ', "year_min": 1990' ELSE '' END
                || CASE WHEN k % 5 = 1 THEN ', "language": "en"' ELSE '' END || CASE WHEN k % 13 = 0 THEN '' ELSE '}' END END AS filters
    FROM (SELECT *, (props ->> 'k')::INT AS k FROM events))"""

#: The reporting period [SINCE, UNTIL) and the one before it.
BEFORE, SINCE, UNTIL = "2024-01-01", "2024-01-16", "2024-01-31"
