"""Scans, projections, filters, joins, aggregates and set operations over the catalog and its fact tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators.relational import latest, numbered, ranked, top_k, upsert
from marlstone.plans.base import CATALOG, CREDITS, RATINGS, catalog, credits, query, ratings, table

#: Keys of one bucket when dense numbers are given out.
ID_BUCKET = 100_000

C, R, P = f"WITH {CATALOG} ", f"WITH {RATINGS} ", f"WITH {CREDITS} "
CP = f"WITH {CATALOG}, {CREDITS} "


@query("SELECT p_partkey AS item_id, coalesce(p_name, '') AS title, coalesce(p_brand, '') AS brand, string_split(p_name, ' ')[1] AS first_word FROM part")
def scan_projection(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.coalesce("p_name", F.lit("")).alias("title"), F.coalesce("p_brand", F.lit("")).alias("brand"), F.split("p_name", " ")[0].alias("first_word"))


@query("SELECT p_partkey AS item_id, p_name AS title FROM part WHERE p_partkey = 77")
def point_lookup(spark, sf):
    return table(spark, sf, "part").filter("p_partkey = 77").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice")
    return orders.crossJoin(F.broadcast(orders.agg(F.avg("o_totalprice").alias("mean")))).filter("o_totalprice > mean").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def tsv_semi_join(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation").filter("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


_LATEST = "latest_ratings AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY rated_at DESC, line_id DESC, rating DESC) AS k FROM ratings) WHERE k = 1)"


def _latest(spark, sf):
    return latest(ratings(spark, sf), ["user_id", "item_id"], [F.col("rated_at").desc(), F.col("line_id").desc(), F.col("rating").desc()])


@query(R + f", {_LATEST}, kept AS (SELECT user_id FROM latest_ratings GROUP BY user_id HAVING count(*) >= 30), ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u FROM kept) SELECT u, item_id, rating FROM latest_ratings JOIN ids USING (user_id)")
def ratings_ingest(spark, sf):
    rows = _latest(spark, sf)
    kept = rows.groupBy("user_id").count().filter("count >= 30").select("user_id")
    ids = numbered(kept, "user_id", F.floor(F.col("user_id") / ID_BUCKET), "u")
    return rows.join(ids, "user_id").select("u", "item_id", "rating")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def md5_check(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT c_custkey, try_cast(replace(c_name, 'Customer#', '') AS INT) AS number, try_cast(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE (c_custkey % 10)::VARCHAR || '.5' END AS DOUBLE) AS rating FROM customer WHERE trim(c_name) <> '' AND try_cast(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE '1' END AS DOUBLE) IS NOT NULL")
def tolerant_parse(spark, sf):
    raw = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.concat((F.col("c_custkey") % 10).cast("string"), F.lit(".5")))
    rows = table(spark, sf, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer#"), F.lit("")).try_cast("int").alias("number"), raw.try_cast("double").alias("rating"), "c_name")
    return rows.filter("trim(c_name) <> '' AND rating IS NOT NULL").drop("c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '2001-06-01' - INTERVAL 365 DAY THEN o_totalprice END AS fresh, coalesce(CASE WHEN o_orderdate > TIMESTAMP '2001-06-01' - INTERVAL 365 DAY THEN o_totalprice END, -1) AS value FROM orders")
def ttl_lookup(spark, sf):
    fresh = F.when(F.col("o_orderdate") > F.lit("2000-06-01").cast("timestamp"), F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", fresh.alias("fresh"), F.coalesce(fresh, F.lit(-1.0)).alias("value"))


@query("SELECT DISTINCT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def anti_join_missing(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey").distinct()


@query(C + "SELECT item_id, votes FROM catalog WHERE votes >= 30 ORDER BY votes DESC, item_id LIMIT 40")
def pending_limit(spark, sf):
    return catalog(spark, sf).filter("votes >= 30").select("item_id", "votes").orderBy(F.col("votes").desc(), "item_id").limit(40)


@query("SELECT doc_id, coalesce(CASE WHEN lang = 'en' AND len(text) >= 120 THEN 'en' END, CASE WHEN len(text) >= 200 THEN lang END) AS chosen FROM documents")
def coalesce_minlen(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.when((F.col("lang") == "en") & (F.length("text") >= 120), "en"), F.when(F.length("text") >= 200, F.col("lang"))).alias("chosen"))


@query("SELECT event_id, left(event_type, 4) AS kind, ts::DATE AS day, CASE WHEN value IS NOT NULL THEN value > 10 END AS found FROM events")
def event_derive(spark, sf):
    return table(spark, sf, "events").select("event_id", F.left("event_type", F.lit(4)).alias("kind"), F.to_date("ts").alias("day"), (F.col("value") > 10).alias("found"))


@query(R + "SELECT item_id, first_line FROM (SELECT item_id, min(line_id) AS first_line FROM ratings GROUP BY item_id) ORDER BY first_line LIMIT 60")
def dedup_first(spark, sf):
    return ratings(spark, sf).groupBy("item_id").agg(F.min("line_id").alias("first_line")).orderBy("first_line").limit(60)


@query(C + "SELECT item_id, title, year, genre FROM catalog WHERE year BETWEEN 1960 AND 1975 AND lower(genre) = lower('promo')")
def facet_filter(spark, sf):
    return catalog(spark, sf).filter(F.col("year").between(1960, 1975) & (F.lower("genre") == "promo")).select("item_id", "title", "year", "genre")


@query(C + "SELECT item_id, score FROM (SELECT item_id, round(score, 6) AS score, year FROM catalog WHERE votes > 0 ORDER BY score DESC, item_id LIMIT 100) WHERE year >= 1980 ORDER BY score DESC, item_id LIMIT 20")
def post_filter_topn(spark, sf):
    pool = catalog(spark, sf).filter("votes > 0").select("item_id", F.round("score", 6).alias("score"), "year").orderBy(F.col("score").desc(), "item_id").limit(100)
    return pool.filter("year >= 1980").orderBy(F.col("score").desc(), "item_id").limit(20).drop("year")


@query(C + "SELECT item_id, score FROM (SELECT item_id, round(score, 6) AS score, year FROM catalog WHERE votes > 0) WHERE year >= 1980 ORDER BY score DESC, item_id LIMIT 20")
def pre_filter_rank(spark, sf):
    return catalog(spark, sf).filter("votes > 0 AND year >= 1980").select("item_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "item_id").limit(20)


@query(C + "SELECT item_id, votes FROM catalog WHERE score >= 5.5 ORDER BY votes DESC, item_id LIMIT 20 OFFSET 40")
def popular_offset_limit(spark, sf):
    return catalog(spark, sf).filter("score >= 5.5").select("item_id", "votes").orderBy(F.col("votes").desc(), "item_id").offset(40).limit(20)


@query(P + "SELECT person, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM credits WHERE person ILIKE '%00001%' GROUP BY person ORDER BY (person ILIKE 'supplier#00000001%') DESC, n DESC, person LIMIT 8")
def autocomplete(spark, sf):
    found = credits(spark, sf).filter(F.col("person").ilike("%00001%")).groupBy("person").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return found.orderBy(F.col("person").ilike("supplier#00000001%").desc(), F.col("n").desc(), "person").limit(8)


@query("SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#99') GROUP BY p_brand")
def in_list_count(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#12", "Brand#99")).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) = lower('Red Widget')")
def nocase_eq(spark, sf):
    return table(spark, sf, "part").filter(F.lower("p_name") == "red widget").select("p_partkey")


@query(C + "SELECT genre, count(*) AS items, count(*) FILTER (coalesce(score, 0) = 0) AS unscored, count(*) FILTER (votes < 25) AS few FROM catalog GROUP BY genre")
def missing_report(spark, sf):
    return catalog(spark, sf).groupBy("genre").agg(F.count("*").alias("items"), F.count_if(F.coalesce("score", F.lit(0.0)) == 0).alias("unscored"), F.count_if(F.col("votes") < 25).alias("few"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END, DATE '1990-01-01') AS sorted_by FROM orders ORDER BY sorted_by DESC, o_orderkey DESC LIMIT 30")
def coalesce_order(spark, sf):
    when = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")), F.lit("1990-01-01").cast("date")).alias("sorted_by")
    return table(spark, sf, "orders").select("o_orderkey", when).orderBy(F.col("sorted_by").desc(), F.col("o_orderkey").desc()).limit(30)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 0 THEN NULL WHEN l_quantity / 8 BETWEEN 0.5 AND 5 AND l_quantity / 4 = floor(l_quantity / 4) THEN l_quantity / 8 END AS rating, l_quantity <> 0 AND NOT (l_quantity / 8 BETWEEN 0.5 AND 5 AND l_quantity / 4 = floor(l_quantity / 4)) AS bad FROM lineitem")
def rating_validate(spark, sf):
    value = F.col("l_quantity") / 8
    good = value.between(0.5, 5) & (value * 2 == F.floor(value * 2))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") == 0, None).when(good, value).alias("rating"), ((F.col("l_quantity") != 0) & ~good).alias("bad"))


@query("SELECT event_id, regexp_matches(day, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS valid FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events)")
def date_validate(spark, sf):
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf, "events").select("event_id", day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("valid"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_size::VARCHAR || ',x,' || (p_size * 2)::VARCHAR || ',', ','), lambda x: try_cast(x AS INT)::VARCHAR), lambda x: x IS NOT NULL), ';') AS ints FROM part")
def csv_int_list(spark, sf):
    text = F.concat(F.col("p_size").cast("string"), F.lit(",x,"), (F.col("p_size") * 2).cast("string"), F.lit(","))
    numbers = F.filter(F.transform(F.split(text, ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return table(spark, sf, "part").select("p_partkey", F.array_join(numbers.cast("array<string>"), ";").alias("ints"))


@query(R + "SELECT line_id, coalesce(CASE WHEN line_id % 3 <> 0 THEN rating END, CASE WHEN line_id % 2 = 0 THEN 4.5 END)::DOUBLE AS rating FROM ratings WHERE line_id % 3 <> 0 OR line_id % 2 = 0")
def implicit_rating(spark, sf):
    given, liked = F.when(F.col("line_id") % 3 != 0, F.col("rating")), F.col("line_id") % 2 == 0
    return ratings(spark, sf).select("line_id", F.coalesce(given, F.when(liked, 4.5)).alias("rating")).filter("rating IS NOT NULL")


@query(C + "SELECT item_id, genre FROM catalog WHERE (SELECT count(*) FROM catalog c WHERE c.genre = catalog.genre) <= 30 OR votes >= 25")
def conditional_group_filter(spark, sf):
    items = catalog(spark, sf)
    sizes = items.groupBy("genre").agg(F.count("*").alias("size"))
    return items.join(sizes, "genre").filter("size <= 30 OR votes >= 25").select("item_id", "genre")


@query(C + "SELECT item_id, title, round(score, 4) AS score, (year // 10) * 10 AS decade FROM catalog")
def result_projection(spark, sf):
    return catalog(spark, sf).select("item_id", "title", F.round("score", 4).alias("score"), (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS head, p_size + 1950 AS year, CASE WHEN p_size > 25 THEN p_brand END AS series FROM part")
def json_nested_project(spark, sf):
    payload = F.to_json(F.struct(F.struct(F.split("p_name", " ").alias("words")).alias("names"), F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-01-02")).alias("released"), F.when(F.col("p_size") > 25, F.struct(F.col("p_brand").alias("name"))).alias("series")))
    parsed = F.from_json(payload, "names struct<words:array<string>>, released string, series struct<name:string>")
    return table(spark, sf, "part").select("p_partkey", parsed.alias("j")).select("p_partkey", F.col("j.names.words")[0].alias("head"), F.substring("j.released", 1, 4).try_cast("int").alias("year"), F.col("j.series.name").alias("series"))


@query("SELECT l_partkey AS item_id, n, coalesce(p_name, '#' || l_partkey::VARCHAR) AS title FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = l_partkey")
def attach_titles(spark, sf):
    counted = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("n"))
    titles = table(spark, sf, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("item_id"), "p_name")
    return counted.join(titles, "item_id", "left").select("item_id", "n", F.coalesce("p_name", F.concat(F.lit("#"), F.col("item_id").cast("string"))).alias("title"))


@query("SELECT r_regionkey, name, value FROM region, LATERAL (SELECT 'name' AS name, r_name AS value UNION ALL SELECT 'key', r_regionkey::VARCHAR)")
def flatten_map(spark, sf):
    pairs = F.create_map(F.lit("name"), F.col("r_name"), F.lit("key"), F.col("r_regionkey").cast("string"))
    return table(spark, sf, "region").select("r_regionkey", F.explode(pairs).alias("name", "value"))


@query("SELECT c_custkey, coalesce(o.price, -1) AS price, o.price IS NULL AS fallback FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def coalesce_struct(spark, sf):
    remote = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price")).select("o_custkey", F.struct("price", F.lit(False).alias("fallback")).alias("remote"))
    local = F.struct(F.lit(-1.0).alias("price"), F.lit(True).alias("fallback"))
    joined = table(spark, sf, "customer").join(remote, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("remote", local).alias("r")).select("c_custkey", "r.price", "r.fallback")


@query("SELECT DISTINCT p_type AS genre FROM part ORDER BY genre")
def distinct_sorted(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("genre")).distinct().orderBy("genre")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 5) ORDER BY 1, 2, 3")
def owned_children(spark, sf):
    mine = table(spark, sf, "orders").filter("o_custkey = 5")
    return table(spark, sf, "lineitem").join(mine, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, round(coalesce(count(l.doc_id) / nullif(count(*), 0), 0), 6) AS rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def match_rate(spark, sf):
    labelled = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("one"))
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(labelled, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("one").alias("labelled"))
    return joined.withColumn("rate", F.round(F.coalesce(F.try_divide("labelled", "n"), F.lit(0.0)), 6))


@query("SELECT doc_id, CASE WHEN len(trim(text)) > 300 THEN left(text, 40) ELSE source || ' ' || lang END AS passage FROM documents")
def passage_coalesce(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.length(F.trim("text")) > 300, F.left("text", F.lit(40))).otherwise(F.concat_ws(" ", "source", "lang")).alias("passage"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def bridge_join(spark, sf):
    return table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query(P + "SELECT DISTINCT person, item_id, p_name AS title FROM credits JOIN part ON p_partkey = item_id WHERE role = 'director' AND p_brand = 'Brand#3'")
def three_way_join(spark, sf):
    parts = table(spark, sf, "part").filter("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return credits(spark, sf).filter("role = 'director'").join(parts, "item_id").select("person", "item_id", "title").distinct()


@query(P + "SELECT DISTINCT item_id FROM credits WHERE person = 'Supplier#000000007' AND role = 'actor'")
def person_filmography(spark, sf):
    return credits(spark, sf).filter("person = 'Supplier#000000007' AND role = 'actor'").select("item_id").distinct()


@query(CP + "SELECT s_suppkey AS person_id, coalesce(v, 0) AS votes FROM supplier LEFT JOIN (SELECT person_id, sum(votes)::BIGINT AS v FROM credits JOIN catalog USING (item_id) WHERE role = 'writer' AND rank = 1 GROUP BY 1) ON person_id = s_suppkey")
def left_join_agg(spark, sf):
    votes = credits(spark, sf).filter("role = 'writer' AND rank = 1").join(catalog(spark, sf).select("item_id", "votes"), "item_id").groupBy("person_id").agg(F.sum("votes").alias("v"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id")).join(votes, "person_id", "left").select("person_id", F.coalesce("v", F.lit(0)).alias("votes"))


@query(R + "SELECT line_id, item_id + 100000 AS external_id FROM ratings WHERE item_id % 4 <> 1 AND item_id IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def reconcile_ids(spark, sf):
    parts = table(spark, sf, "part")
    links = parts.filter("p_partkey % 4 <> 1").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") + 100000).alias("external_id"))
    known = parts.filter("p_size > 20").select((F.col("p_partkey") + 100000).alias("external_id"))
    return ratings(spark, sf).select("line_id", "item_id").join(links, "item_id").join(known, "external_id", "left_semi").select("line_id", "external_id")


@query("WITH u AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS dense_id FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, dense_id FROM orders JOIN u USING (o_custkey)")
def dense_remap(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    ids = numbered(orders.select("o_custkey").distinct(), "o_custkey", F.floor(F.col("o_custkey") / ID_BUCKET), "dense_id")
    return orders.join(ids, "o_custkey").select("o_orderkey", "dense_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey < 500)")
def semi_in_subquery(spark, sf):
    gone = table(spark, sf, "orders").filter("o_custkey < 500")
    return table(spark, sf, "lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query(P + "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM credits WHERE person_id = s_suppkey AND role = 'director')")
def role_semi_join(spark, sf):
    directors = credits(spark, sf).filter("role = 'director'")
    return table(spark, sf, "supplier").join(directors, F.col("s_suppkey") == F.col("person_id"), "left_semi").select("s_suppkey")


@query(P + "SELECT item_id FROM credits WHERE person_id BETWEEN 0 AND 20 AND role = 'director' INTERSECT SELECT item_id FROM credits WHERE person_id BETWEEN 10 AND 40 AND role = 'actor'")
def facet_intersect(spark, sf):
    c = credits(spark, sf)
    return c.filter("person_id BETWEEN 0 AND 20 AND role = 'director'").select("item_id").intersect(c.filter("person_id BETWEEN 10 AND 40 AND role = 'actor'").select("item_id"))


@query(R + "SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT item_id FROM ratings WHERE user_id = 12)")
def recommend_anti_join(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")).join(ratings(spark, sf).filter("user_id = 12"), "item_id", "left_anti")


@query(R + "SELECT line_id FROM ratings WHERE item_id IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')")
def semi_known_items(spark, sf):
    known = table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("item_id"))
    return ratings(spark, sf).join(known, "item_id", "left_semi").select("line_id")


@query(CP + "SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY votes DESC, item_id) AS k FROM catalog) WHERE k <= 72 AND item_id IN (SELECT item_id FROM credits WHERE role = 'writer' AND rank = 1) ORDER BY k LIMIT 12")
def availability_topn(spark, sf):
    pool = top_k(catalog(spark, sf), 72, [F.col("votes").desc(), F.col("item_id")])
    offered = credits(spark, sf).filter("role = 'writer' AND rank = 1").select("item_id").distinct()
    return pool.join(offered, "item_id", "left_semi").orderBy("rank").limit(12).select("item_id")


@query(C + ", q AS (SELECT * FROM (VALUES (1, 'red', 1961), (2, 'bolt', 1975), (3, 'gear', 1999), (4, 'zzz', 1960)) v(qid, hint, year)) SELECT qid, item_id FROM (SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY len(title), item_id) AS k FROM q JOIN catalog c ON c.year = q.year AND contains(lower(c.title), q.hint)) WHERE k = 1")
def substring_resolve(spark, sf):
    wanted = spark.createDataFrame([(1, "red", 1961), (2, "bolt", 1975), (3, "gear", 1999), (4, "zzz", 1960)], "qid int, hint string, year int")
    found = catalog(spark, sf).join(F.broadcast(wanted), "year").filter(F.contains(F.lower("title"), F.col("hint")))
    return top_k(found, 1, [F.length("title"), F.col("item_id")], ["qid"]).select("qid", "item_id")


@query("SELECT p_partkey, coalesce(n.price, p_retailprice) AS price FROM part LEFT JOIN (SELECT p_partkey AS k, p_retailprice * 2 AS price FROM part WHERE p_partkey % 10 = 3) n ON k = p_partkey")
def update_join(spark, sf):
    parts = table(spark, sf, "part")
    staged = parts.filter("p_partkey % 10 = 3").select("p_partkey", (F.col("p_retailprice") * 2).alias("price"))
    return parts.join(staged, "p_partkey", "left").select("p_partkey", F.coalesce("price", "p_retailprice").alias("price"))


@query(C + "SELECT item_id, rank AS canon_rank FROM catalog LEFT JOIN (SELECT * FROM (VALUES ('red widget', 1), ('hot gear', 2), ('blue bolt', 3)) v(t, rank)) ON t = title AND item_id = (SELECT min(item_id) FROM catalog c WHERE c.title = t)")
def canon_rank_join(spark, sf):
    canon = spark.createDataFrame([("red widget", 1), ("hot gear", 2), ("blue bolt", 3)], "title string, canon_rank int")
    items = catalog(spark, sf).select("item_id", "title")
    chosen = items.join(F.broadcast(canon), "title").groupBy("canon_rank").agg(F.min("item_id").alias("item_id"))
    return items.join(F.broadcast(chosen), "item_id", "left").select("item_id", "canon_rank")


_ACCOUNTS = """a AS (SELECT o_custkey AS u, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT user_id AS u, count(*) AS events FROM events GROUP BY 1), c AS (SELECT c_custkey AS u, 1 AS accounts FROM customer WHERE c_custkey % 2 = 0)"""


@query(f"WITH {_ACCOUNTS} SELECT coalesce(a.u, b.u, c.u) AS user_id, coalesce(orders, 0) AS orders, coalesce(events, 0) AS events, coalesce(accounts, 0)::BIGINT AS accounts FROM a FULL JOIN b ON a.u = b.u FULL JOIN c ON coalesce(a.u, b.u) = c.u")
def full_outer_counts(spark, sf):
    parts = [("orders", table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))), ("events", table(spark, sf, "events").select("user_id")), ("accounts", table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id")))]
    tagged = [df.withColumn("kind", F.lit(kind)) for kind, df in parts]
    # one shuffle for a tagged union in place of two full outer joins
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("user_id").agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind, _ in parts])


_PARTS_OF = "SELECT * FROM (VALUES (999001, '1999-03-01'), (103, '2003-05-01'), (555, NULL)) v(item_id, released)"


@query(f"WITH r AS (SELECT * FROM (VALUES (101, 1), (103, 2), (102, 3)) v(item_id, pos)), s AS ({_PARTS_OF}), u AS (SELECT item_id, CASE WHEN pos = 1 THEN 0 WHEN s.item_id IS NOT NULL THEN 1 ELSE 3 END AS tier, pos, NULL AS released FROM r LEFT JOIN s USING (item_id) UNION ALL SELECT item_id, 2, NULL, released FROM s ANTI JOIN r USING (item_id)) SELECT item_id, row_number() OVER (ORDER BY tier, pos, coalesce(released, '9999-99'), item_id) AS position FROM u LIMIT 40")
def sibling_pullup(spark, sf):
    results = spark.createDataFrame([(101, 1), (103, 2), (102, 3)], "item_id int, pos int")
    parts = spark.createDataFrame([(999001, "1999-03-01"), (103, "2003-05-01"), (555, None)], "item_id int, released string")
    tagged = results.join(parts.select("item_id", F.lit(True).alias("part")), "item_id", "left").select("item_id", F.when(F.col("pos") == 1, 0).when(F.col("part"), 1).otherwise(3).alias("tier"), "pos", F.lit(None).cast("string").alias("released"))
    unknown = parts.join(results, "item_id", "left_anti").select("item_id", F.lit(2).alias("tier"), F.lit(None).cast("int").alias("pos"), "released")
    order = [F.col("tier"), F.col("pos"), F.coalesce("released", F.lit("9999-99")), F.col("item_id")]
    return ranked(tagged.unionByName(unknown), order, name="position").filter("position <= 40").select("item_id", "position")


@query("WITH r AS (SELECT i AS item_id, i AS pos FROM range(1, 21) t(i)), p AS (SELECT * FROM (VALUES (9, 1), (4, 2), (77, 3)) v(item_id, pick)) SELECT r.item_id, row_number() OVER (ORDER BY coalesce(pick, 1000000), pos) AS position FROM r LEFT JOIN p USING (item_id)")
def promote_confirmed(spark, sf):
    results = spark.range(1, 21).select(F.col("id").alias("item_id"), F.col("id").alias("pos"))
    picks = spark.createDataFrame([(9, 1), (4, 2), (77, 3)], "item_id bigint, pick int")
    return ranked(results.join(F.broadcast(picks), "item_id", "left"), [F.coalesce("pick", F.lit(1_000_000)), F.col("pos")], name="position").select("item_id", "position")


# The weights of the curated ranking.
_PRIOR_VOTES, _CRITIC_SHARE, _OLD_BONUS, _CANON_BONUS = 20.0, 0.40, 0.02, 0.05
_ESSENTIALS = C + f""", g AS (SELECT avg(score) AS mean FROM catalog WHERE votes >= 20),
    e AS (SELECT item_id, genre, votes, votes / (votes + {_PRIOR_VOTES}) * coalesce(score, mean) + {_PRIOR_VOTES} / (votes + {_PRIOR_VOTES}) * mean AS base,
          CASE WHEN item_id % 3 = 0 THEN (item_id % 101) / 10.0 WHEN item_id % 3 = 1 THEN (item_id % 97) / 9.7 END AS critic, CASE WHEN item_id < 100 THEN item_id + 1 END AS canon, 2000 - year AS age FROM catalog CROSS JOIN g),
    s AS (SELECT item_id, genre, votes, round((CASE WHEN critic IS NULL THEN base ELSE {1 - _CRITIC_SHARE} * base + {_CRITIC_SHARE} * critic END)
          * (1 + least(age / 10, 5) * {_OLD_BONUS} + CASE WHEN canon IS NULL THEN 0 ELSE {_CANON_BONUS} * (1 - (canon - 1) / 100.0) END), 6) AS essential FROM e) """


def _essentials(spark, sf):
    items = catalog(spark, sf)
    mean = items.filter("votes >= 20").agg(F.avg("score").alias("mean"))
    votes, item = F.col("votes"), F.col("item_id")
    base = votes / (votes + _PRIOR_VOTES) * F.coalesce("score", "mean") + _PRIOR_VOTES / (votes + _PRIOR_VOTES) * F.col("mean")
    critic = F.coalesce(F.when(item % 3 == 0, (item % 101) / F.lit(10.0)), F.when(item % 3 == 1, (item % 97) / F.lit(9.7)))
    canon = F.when(item < 100, item + 1)
    blended = F.when(critic.isNull(), base).otherwise((1 - _CRITIC_SHARE) * base + _CRITIC_SHARE * critic)
    bonus = F.least((2000 - F.col("year")) / 10, F.lit(5.0)) * _OLD_BONUS + F.coalesce(_CANON_BONUS * (1 - (canon - 1) / F.lit(100.0)), F.lit(0.0))
    return items.crossJoin(F.broadcast(mean)).select("item_id", "genre", "votes", F.round(blended * (1 + bonus), 6).alias("essential"))


@query(_ESSENTIALS + "SELECT item_id, essential FROM s")
def essentials_score(spark, sf):
    return _essentials(spark, sf).select("item_id", "essential")


@query(_ESSENTIALS + "SELECT item_id, essential, row_number() OVER (ORDER BY essential DESC, item_id) AS rank FROM s WHERE genre = 'PROMO' AND (votes >= 10 OR (SELECT count(*) FROM s WHERE genre = 'PROMO') <= 30) ORDER BY essential DESC, item_id LIMIT 50")
def essentials_rank(spark, sf):
    pool = _essentials(spark, sf).filter("genre = 'PROMO'")
    gated = pool.crossJoin(F.broadcast(pool.agg(F.count("*").alias("size")))).filter("votes >= 10 OR size <= 30")
    return top_k(gated, 50, [F.col("essential").desc(), F.col("item_id")]).select("item_id", "essential", "rank")


@query("SELECT count(*) AS accounts, coalesce(sum((c_acctbal > 0)::INT), 0)::BIGINT AS positive, coalesce(sum((c_mktsegment = 'MACHINERY')::INT), 0)::BIGINT AS machinery FROM customer")
def flag_counts(spark, sf):
    return table(spark, sf, "customer").agg(F.count("*").alias("accounts"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"))


@query(C + "SELECT round(coalesce(avg(score) FILTER (votes >= 25), 6.3), 6) AS mean, coalesce(max(votes), 100) AS most FROM catalog")
def filtered_mean(spark, sf):
    return catalog(spark, sf).agg(F.round(F.coalesce(F.avg(F.when(F.col("votes") >= 25, F.col("score"))), F.lit(6.3)), 6).alias("mean"), F.coalesce(F.max("votes"), F.lit(100)).alias("most"))


@query(CP + "SELECT person_id, sum(votes)::BIGINT AS prominence FROM credits JOIN catalog USING (item_id) WHERE rank < 3 OR role = 'director' GROUP BY person_id")
def prominence(spark, sf):
    return credits(spark, sf).filter("rank < 3 OR role = 'director'").join(catalog(spark, sf).select("item_id", "votes"), "item_id").groupBy("person_id").agg(F.sum("votes").alias("prominence"))


_PRIORITY = ("SMALL", "PROMO", "LARGE", "MEDIUM", "ECONOMY", "STANDARD")


@query("WITH pairs AS (SELECT l_suppkey AS s, p_type AS t, min(l_linenumber) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), best AS (SELECT s, arg_min(t, list_position(['SMALL', 'PROMO', 'LARGE', 'MEDIUM', 'ECONOMY', 'STANDARD'], t)) AS t FROM pairs GROUP BY s) SELECT t AS genre, count(*) AS n FROM best GROUP BY t")
def primary_category(spark, sf):
    pairs = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_type").distinct()
    order = F.array_position(F.lit(list(_PRIORITY)), F.col("p_type"))
    return pairs.groupBy("l_suppkey").agg(F.min_by("p_type", order).alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))


@query(R + "SELECT count(*) AS n_rows, count(DISTINCT (user_id, item_id)) AS pairs, count(DISTINCT user_id) AS users FROM ratings")
def dup_count(spark, sf):
    return ratings(spark, sf).agg(F.count("*").alias("n_rows"), F.countDistinct("user_id", "item_id").alias("pairs"), F.countDistinct("user_id").alias("users"))


@query(R + "SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id HAVING count(*) >= 60")
def having_min_count(spark, sf):
    return ratings(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 60")


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def crosstab(spark, sf):
    return table(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1))).fillna(0)


@query(R + f", {_LATEST} SELECT user_id, item_id, rating, rated_at FROM latest_ratings")
def dedup_latest(spark, sf):
    return _latest(spark, sf).select("user_id", "item_id", "rating", "rated_at")


@query(P + "SELECT item_id, person_id, role FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(CASE WHEN rank <> 2 THEN rank END, 999), person, role) AS k FROM credits) WHERE k <= 3")
def topn_per_group(spark, sf):
    order = [F.coalesce(F.when(F.col("rank") != 2, F.col("rank")), F.lit(999)), F.col("person"), F.col("role")]
    return top_k(credits(spark, sf), 3, order, ["item_id"], "k").select("item_id", "person_id", "role")


@query("SELECT c_custkey AS conv_id, coalesce(max(turn), -1) + 1 AS next_turn FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY 1")
def append_position(spark, sf):
    last = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("conv_id")).join(last, "conv_id", "left").select("conv_id", (F.coalesce("last", F.lit(-1)) + 1).alias("next_turn"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(CASE WHEN turn % 2 = 1 THEN 100 - turn END, 100000), turn) AS position FROM conversations WHERE turn <> 2")
def reorder_positions(spark, sf):
    given = F.when(F.col("turn") % 2 == 1, 100 - F.col("turn"))
    return ranked(table(spark, sf, "conversations").filter("turn <> 2").select("conv_id", "turn"), [F.coalesce(given, F.lit(100_000)), F.col("turn")], ["conv_id"], "position")


@query(C + "SELECT item_id FROM catalog ORDER BY score DESC NULLS LAST, item_id LIMIT 80")
def candidate_pool(spark, sf):
    return catalog(spark, sf).orderBy(F.col("score").desc_nulls_last(), "item_id").limit(80).select("item_id")


@query(C + "SELECT genre, item_id FROM (SELECT genre, item_id, row_number() OVER (PARTITION BY genre ORDER BY (title = 'red widget') DESC, (year = 1978) DESC, votes DESC, item_id) AS k FROM catalog) WHERE k = 1")
def pick_best(spark, sf):
    exact, same_year = F.col("title") == "red widget", F.col("year") == 1978
    best = F.max_by("item_id", F.struct(exact, same_year, F.col("votes"), -F.col("item_id")))
    return catalog(spark, sf).groupBy("genre").agg(best.alias("item_id"))


@query(P + "SELECT item_id, person_id, role FROM (SELECT *, row_number() OVER (PARTITION BY item_id, person_id ORDER BY list_position(['director', 'writer', 'actor'], role)) AS k FROM credits) WHERE k = 1")
def provider_dedup(spark, sf):
    order = F.array_position(F.lit(["director", "writer", "actor"]), F.col("role"))
    return credits(spark, sf).groupBy("item_id", "person_id").agg(F.min_by("role", order).alias("role"))


@query(C + "SELECT DISTINCT item_id FROM ((SELECT item_id FROM catalog ORDER BY votes DESC, item_id LIMIT 60) UNION ALL (SELECT item_id FROM catalog ORDER BY score DESC NULLS LAST, item_id LIMIT 60) UNION ALL (SELECT item_id FROM catalog ORDER BY price DESC, item_id LIMIT 60))")
def candidate_union(spark, sf):
    items = catalog(spark, sf)
    tops = [items.orderBy(F.col(c).desc_nulls_last(), "item_id").limit(60).select("item_id") for c in ("votes", "score", "price")]
    return tops[0].union(tops[1]).union(tops[2]).distinct()


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(spark, sf):
    return table(spark, sf, "part").select("p_partkey").exceptAll(table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct())


_TAGS = "tags AS (SELECT s_suppkey AS id, list_sort(list(DISTINCT p_brand)) AS ts FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1)"


def _tags(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("id")).agg(F.sort_array(F.collect_set("p_brand")).alias("ts"))


@query(f"WITH {_TAGS}, me AS (SELECT ts AS mine FROM tags WHERE id = 3) SELECT id, array_to_string(list_filter(ts, lambda x: list_contains(mine, x))[1:3], ',') AS shared FROM tags, me WHERE id <> 3")
def shared_tags(spark, sf):
    tags = _tags(spark, sf)
    me = tags.filter("id = 3").select(F.col("ts").alias("mine"))
    return tags.filter("id <> 3").crossJoin(F.broadcast(me)).select("id", F.array_join(F.slice(F.array_intersect("ts", "mine"), 1, 3), ",").alias("shared"))


@query(f"WITH {_TAGS}, me AS (SELECT ts AS mine FROM tags WHERE id = 3) SELECT id, len(list_intersect(ts, mine))::INT AS overlap FROM tags, me WHERE id <> 3 ORDER BY overlap DESC, id LIMIT 10")
def tag_overlap_topn(spark, sf):
    tags = _tags(spark, sf)
    me = tags.filter("id = 3").select(F.col("ts").alias("mine"))
    return tags.filter("id <> 3").crossJoin(F.broadcast(me)).select("id", F.size(F.array_intersect("ts", "mine")).alias("overlap")).orderBy(F.col("overlap").desc(), "id").limit(10)


@query("SELECT user_id, sum(n)::BIGINT AS engagement FROM (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT user_id, count(*) FROM events GROUP BY 1) GROUP BY user_id ORDER BY engagement DESC, user_id LIMIT 25")
def top_engaged(spark, sf):
    a, b = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")), table(spark, sf, "events").select("user_id")
    return a.unionByName(b).groupBy("user_id").agg(F.count("*").alias("engagement")).orderBy(F.col("engagement").desc(), "user_id").limit(25)


@query(CP + ", mine AS (SELECT item_id, max(rating) AS rating FROM ratings WHERE user_id = 10 GROUP BY 1), w AS (SELECT *, greatest(0.25, rating - 2.5) AS w FROM mine JOIN catalog USING (item_id)), dims AS (SELECT 'genre' AS dim, genre AS value, w FROM w UNION ALL SELECT 'brand', brand, w FROM w UNION ALL SELECT 'decade', ((year // 10) * 10)::VARCHAR, w FROM w) SELECT dim, value, weight FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY weight DESC, value) AS k FROM (SELECT dim, value, round(sum(w), 6) AS weight FROM dims GROUP BY dim, value)) WHERE k <= 5")
def taste_summary(spark, sf):
    mine = ratings(spark, sf).filter("user_id = 10").groupBy("item_id").agg(F.max("rating").alias("rating"))
    weighted = mine.join(catalog(spark, sf), "item_id").withColumn("w", F.greatest(F.lit(0.25), F.col("rating") - 2.5))
    dims = F.create_map(F.lit("genre"), F.col("genre"), F.lit("brand"), F.col("brand"), F.lit("decade"), (F.floor(F.col("year") / 10) * 10).cast("int").cast("string"))
    tallies = weighted.select(F.explode(dims).alias("dim", "value"), "w").groupBy("dim", "value").agg(F.round(F.sum("w"), 6).alias("weight"))
    return top_k(tallies, 5, [F.col("weight").desc(), F.col("value")], ["dim"]).select("dim", "value", "weight")


@query("SELECT label, string_agg(genre, ' / ' ORDER BY k) AS name FROM (SELECT label, genre, row_number() OVER (PARTITION BY label ORDER BY n DESC, genre) AS k FROM (SELECT label, p_type AS genre, count(*) AS n FROM embeddings JOIN part ON p_partkey = vec_id GROUP BY label, p_type)) WHERE k <= 2 GROUP BY label")
def cluster_label(spark, sf):
    counts = table(spark, sf, "embeddings").select("vec_id", "label").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("vec_id")).groupBy("label", F.col("p_type").alias("genre")).agg(F.count("*").alias("n"))
    two = top_k(counts, 2, [F.col("n").desc(), F.col("genre")], ["label"], "k").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "genre"))).alias("g"))
    return two.select("label", F.array_join(F.transform("g", lambda x: x["genre"]), " / ").alias("name"))


@query(R + ", m AS (SELECT item_id, avg(rating) AS mean FROM ratings WHERE line_id % 5 <> 0 GROUP BY 1), e AS (SELECT rating - mean AS e FROM ratings JOIN m USING (item_id) WHERE line_id % 5 = 0) SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM e")
def rmse_mae(spark, sf):
    rows = ratings(spark, sf)
    means = rows.filter("line_id % 5 <> 0").groupBy("item_id").agg(F.avg("rating").alias("mean"))
    error = rows.filter("line_id % 5 = 0").join(means, "item_id").select((F.col("rating") - F.col("mean")).alias("e"))
    return error.agg(F.round(F.sqrt(F.avg(F.col("e") ** 2)), 6).alias("rmse"), F.round(F.avg(F.abs("e")), 6).alias("mae"))


_RULES = {"doc_id_null": "doc_id IS NULL", "text_short": "length(text) < 20", "lang_unknown": "lang NOT IN ('en', 'de', 'fr')", "source_form": "NOT regexp_like(source, '^src[0-9]+$')", "size_range": "n_chars NOT BETWEEN 1 AND 20000"}


def _duck(rule: str) -> str:
    return rule.replace("regexp_like", "regexp_matches")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER ({_duck(rule)}) AS failures FROM documents" for name, rule in _RULES.items()) + " UNION ALL SELECT 'doc_id_twice', count(*) - count(DISTINCT doc_id) FROM documents)")
def dq_checks(spark, sf):
    docs = table(spark, sf, "documents")
    one_pass = docs.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in _RULES.items()], (F.count("*") - F.countDistinct("doc_id")).alias("doc_id_twice"))
    names = [*_RULES, "doc_id_twice"]
    return one_pass.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)})").alias("rule", "failures"))


@query("WITH f AS (" + " UNION ALL ".join(f"SELECT '{name}' AS rule, doc_id FROM documents WHERE {_duck(rule)}" for name, rule in _RULES.items()) + ") SELECT rule, count(*) AS failures, array_to_string(list_sort(list(doc_id))[1:5], ',') AS sample FROM f GROUP BY rule")
def dq_failures(spark, sf):
    broken = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in _RULES.items()]))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(broken).alias("rule"))
    counts = rows.groupBy("rule").agg(F.count("*").alias("failures"))
    five = top_k(rows, 5, [F.col("doc_id")], ["rule"], "k").groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("sample"))
    return counts.join(five, "rule")


@query(R + ", old AS (SELECT user_id, item_id, rating, rated_at AS created, rated_at AS updated, line_id FROM ratings WHERE line_id % 2 = 0), new AS (SELECT user_id, item_id, rating, rated_at AS created, rated_at + 1 AS updated, line_id FROM ratings WHERE line_id % 2 = 1), u AS (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new), w AS (SELECT *, min(created) OVER (PARTITION BY user_id, item_id) AS first, row_number() OVER (PARTITION BY user_id, item_id ORDER BY n DESC, updated DESC, line_id DESC) AS k FROM u) SELECT user_id, item_id, first AS created, updated FROM w WHERE k = 1")
def upsert_latest(spark, sf):
    rows = ratings(spark, sf).withColumn("created", F.col("rated_at"))
    old, new = rows.filter("line_id % 2 = 0").withColumn("updated", F.col("rated_at")), rows.filter("line_id % 2 = 1").withColumn("updated", F.date_add("rated_at", 1))
    return upsert(old, new, ["user_id", "item_id"], "created", "updated").select("user_id", "item_id", "created", "updated")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return table(spark, sf, "orders").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_linenumber = best AS is_best FROM lineitem JOIN (SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS best FROM lineitem GROUP BY 1) USING (l_orderkey)")
def exclusive_flag(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    best = lines.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("best"))
    return lines.join(best, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == F.col("best")).alias("is_best"))


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def nested_export(spark, sf):
    grouped = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("orders"))
    return grouped.select("o_custkey", F.size("orders").cast("bigint").alias("n"), F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("orders"))


@query(P + "SELECT p_partkey AS item_id, coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '') AS roles FROM part LEFT JOIN credits ON item_id = p_partkey GROUP BY 1")
def group_concat_list(spark, sf):
    roles = credits(spark, sf).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")).join(roles, "item_id", "left").fillna("", ["roles"])


@query("SELECT conv_id, count(*) AS n, array_to_string(list(turn ORDER BY turn)[1:4], ',') AS first_turns FROM conversations GROUP BY conv_id")
def list_preview(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    four = top_k(turns, 4, [F.col("turn")], ["conv_id"], "k").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("turn")).cast("array<string>"), ",").alias("first_turns"))
    return counts.join(four, "conv_id")


@query("SELECT name, row_number() OVER (ORDER BY lower(strip_accents(name)), name) AS position FROM (SELECT DISTINCT string_split(text, ' ')[1] AS name FROM documents)")
def accent_sort(spark, sf):
    from marlstone.functions.text import strip_accents

    names = table(spark, sf, "documents").select(F.split("text", " ")[0].alias("name")).distinct()
    return ranked(names.withColumn("plain", F.lower(strip_accents("name"))), [F.col("plain"), F.col("name")], name="position").select("name", "position")


_SEEDED = "md5('{0}:' || {1}::VARCHAR)"


@query(R + f" SELECT * FROM ratings ORDER BY {_SEEDED.format(7, 'line_id')}, line_id LIMIT 500")
def sample_n(spark, sf):
    """Exactly 500 rows without replacement, the same ones every time."""
    return ratings(spark, sf).orderBy(F.md5(F.concat(F.lit("7:"), F.col("line_id").cast("string"))), "line_id").limit(500)


@query(f"SELECT item_id, CASE WHEN row_number() OVER (ORDER BY {_SEEDED.format(42, 'item_id')}, item_id) <= round_even((SELECT count(*) FROM benchmark) * 2 / 3, 0) THEN 'dev' ELSE 'test' END AS split FROM benchmark")
def seeded_split(spark, sf):
    """Benchmark items to a dev and a test part: by the order of a seeded hash, cut at two thirds."""
    items = table(spark, sf, "benchmark").select("item_id").withColumn("h", F.concat(F.md5(F.concat(F.lit("42:"), F.col("item_id").cast("string"))), F.lpad(F.col("item_id").cast("string"), 20, "0")))
    placed = numbered(items, "h", F.substring("h", 1, 2), "k").crossJoin(F.broadcast(items.agg(F.count("*").alias("n"))))
    return placed.select("item_id", F.when(F.col("k") < F.bround(F.col("n") * 2 / 3), "dev").otherwise("test").alias("split"))
