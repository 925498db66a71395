"""Usage analytics over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.relational import days, dense, nearest_rank, top_k
from marlstone.plans.base import BEFORE, LOG, SINCE, UNTIL, log, query, table

WITH = f"WITH {LOG} "


def _window(df: DataFrame, first: str = SINCE, end: str = UNTIL) -> DataFrame:
    return df.filter((F.col("day") >= F.lit(first).cast("date")) & (F.col("day") < F.lit(end).cast("date")))


def _kpis(df: DataFrame) -> DataFrame:
    searches = F.count_if(F.col("kind") == "search")
    zero = F.count_if((F.col("kind") == "search") & ~F.col("found"))
    from_search = F.count_if((F.col("kind") == "open") & (F.col("ref") == "search"))
    share = lambda n: F.coalesce(F.round(F.try_divide(n, searches), 3), F.lit(0.0))
    return df.agg(
        searches.alias("searches"), zero.alias("zero"), F.count_if(F.col("kind") == "open").alias("opens"), from_search.alias("open_from_search"), F.countDistinct("sid").alias("sessions"), F.countDistinct("user_id").alias("users"),
        F.count_if(F.col("kind") == "rec").alias("recs"), share(from_search).alias("ctr"), share(zero).alias("zero_rate"),
    )


_KPI = """SELECT count(*) FILTER (kind = 'search') AS searches, count(*) FILTER (kind = 'search' AND NOT found) AS zero, count(*) FILTER (kind = 'open') AS opens,
    count(*) FILTER (kind = 'open' AND ref = 'search') AS open_from_search, count(DISTINCT sid) AS sessions, count(DISTINCT user_id) AS users, count(*) FILTER (kind = 'rec') AS recs,
    coalesce(round(count(*) FILTER (kind = 'open' AND ref = 'search') / nullif(count(*) FILTER (kind = 'search'), 0), 3), 0.0) AS ctr,
    coalesce(round(count(*) FILTER (kind = 'search' AND NOT found) / nullif(count(*) FILTER (kind = 'search'), 0), 3), 0.0) AS zero_rate
    FROM log WHERE day >= '{0}' AND day < '{1}'"""
_IN = f"day >= DATE '{SINCE}' AND day < DATE '{UNTIL}'"


@query(WITH + _KPI.format(SINCE, UNTIL))
def kpi_window(spark, sf):
    return _kpis(_window(log(spark, sf)))


@query(WITH + f""", a AS ({_KPI.format(SINCE, UNTIL)}), b AS ({_KPI.format(BEFORE, SINCE)}), pairs AS (
    SELECT 'searches' AS kpi, a.searches::DOUBLE AS now, b.searches::DOUBLE AS before FROM a, b UNION ALL SELECT 'sessions', a.sessions, b.sessions FROM a, b
    UNION ALL SELECT 'users', a.users, b.users FROM a, b UNION ALL SELECT 'recs', a.recs, b.recs FROM a, b UNION ALL SELECT 'ctr', a.ctr, b.ctr FROM a, b UNION ALL SELECT 'zero_rate', a.zero_rate, b.zero_rate FROM a, b)
    SELECT kpi, now, before, round((now - before) / nullif(before, 0) * 100, 1) AS delta FROM pairs""")
def kpi_delta(spark, sf):
    events = log(spark, sf)
    flat = lambda df, name: df.select(F.expr("stack(6, 'searches', double(searches), 'sessions', double(sessions), 'users', double(users), 'recs', double(recs), 'ctr', ctr, 'zero_rate', zero_rate)").alias("kpi", name))
    now, before = flat(_kpis(_window(events)), "now"), flat(_kpis(_window(events, BEFORE, SINCE)), "before")
    return now.join(before, "kpi").withColumn("delta", F.round(F.try_divide(F.col("now") - F.col("before"), F.col("before")) * 100, 1))


@query(WITH + f"SELECT kind, count(*) AS n FROM log WHERE {_IN} GROUP BY kind")
def events_by_kind(spark, sf):
    return _window(log(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query(WITH + f"SELECT day, count(*) FILTER (kind = 'search') AS search, count(*) FILTER (kind = 'open') AS open, count(*) FILTER (kind = 'rec') AS rec, count(*) FILTER (NOT found) AS zero FROM log WHERE {_IN} GROUP BY day")
def events_by_day_pivot(spark, sf):
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("search", "open", "rec")]
    return _window(log(spark, sf)).groupBy("day").agg(*kinds, F.count_if(~F.col("found")).alias("zero"))


_TOP = "SELECT min(query) AS query, count(*) AS n FROM log WHERE kind = 'search' AND query <> '' AND {0} GROUP BY lower(query) ORDER BY n DESC, lower(min(query)) LIMIT 25"


def _top_queries(df: DataFrame) -> DataFrame:
    counted = df.filter("kind = 'search' AND query <> ''").groupBy(F.lower("query").alias("folded")).agg(F.min("query").alias("query"), F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "folded").limit(25).select("query", "n")


@query(WITH + _TOP.format(_IN))
def top_queries(spark, sf):
    return _top_queries(_window(log(spark, sf)))


@query(WITH + _TOP.format(_IN + " AND NOT found"))
def zero_result_queries(spark, sf):
    return _top_queries(_window(log(spark, sf)).filter(~F.col("found")))


@query(WITH + f""", b AS (SELECT unnest(['1', '2', '3', '4-5', '6-10', '11+']) AS bucket),
    c AS (SELECT CASE WHEN pos <= 3 THEN pos::VARCHAR WHEN pos <= 5 THEN '4-5' WHEN pos <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM log WHERE kind = 'open' AND ref = 'search' AND pos IS NOT NULL AND {_IN})
    SELECT bucket, count(c.bucket) AS n FROM b LEFT JOIN c USING (bucket) GROUP BY bucket""")
def click_position_hist(spark, sf):
    pos = F.col("pos")
    bucket = F.when(pos <= 3, pos.cast("string")).when(pos <= 5, "4-5").when(pos <= 10, "6-10").otherwise("11+")
    clicks = _window(log(spark, sf)).filter("kind = 'open' AND ref = 'search' AND pos IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(x,) for x in ("1", "2", "3", "4-5", "6-10", "11+")], "bucket string")
    return dense(clicks, grid, ["bucket"], ["n"])


@query(WITH + f""", f AS (SELECT count(DISTINCT sid) FILTER (kind = 'search') AS a, count(DISTINCT sid) FILTER (kind = 'search' AND found) AS b, count(DISTINCT sid) FILTER (kind = 'open' AND ref = 'search') AS c FROM log WHERE sid IS NOT NULL AND {_IN})
    SELECT 1 AS step, 'searched' AS name, a AS sessions FROM f UNION ALL SELECT 2, 'found', b FROM f UNION ALL SELECT 3, 'opened', c FROM f""")
def session_funnel(spark, sf):
    some = lambda test, name: F.countDistinct(F.when(F.expr(test), F.col("sid"))).alias(name)
    steps = _window(log(spark, sf)).filter("sid IS NOT NULL").agg(some("kind = 'search'", "a"), some("kind = 'search' AND found", "b"), some("kind = 'open' AND ref = 'search'", "c"))
    return steps.select(F.expr("stack(3, 1, 'searched', a, 2, 'found', b, 3, 'opened', c)").alias("step", "name", "sessions"))


@query(WITH + f"SELECT round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT sid, count(*) AS n FROM log WHERE kind = 'search' AND sid IS NOT NULL AND {_IN} GROUP BY sid)")
def searches_per_session(spark, sf):
    per = _window(log(spark, sf)).filter("kind = 'search' AND sid IS NOT NULL").groupBy("sid").agg(F.count("*").alias("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query(WITH + f""", firsts AS (SELECT sid, min(day) AS first_day FROM log GROUP BY sid)
    SELECT day, count(DISTINCT sid) FILTER (first_day >= DATE '{SINCE}') AS new, count(DISTINCT sid) FILTER (first_day < DATE '{SINCE}') AS returning FROM log JOIN firsts USING (sid) WHERE {_IN} GROUP BY day""")
def new_vs_returning(spark, sf):
    events = log(spark, sf).filter("sid IS NOT NULL")
    firsts = events.groupBy("sid").agg((F.min("day") >= F.lit(SINCE).cast("date")).alias("is_new"))  # over the whole log, not the window
    daily = _window(events).select("day", "sid").distinct().join(firsts, "sid")
    return daily.groupBy("day").agg(F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("returning"))


@query(WITH + f""", pairs AS (SELECT lower(query) AS after, lag(lower(query)) OVER (PARTITION BY sid ORDER BY event_id) AS before FROM log WHERE kind = 'search' AND query <> '' AND sid IS NOT NULL AND {_IN})
    SELECT before, after, count(*) AS n FROM pairs WHERE before <> after GROUP BY ALL ORDER BY n DESC, before, after LIMIT 15""")
def query_reformulations(spark, sf):
    searches = _window(log(spark, sf)).filter("kind = 'search' AND query <> '' AND sid IS NOT NULL").select("sid", "event_id", F.lower("query").alias("after"))
    pairs = searches.withColumn("before", F.lag("after").over(Window.partitionBy("sid").orderBy("event_id"))).filter("before <> after")
    return pairs.groupBy("before", "after").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "before", "after").limit(15)


# Words left out of the word cloud here.
STOP = ("the", "and", "for", "with")


@query(WITH + f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(query), '[a-z0-9à-ú]+')) AS word FROM log WHERE kind = 'search' AND query <> '' AND {_IN})
    WHERE len(word) >= 3 AND word NOT IN {STOP} GROUP BY word ORDER BY n DESC, word LIMIT 45""")
def word_freq(spark, sf):
    words = _window(log(spark, sf)).filter("kind = 'search' AND query <> ''").select(F.explode(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9à-ú]+"), 0)).alias("word"))
    return words.filter((F.length("word") >= 3) & ~F.col("word").isin(*STOP)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(45)


@query(WITH + f""", grid AS (SELECT w AS weekday, h AS hour FROM range(7) a(w), range(24) b(h))
    SELECT weekday::INT AS weekday, hour::INT AS hour, count(event_id) AS n FROM grid LEFT JOIN (SELECT event_id, isodow(ts) - 1 AS weekday, hour(ts) AS hour FROM log WHERE {_IN}) USING (weekday, hour) GROUP BY ALL""")
def heatmap(spark, sf):
    counts = _window(log(spark, sf)).groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return dense(counts, grid, ["weekday", "hour"], ["n"])


@query(WITH + f""", good AS (SELECT filters::JSON AS f FROM log WHERE kind = 'search' AND filters <> '' AND json_valid(filters) AND {_IN}), whole AS (SELECT count(*) AS n FROM log WHERE kind = 'search' AND {_IN}),
    parts AS (SELECT 'searches' AS what, n FROM whole UNION ALL SELECT 'any_filter', count(*) FROM good UNION ALL SELECT 'year_range', count(*) FILTER ((f ->> 'year_min') IS NOT NULL OR (f ->> 'year_max') IS NOT NULL) FROM good
        UNION ALL SELECT 'language', count(*) FILTER ((f ->> 'language') IS NOT NULL) FROM good)
    SELECT * FROM parts UNION ALL (SELECT 'genre:' || (f ->> 'genre') AS what, count(*) AS n FROM good WHERE (f ->> 'genre') IS NOT NULL GROUP BY 1 ORDER BY n DESC, what LIMIT 12)""")
def json_filter_usage(spark, sf):
    searches = _window(log(spark, sf)).filter("kind = 'search'")
    parsed = searches.filter("filters <> ''").select(F.from_json("filters", "genre string, year_min int, year_max int, language string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("f")).filter("f._bad IS NULL").select("f.*")
    sums = parsed.agg(F.count("*").alias("a"), F.count_if(F.expr("year_min IS NOT NULL OR year_max IS NOT NULL")).alias("y"), F.count("language").alias("l"))
    counts = sums.crossJoin(searches.agg(F.count("*").alias("s"))).select(F.expr("stack(4, 'searches', s, 'any_filter', a, 'year_range', y, 'language', l)").alias("what", "n"))
    genres = parsed.filter("genre IS NOT NULL").groupBy(F.concat(F.lit("genre:"), "genre").alias("what")).agg(F.count("*").alias("n"))
    return counts.unionByName(genres.orderBy(F.col("n").desc(), "what").limit(12))


@query(WITH + f""", q AS (SELECT len(query) AS n FROM log WHERE kind = 'search' AND query <> '' AND {_IN}) SELECT round(avg(n), 6) AS mean, list_sort(list(n))[len(list(n)) // 2 + 1] AS middle, round(avg(CASE WHEN n <= 12 THEN 1.0 ELSE 0.0 END), 6) AS short_share FROM q""")
def query_length_stats(spark, sf):
    lengths = _window(log(spark, sf)).filter("kind = 'search' AND query <> ''").select(F.length("query").cast("bigint").alias("n"))
    # the middle by counts of lengths: a query's length takes few values, so nothing is gathered
    counts = lengths.groupBy("n").agg(F.count("*").alias("c"))
    below, every = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    middle = counts.select("n", F.sum("c").over(below).alias("upto"), F.sum("c").over(every).alias("all")).filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("middle"))
    return lengths.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.avg((F.col("n") <= 12).cast("double")), 6).alias("short_share")).crossJoin(middle)


@query(WITH + f""", recent AS (SELECT event_id, latency FROM log WHERE kind = 'search' AND {_IN} ORDER BY event_id DESC LIMIT 5000), stages AS (
    SELECT 'retrieval' AS stage, latency AS ms FROM recent UNION ALL SELECT 'total', latency * 2 FROM recent), sorted AS (SELECT stage, list_sort(list(ms)) AS xs, count(*) AS n FROM stages GROUP BY stage)
    SELECT stage, n, xs[greatest(round_even(n * 0.5, 0)::INT - 1, 0) + 1] AS p50, xs[greatest(round_even(n * 0.95, 0)::INT - 1, 0) + 1] AS p95, xs[greatest(round_even(n * 0.99, 0)::INT - 1, 0) + 1] AS p99 FROM sorted""")
def stage_percentiles(spark, sf):
    recent = _window(log(spark, sf)).filter("kind = 'search'").orderBy(F.col("event_id").desc()).limit(5000)
    text = recent.select(F.to_json(F.struct(F.col("latency").alias("retrieval"), (F.col("latency") * 2).alias("total"))).alias("stage_ms"))
    stages = text.select(F.explode(F.from_json("stage_ms", "map<string,double>")).alias("stage", "ms"))
    xs = stages.groupBy("stage").agg(F.sort_array(F.collect_list("ms")).alias("xs"))  # at most 5000 a stage
    return xs.select("stage", F.size("xs").cast("bigint").alias("n"), *[nearest_rank(F.col("xs"), q).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])


@query(WITH + """, s AS (SELECT kind, list_sort(list(latency)) AS xs, count(*) AS n FROM log GROUP BY kind)
    SELECT kind, xs[greatest(round_even(n * 0.95, 0)::INT - 1, 0) + 1] AS by_round, xs[ceil(n * 0.95)::INT] AS by_ceil, xs[round_even((n - 1) * 0.95, 0)::INT + 1] AS by_span, xs[n // 2 + 1] AS upper_middle FROM s""")
def percentile_variants(spark, sf):
    # positions by a running count over each kind's distinct values, so no array holds a kind's rows
    counts = log(spark, sf).groupBy("kind", F.col("latency").alias("x")).agg(F.count("*").alias("c"))
    within = Window.partitionBy("kind")
    placed = counts.select("kind", "x", F.sum("c").over(within.orderBy("x")).alias("upto"), F.sum("c").over(within).alias("n"))
    indexes = {"by_round": F.bround(F.col("n") * 0.95) - 1, "by_ceil": F.ceil(F.col("n") * F.lit(0.95)) - 1, "by_span": F.bround((F.col("n") - 1) * 0.95), "upper_middle": F.floor(F.col("n") / 2)}
    return placed.groupBy("kind").agg(*[F.min(F.when(F.col("upto") > i, F.col("x"))).alias(name) for name, i in indexes.items()])


@query("""WITH d AS (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-03-31', INTERVAL 1 DAY))::DATE AS day), c AS (SELECT o_orderdate::DATE AS day, count(*) AS orders, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)
    SELECT day, coalesce(orders, 0) AS orders, round(coalesce(revenue, 0), 2) AS revenue FROM d LEFT JOIN c USING (day)""")
def dense_daily_series(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("revenue"))
    return dense(daily, days(spark, "1998-01-01", "1998-03-31"), ["day"], ["orders", "revenue"]).withColumn("revenue", F.round("revenue", 2))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_day(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS began, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session""")
def session_window(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    sessions = events.groupBy("user_id", F.session_window("at", "30 minutes")).agg(F.min("ts").alias("began"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return sessions.select("user_id", "began", "last_ts", "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_last_hour FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def sliding_rate(spark, sf):
    events = table(spark, sf, "events").withColumn("s", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))))
    return events.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)).alias("in_last_hour"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def retention_filter(spark, sf):
    return table(spark, sf, "events").filter(F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")).select("event_id", "user_id", "event_type")


_EDGES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 1000.0)


@query(f"""WITH edges AS (SELECT unnest({list(_EDGES)}::DOUBLE[]) AS le), c AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events CROSS JOIN edges GROUP BY ALL),
    w AS (SELECT *, coalesce(lag(n) OVER v, 0) AS n0, coalesce(lag(le) OVER v, 0) AS le0, max(n) OVER (PARTITION BY event_type) AS total FROM c WINDOW v AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, round(min(le0 + (le - le0) * (total * 0.95 - n0) / (n - n0)), 6) AS p95 FROM w WHERE n >= total * 0.95 AND n0 < total * 0.95 GROUP BY event_type""")
def hist_quantile(spark, sf):
    upto = [F.count_if(F.col("value") <= le).alias(f"n{i}") for i, le in enumerate(_EDGES)]
    counts = table(spark, sf, "events").groupBy("event_type").agg(*upto)
    flat = counts.select("event_type", F.posexplode(F.array(*[f"n{i}" for i in range(len(_EDGES))])).alias("i", "n"))
    over = Window.partitionBy("event_type").orderBy("i")
    edge = lambda at: F.element_at(F.lit(list(_EDGES)), at)
    steps = flat.withColumn("n0", F.coalesce(F.lag("n").over(over), F.lit(0))).withColumn("goal", F.max("n").over(Window.partitionBy("event_type")) * 0.95)
    low = F.when(F.col("i") == 0, 0.0).otherwise(edge(F.greatest(F.col("i"), F.lit(1))))
    value = low + (edge(F.col("i") + 1) - low) * (F.col("goal") - F.col("n0")) / (F.col("n") - F.col("n0"))
    return steps.filter("n >= goal AND n0 < goal").select("event_type", F.round(value, 6).alias("p95"))


_ITEMS = "SELECT item_id, count(*) AS n FROM log WHERE item_id IS NOT NULL AND {0} AND {1} GROUP BY item_id ORDER BY n DESC, item_id LIMIT 20"


@query(WITH + f"SELECT 'opened' AS list, * FROM ({_ITEMS.format(_IN, 'kind = ' + chr(39) + 'open' + chr(39))}) UNION ALL SELECT 'clicked', * FROM ({_ITEMS.format(_IN, 'ref = ' + chr(39) + 'search' + chr(39))}) UNION ALL SELECT 'first', * FROM ({_ITEMS.format(_IN, 'kind = ' + chr(39) + 'search' + chr(39))})")
def top_items(spark, sf):
    events = _window(log(spark, sf)).filter("item_id IS NOT NULL")
    lists = {"opened": "kind = 'open'", "clicked": "ref = 'search'", "first": "kind = 'search'"}
    parts = [top_k(events.filter(test).groupBy("item_id").agg(F.count("*").alias("n")), 20, [F.col("n").desc(), F.col("item_id")]).select(F.lit(name).alias("list"), "item_id", "n") for name, test in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 50")
def recent_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").orderBy(F.col("event_id").desc()).limit(50)


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1024")
def last_n_per_key(spark, sf):
    events = table(spark, sf, "events").select("event_type", "event_id", "value", "ts")
    return top_k(events, 1024, [F.col("ts").desc(), F.col("event_id").desc()], ["event_type"]).select("event_type", "event_id", "value")
