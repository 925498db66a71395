"""Evaluation runs, label sets, the mode dispatcher, and small catalog, seed and check plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.encode import encoded, hashed_words
from marlstone.functions.vector import dot
from marlstone.operators import evaluation, lexical
from marlstone.operators.relational import top_k
from marlstone.plans.base import CATALOG, CREDITS, RATINGS, catalog, credit_lines, credits, query, ratings, table
from marlstone.plans.retrieval import _DOT, _RANKS, V, _index, _ranks, _vectors, held_by
from marlstone.plans.textual import name_match

C = f"WITH {CATALOG} "
_METRICS = """count(*) AS n, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall10,
    round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END), 6) AS recall50, round(avg(CASE WHEN rank <= 10 THEN 0.1 ELSE 0 END), 6) AS precision10, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hits1,
    round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hits3, median(rank)::DOUBLE AS median_rank, round(avg(rank), 6) AS mean_rank"""


@query(f"WITH {_RANKS} SELECT {_METRICS} FROM best")
def harness_metrics(spark, sf):
    return evaluation.rank_metrics(_ranks(spark, sf))


@query(f"""WITH {_RANKS}, cover AS (SELECT item_id, key, count(*) AS s FROM asked JOIN tf USING (term) GROUP BY ALL), order2 AS (SELECT item_id, key, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, key) AS rank FROM cover),
    best2 AS (SELECT b.item_id, min(rank) AS rank FROM benchmark b LEFT JOIN hits USING (item_id) LEFT JOIN order2 o ON o.item_id = b.item_id AND o.key = hits.doc_id GROUP BY b.item_id)
    SELECT 'bm25' AS pipeline, {_METRICS} FROM best UNION ALL SELECT 'cover', {_METRICS} FROM best2""")
def evaluation_run(spark, sf):
    """Two ranking functions over the same queries: BM25, and the number of a query's words that a document holds."""
    index = _index(spark, sf)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))

    def bm25(asked):
        return lexical.search(index, asked, "qid", "query").select("qid", "key", F.round("lexical", 6).alias("score"))

    def cover(asked):
        terms = lexical.asked_terms(index, asked, "qid", "query")
        return index.postings.join(terms, "term").groupBy("qid", "key").agg(F.count("*").alias("score"))

    relevant = held_by(spark, sf).withColumnRenamed("item_id", "qid")
    runs = [evaluation.target_ranks(queries, relevant, fn).withColumn("pipeline", F.lit(name)) for name, fn in (("bm25", bm25), ("cover", cover))]
    return evaluation.rank_metrics(runs[0].unionByName(runs[1]), ["pipeline"])


#: A build passes if BM25 reaches this.
GATE = ("recall50", 0.1)


@query(f"WITH {_RANKS}, m AS (SELECT {_METRICS} FROM best) SELECT '{GATE[0]}' AS metric, {GATE[0]} AS value, {GATE[1]}::DOUBLE AS bound, {GATE[0]} >= {GATE[1]} AS passed FROM m")
def quality_gate(spark, sf):
    metric, bound = GATE
    return evaluation.rank_metrics(_ranks(spark, sf)).select(F.lit(metric).alias("metric"), F.col(metric).alias("value"), F.lit(bound).alias("bound"), (F.col(metric) >= bound).alias("passed"))


_HINTS = "hints AS (SELECT item_id AS qid, 'about ' || title AS query, title AS hint, year FROM (SELECT *, row_number() OVER (PARTITION BY title, year ORDER BY item_id) AS k FROM catalog) WHERE k = 1)"


@query(C + f", {_HINTS}, r AS (SELECT qid, query, arg_min(c.item_id, (len(c.title), c.item_id)) AS item_id FROM hints h JOIN catalog c ON c.year = h.year AND contains(lower(c.title), lower(h.hint)) GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || qid::VARCHAR) || qid::VARCHAR) - 1 AS k, count(*) OVER () AS n FROM r) SELECT qid, query, o.item_id, c.title, CASE WHEN k < round_even(n * 2 / 3, 0) THEN 'dev' ELSE 'test' END AS split FROM o JOIN catalog c USING (item_id)")
def label_set(spark, sf):
    """One query for every distinct title of a year; none may miss its item and no two may share one."""
    items = catalog(spark, sf).select("item_id", "title", "year")
    first = top_k(items, 1, [F.col("item_id")], ["title", "year"])
    hints = first.select(F.col("item_id").alias("qid"), F.concat(F.lit("about "), F.col("title")).alias("query"), F.col("title").alias("hint"), "year")
    return evaluation.label_set(hints, items)


MODES = ("name", "synopsis", "person", "keyword", "auto")


def search(spark, sf, asked: str, mode: str = "auto", n: int = 10, role: str | None = None, filters: dict | None = None):
    """(item_id, score, rank): one query by one of five modes; filters (genre, year_min, year_max) apply before the limit.

    name: titles by name score. synopsis: BM25 over the texts of the items' documents. person: items of the people of like names.
    keyword: the share of the query's words among an item's title and genre. auto: name and synopsis, each scaled to 1, with the
    weight of the name by the number of words. A document's item is the one of its number.
    """
    items, asked = catalog(spark, sf).select("item_id", "title", "genre", "year"), asked.strip()
    words, facets = F.lit(asked.lower()), filters or {}
    if not asked:
        return items.select("item_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).limit(0)
    wanted = items.filter(F.col("item_id").isNotNull() & F.col("year").between(facets.get("year_min", -9999), facets.get("year_max", 9999)))
    wanted = wanted.filter(F.col("genre") == facets["genre"]) if "genre" in facets else wanted
    # items are as many as the catalog has, whatever the size of its compressed files tells the planner: they are never broadcast
    among = lambda rows: rows.join(wanted.select("item_id").hint("merge"), "item_id", "left_semi")
    if mode == "name":
        scored = wanted.select("item_id", name_match(words, F.lower("title")).alias("score"))
    elif mode == "synopsis":
        queries = spark.createDataFrame([(0, asked)], "q int, t string")
        scored = among(lexical.search(_index(spark, sf), queries, "q", "t").select(F.col("key").alias("item_id"), F.col("lexical").alias("score")).filter("score > 0"))
    elif mode == "person":
        lines = credit_lines(spark, sf) if role is None else credit_lines(spark, sf).filter(F.col("role") == role)
        people = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id"), name_match(words, F.lower("s_name")).alias("score")).filter("score > 0")  # each name is scored once
        scored = among(lines.join(people, "person_id").groupBy("item_id").agg(F.max("score").alias("score")))
    elif mode == "keyword":
        mine, theirs = F.array_distinct(F.split(words, " ")), F.split(F.lower(F.concat_ws(" ", "title", "genre")), " ")
        scored = wanted.select("item_id", (F.size(F.array_intersect(mine, theirs)) / F.size(mine)).alias("score"))
    elif mode == "auto":
        weight = 0.6 if (count := len(asked.split())) <= 3 else 0.3 if count <= 5 else 0.05
        both = None
        for part, share in (("name", weight), ("synopsis", 1 - weight)):
            found = search(spark, sf, asked, part, 60)  # 60 rows, in one task
            scaled = found.select("item_id", (F.lit(share) * F.col("score") / F.max("score").over(Window.partitionBy())).alias("score"))
            both = scaled if both is None else both.unionByName(scaled)
        few = both.groupBy("item_id").agg(F.sum("score").alias("score"))
        scored = wanted.select("item_id").join(F.broadcast(few), "item_id").distinct()
    else:
        raise ValueError(f"unknown mode: {mode!r}")
    passed = scored.filter("score > 0").withColumn("score", F.round("score", 6))
    return top_k(passed, n, [F.col("score").desc(), F.col("item_id")])


@query()
def search_dispatch(spark, sf):
    """The same words by every mode."""
    found = None
    for mode in MODES:
        part = search(spark, sf, "small red gear" if mode != "person" else "Supplier#00000012", mode, filters={"year_min": 1960}).select(F.lit(mode).alias("mode"), "item_id", "score", "rank")
        found = part if found is None else found.unionByName(part)
    return found


@query("SELECT p_partkey AS item_id, word AS keyword, i::BIGINT AS position FROM (SELECT p_partkey, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part WHERE p_partkey BETWEEN 10 AND 20)) ORDER BY item_id, position")
def item_keywords(spark, sf):
    parts = table(spark, sf, "part").filter("p_partkey BETWEEN 10 AND 20").select(F.col("p_partkey").alias("item_id"), F.posexplode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("i", "keyword"))
    return parts.select("item_id", "keyword", (F.col("i") + 1).cast("bigint").alias("position")).orderBy("item_id", "position")


@query(f"WITH {CREDITS} SELECT asked, person_id, person, role, position FROM (SELECT asked, c.*, row_number() OVER (PARTITION BY asked, item_id ORDER BY c.rank, person_id, c.role) AS position FROM credits c JOIN (VALUES ('any', 33, NULL), ('directors', 34, 'director')) q(asked, item, only_role) ON item_id = item AND (only_role IS NULL OR only_role = c.role))")
def item_people(spark, sf):
    """People of an item in order of their credits, all or of one role."""
    asked = F.broadcast(spark.createDataFrame([("any", 33, None), ("directors", 34, "director")], "asked string, item_id bigint, only_role string"))
    found = credits(spark, sf).join(asked, "item_id").filter("only_role IS NULL OR only_role = role").withColumn("place", F.col("rank"))
    return top_k(found, 1 << 30, [F.col("place"), F.col("person_id"), F.col("role")], ["asked"], "position").select("asked", "person_id", "person", "role", "position")


@query("SELECT event_id, greatest(1, least(coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE ((props ->> 'k')::INT * 3 - 40)::VARCHAR END AS INT), 10), 50)) AS n FROM events")
def clamp_param(spark, sf):
    """A limit given as text: 1 to 50, and 10 if it is no number."""
    raw = F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.get_json_object("props", "$.k").cast("int") * 3 - 40).cast("string"))
    return table(spark, sf, "events").select("event_id", F.greatest(F.lit(1), F.least(F.coalesce(raw.try_cast("int"), F.lit(10)), F.lit(50))).alias("n"))


@query(C + "SELECT item_id, row_number() OVER (ORDER BY md5('5:' || item_id::VARCHAR), item_id) AS rank FROM (SELECT item_id FROM catalog ORDER BY votes DESC, item_id LIMIT 200) ORDER BY rank LIMIT 20")
def shuffle_popular(spark, sf):
    """Twenty of the 200 most voted, in a seeded random order."""
    popular = catalog(spark, sf).orderBy(F.col("votes").desc(), "item_id").limit(200).select("item_id")
    return top_k(popular, 20, [F.md5(F.concat(F.lit("5:"), F.col("item_id").cast("string"))), F.col("item_id")])


@query(f"WITH {V}, p AS (SELECT vec_id, e FROM v WHERE vec_id % 3 = 0), x AS (SELECT v.vec_id, v.label, p.vec_id IS NULL AS fell_back, {_DOT.format('coalesce(p.e, v.e)', 'q.e')} AS sim FROM v LEFT JOIN p USING (vec_id), (SELECT e FROM v WHERE vec_id = 7) q) SELECT vec_id, fell_back, round(sim, 6) AS whole_text, round({_DOT.format('v.e', 'q.e')} + 0.0 * sim, 6) AS score FROM x JOIN v USING (vec_id), (SELECT e FROM v WHERE vec_id = 7) q")
def whole_text_vector(spark, sf):
    """The channel of whole texts, which a third of the items have; the others fall back to the synopsis. Its weight is 0, so it is told and not counted."""
    rows = _vectors(spark, sf)
    whole = rows.filter("vec_id % 3 = 0").select("vec_id", F.col("e").alias("w"))
    asked = F.broadcast(rows.filter("vec_id = 7").select(F.col("e").alias("q")))
    scored = rows.join(whole, "vec_id", "left").crossJoin(asked).withColumn("sim", dot(F.coalesce("w", "e"), F.col("q")))
    return scored.select("vec_id", F.col("w").isNull().alias("fell_back"), F.round("sim", 6).alias("whole_text"), F.round(dot(F.col("e"), F.col("q")) + 0.0 * F.col("sim"), 6).alias("score"))


@query(f"WITH {RATINGS}, s AS (SELECT * FROM ratings ORDER BY md5('11:' || line_id::VARCHAR), line_id LIMIT 2000) SELECT count(*) AS sampled, (SELECT count(*) FROM ratings) AS total, count(*) FILTER (rating < 0.5 OR rating > 5) AS bad_rating, count(*) FILTER (item_id IS NULL OR item_id <= 0) AS bad_item, count(*) FILTER (rated_at > DATE '1998-01-01') AS late FROM s")
def dump_sample_checks(spark, sf):
    """Checks on a seeded sample of a dump, which is the feature, with the dump's whole size."""
    rows = ratings(spark, sf)
    sample = rows.orderBy(F.md5(F.concat(F.lit("11:"), F.col("line_id").cast("string"))), "line_id").limit(2000)
    checks = sample.agg(F.count("*").alias("sampled"), F.count_if((F.col("rating") < 0.5) | (F.col("rating") > 5)).alias("bad_rating"), F.count_if(F.col("item_id").isNull() | (F.col("item_id") <= 0)).alias("bad_item"), F.count_if(F.col("rated_at") > "1998-01-01").alias("late"))
    return checks.crossJoin(rows.agg(F.count("*").alias("total"))).select("sampled", "total", "bad_rating", "bad_item", "late")


@query("SELECT o_orderkey, CASE WHEN o_custkey = 1 OR o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 2 ELSE o_custkey END::BIGINT AS owner, o_custkey = 1 OR o_custkey NOT IN (SELECT c_custkey FROM customer) AS moved FROM orders")
def reassign_owner(spark, sf):
    """Rows of the placeholder owner, and of owners that do not exist, go to account 2."""
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    moved = (F.col("o_custkey") == 1) | F.col("known").isNull()
    return table(spark, sf, "orders").join(owners, "o_custkey", "left").select("o_orderkey", F.when(moved, 2).otherwise(F.col("o_custkey")).cast("bigint").alias("owner"), moved.alias("moved"))


_SEEDS = ((1, "director's cut", 120), (1, "theatrical", 110), (2, "restored", 95), (5, "extended", None))


@query(f"WITH seeds AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) if isinstance(x, int) else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in row) + ')' for row in _SEEDS)}) s(item_id, name, runtime)), old AS (SELECT p_partkey AS item_id, 'restored' AS name, p_size AS runtime FROM part WHERE p_partkey BETWEEN 2 AND 4) SELECT * FROM old UNION ALL SELECT * FROM seeds ANTI JOIN old USING (item_id, name)")
def seed_rows(spark, sf):
    """Seed rows are put in once: what the table has already stays as it is."""
    seeds = spark.createDataFrame(_SEEDS, "item_id bigint, name string, runtime int")
    old = table(spark, sf, "part").filter("p_partkey BETWEEN 2 AND 4").select(F.col("p_partkey").alias("item_id"), F.lit("restored").alias("name"), F.col("p_size").cast("int").alias("runtime"))
    return old.unionByName(seeds.join(old, ["item_id", "name"], "left_anti").select("item_id", "name", "runtime"))


@query("WITH t AS (SELECT lower(trim(p_name)) AS title, min(p_partkey) AS item_id FROM part GROUP BY 1) SELECT asked, item_id, CASE WHEN item_id IS NULL THEN 'none.png' ELSE 'p' || item_id::VARCHAR || '.png' END AS poster FROM (VALUES ('Red Gear'), (' small BOLT '), ('no such thing'), (NULL)) q(asked) LEFT JOIN t ON title = lower(trim(asked))")
def title_lookup(spark, sf):
    """Titles to ids and pictures, without regard to case and outer blanks."""
    titles = table(spark, sf, "part").groupBy(F.lower(F.trim("p_name")).alias("title")).agg(F.min("p_partkey").alias("item_id"))
    asked = spark.createDataFrame([("Red Gear",), (" small BOLT ",), ("no such thing",), (None,)], "asked string")
    found = asked.join(titles, F.col("title") == F.lower(F.trim("asked")), "left")
    return found.select("asked", "item_id", F.when(F.col("item_id").isNull(), "none.png").otherwise(F.concat(F.lit("p"), F.col("item_id").cast("string"), F.lit(".png"))).alias("poster"))


@query()
def encode_documents(spark, sf):
    """Documents through an encoder that each worker loads once; here hashed words stand for a model."""
    rows = table(spark, sf, "documents").select("doc_id", encoded("text", lambda: hashed_words(64)).alias("e"))
    return rows.select("doc_id", F.round(F.get("e", F.lit(0)), 6).alias("head"), F.round(dot(F.col("e"), F.col("e")), 6).alias("length"))
