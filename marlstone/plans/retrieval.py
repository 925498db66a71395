"""Vectors, BM25, signal fusion, explanation and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.vector import blend, centroids, dot, norm, unit
from marlstone.operators import evaluation, lexical, vectors
from marlstone.operators.relational import fuse_ranks, ranked, top_k, z_scores
from marlstone.plans.base import CATALOG, CREDITS, catalog, credits, query, stored, table
from marlstone.plans.textual import _STOP, STOP, _markup_sql, content_words, plain_text
from marlstone.session import kept

C = f"WITH {CATALOG} "
_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


def _one(spark, sf, vec_id: int, name: str = "q"):
    return F.broadcast(_vectors(spark, sf).filter(F.col("vec_id") == vec_id).select(F.col("e").alias(name)))


@query(f"WITH {V} SELECT v.vec_id, round({_DOT.format('v.e', 'q.e')}, 6) AS sim FROM v, v q WHERE q.vec_id = 0 AND v.vec_id <> 0 ORDER BY sim DESC, v.vec_id LIMIT 20")
def cosine_topk(spark, sf):
    scored = _vectors(spark, sf).filter("vec_id <> 0").crossJoin(_one(spark, sf, 0)).select("vec_id", F.round(dot(F.col("e"), F.col("q")), 6).alias("sim"))
    return scored.orderBy(F.col("sim").desc(), "vec_id").limit(20)


@query(f"WITH {V}, s AS (SELECT vec_id, list_transform(e, lambda x: x * 3) AS e FROM v) SELECT vec_id, round(sqrt({_DOT.format('e', 'e')}), 6) AS length, round(e[1] / sqrt({_DOT.format('e', 'e')}), 6) AS head FROM s")
def l2_normalize(spark, sf):
    scaled = _vectors(spark, sf).select("vec_id", F.transform("e", lambda x: x * 3).alias("e"))
    return scaled.select("vec_id", F.round(norm(F.col("e")), 6).alias("length"), F.round(unit(F.col("e"))[0], 6).alias("head"))


_MEAN = "m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(e[i]) AS x FROM v, range(1, 65) t(i) GROUP BY i))"


@query(f"WITH {V}, {_MEAN}, d AS (SELECT vec_id, list_transform(list_zip(e, m), lambda p: p[1] - p[2]) AS d FROM v, m) SELECT d.vec_id, round({_DOT.format('d.d', 'q.d')} / sqrt({_DOT.format('d.d', 'd.d')} * {_DOT.format('q.d', 'q.d')}), 6) AS sim FROM d, d q WHERE q.vec_id = 5 AND d.vec_id <> 5 ORDER BY sim DESC, d.vec_id LIMIT 30")
def centered_cosine(spark, sf):
    rows = _vectors(spark, sf)
    scored = _centred(rows.filter("vec_id <> 5").crossJoin(_one(spark, sf, 5)), centroids(rows, "e", [])).select("vec_id", "sim")
    return scored.orderBy(F.col("sim").desc(), "vec_id").limit(30)


def _centred(rows, mean):
    """``rows`` (e, q) with ``sim``, the cosine of both less the mean; expanded, so that no centred copy of the vectors is made."""
    a, q, m = F.col("e"), F.col("q"), F.col("m")
    top = dot(a, q) - dot(a, m) - dot(m, q) + dot(m, m)
    low = F.sqrt((dot(a, a) - 2 * dot(a, m) + dot(m, m)) * (dot(q, q) - 2 * dot(q, m) + dot(m, m)))
    return rows.crossJoin(F.broadcast(mean.withColumnRenamed("centroid", "m"))).withColumn("sim", F.round(top / low, 6))


@query(f"WITH {V}, c AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) t(i) GROUP BY ALL) SELECT label, i::INT - 1 AS at, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM c")
def vector_centroid(spark, sf):
    unit_means = centroids(_vectors(spark, sf), "e", ["label"]).select("label", F.posexplode(unit(F.col("centroid"))).alias("at", "x"))
    return unit_means.select("label", "at", F.round("x", 6).alias("value"))


@query(f"WITH {V}, b AS (SELECT v.vec_id, list_transform(list_zip(v.e, q.e), lambda p: 0.7 * p[1] + 0.3 * p[2]) AS b FROM v, v q WHERE q.vec_id = 1) SELECT vec_id, round(b[1] / sqrt({_DOT.format('b', 'b')}), 6) AS head, round(b[64] / sqrt({_DOT.format('b', 'b')}), 6) AS last FROM b")
def vector_blend(spark, sf):
    mixed = _vectors(spark, sf).crossJoin(_one(spark, sf, 1)).select("vec_id", blend(F.col("e"), F.col("q"), 0.3).alias("b"))
    return mixed.select("vec_id", F.round(F.col("b")[0], 6).alias("head"), F.round(F.col("b")[63], 6).alias("last"))


@query(f"WITH {V}, m AS (SELECT label, max({_DOT.format('v.e', 'q.e')}) AS best FROM v, (SELECT e FROM v WHERE vec_id = 7) q GROUP BY label) SELECT label, round(best, 6) AS best, round((best - avg(best) OVER ()) / stddev_pop(best) OVER (), 6) AS z FROM m")
def maxsim(spark, sf):
    best = _vectors(spark, sf).crossJoin(_one(spark, sf, 7)).groupBy("label").agg(F.max(dot(F.col("e"), F.col("q"))).alias("best"))
    return z_scores(best, ["best"]).select("label", F.round("best", 6).alias("best"), F.round("z_best", 6).alias("z"))


@query(f"WITH {V}, p AS (SELECT a.vec_id, b.vec_id AS neighbor, round({_DOT.format('a.e', 'b.e')}, 6) AS sim FROM v a, v b WHERE a.vec_id <> b.vec_id) SELECT vec_id, neighbor, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbor) AS rank FROM p) WHERE rank <= 5")
def knn_topk(spark, sf):
    return vectors.nearest(_vectors(spark, sf), "vec_id", "e", 5)


@query(C + ", f AS (SELECT item_id, price, votes::DOUBLE AS votes FROM catalog) SELECT item_id, round(greatest(-2, least(2, (price - avg(price) OVER ()) / stddev_pop(price) OVER ())), 6) AS z_price, round(greatest(-2, least(2, (votes - avg(votes) OVER ()) / stddev_pop(votes) OVER ())), 6) AS z_votes, 0.0::DOUBLE AS z_flat FROM f")
def zscore_clip(spark, sf):
    flat = catalog(spark, sf).select("item_id", "price", F.col("votes").cast("double").alias("votes"), F.lit(1.0).alias("flat"))
    return z_scores(flat, ["price", "votes", "flat"], clip=2.0).select("item_id", F.round("z_price", 6).alias("z_price"), F.round("z_votes", 6).alias("z_votes"), "z_flat")


@query(C + "SELECT item_id, genre, CASE WHEN max(votes) OVER w = min(votes) OVER w THEN 100 ELSE round((votes - min(votes) OVER w) * 100 / (max(votes) OVER w - min(votes) OVER w), 4) END::DOUBLE AS relevance FROM catalog WINDOW w AS (PARTITION BY genre)")
def minmax_relevance(spark, sf):
    items = catalog(spark, sf)
    ends = items.groupBy("genre").agg(F.min("votes").alias("low"), F.max("votes").alias("high"))
    return items.join(ends, "genre").select("item_id", "genre", F.when(F.col("high") == F.col("low"), 100.0).otherwise(F.round((F.col("votes") - F.col("low")) * 100 / (F.col("high") - F.col("low")), 4)).alias("relevance"))


@query(C + ", a AS (SELECT item_id, row_number() OVER (ORDER BY votes DESC, item_id) - 1 AS k FROM catalog), b AS (SELECT item_id, row_number() OVER (ORDER BY price DESC, item_id) - 1 AS k FROM catalog), f AS (SELECT item_id, sum(s) AS fused FROM (SELECT item_id, 1.0 / (20 + k) AS s FROM a WHERE k < 60 UNION ALL SELECT item_id, 0.6 / (20 + k) FROM b WHERE k < 60) GROUP BY item_id) SELECT item_id, round(fused, 6) AS fused FROM f ORDER BY fused DESC, item_id LIMIT 40")
def rrf_fusion(spark, sf):
    items = catalog(spark, sf)
    lists = [(top_k(items, 60, [F.col(c).desc(), F.col("item_id")]), w) for c, w in (("votes", 1.0), ("price", 0.6))]
    return fuse_ranks(lists, "item_id").select("item_id", F.round("fused", 6).alias("fused")).orderBy(F.col("fused").desc(), "item_id").limit(40)


#: The analyser of all BM25 queries: lower case, no accents, no stop words; documents and queries alike.
ANALYSED = f"list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))"
BM = f"""tok AS (SELECT doc_id AS key, unnest({ANALYSED}) AS term FROM documents), tf AS (SELECT key, term, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT key, sum(tf)::BIGINT AS dl FROM tf GROUP BY key), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(dl) FROM dl) AS avgdl),
    k AS (SELECT key, dl, 1.5 * (0.25 + 0.75 * dl / avgdl) AS k FROM dl, n), idf AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term, n),
    asked AS (SELECT DISTINCT item_id, unnest({ANALYSED}) AS term FROM benchmark),
    bm AS (SELECT item_id, key, sum(idf * tf * 2.5 / (tf + k)) AS lexical FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN k USING (key) GROUP BY ALL)"""


def _built_index(spark, sf):
    return lexical.build(table(spark, sf, "documents"), "doc_id", "text", STOP, fold=True)


def _index(spark, sf):
    """The stored index of the documents, which the first call of an application writes."""
    return lexical.load(spark, stored(spark, sf, "bm25", lambda path: _built_index(spark, sf).save(path)))


@query(f"WITH {BM} SELECT key AS doc_id, term, tf FROM tf")
def bm25_postings(spark, sf):
    return _built_index(spark, sf).postings.select(F.col("key").alias("doc_id"), "term", "tf")


@query(f"WITH {BM} SELECT 'doc' AS kind, key::VARCHAR AS name, dl AS n, round(k, 6) AS value FROM k UNION ALL SELECT 'term', term, df, round(idf, 6) FROM idf")
def bm25_stats(spark, sf):
    index = _built_index(spark, sf)
    docs = index.documents.select(F.lit("doc").alias("kind"), F.col("key").cast("string").alias("name"), F.col("dl").alias("n"), F.round("k", 6).alias("value"))
    return docs.unionByName(index.terms.select(F.lit("term").alias("kind"), F.col("term").alias("name"), F.col("df").alias("n"), F.round("idf", 6).alias("value")))


@query(f"WITH {BM} SELECT item_id, key AS doc_id, score, rank FROM (SELECT item_id, key, round(lexical, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(lexical, 6) DESC, key) AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(spark, sf):
    scored = lexical.search(_index(spark, sf), table(spark, sf, "benchmark"), "item_id", "text").withColumn("score", F.round("lexical", 6))
    return top_k(scored, 10, [F.col("score").desc(), F.col("key")], ["item_id"]).select("item_id", F.col("key").alias("doc_id"), "score", "rank")


@query(f"WITH {BM} SELECT item_id, key AS doc_id, score, rank FROM (SELECT item_id, key, round(lexical, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(lexical, 6) DESC, key) AS rank FROM bm) WHERE rank <= 10")
def bm25_built(spark, sf):
    """``bm25_topk`` with an index that is built within the query."""
    scored = lexical.search(_built_index(spark, sf), table(spark, sf, "benchmark"), "item_id", "text").withColumn("score", F.round("lexical", 6))
    return top_k(scored, 10, [F.col("score").desc(), F.col("key")], ["item_id"]).select("item_id", F.col("key").alias("doc_id"), "score", "rank")


@query("WITH documents AS (SELECT page_id AS doc_id, " + _markup_sql("html") + f" AS text FROM pages), {BM} SELECT item_id, key AS page_id, score FROM (SELECT item_id, key, round(lexical, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(lexical, 6) DESC, key) AS rank FROM bm) WHERE rank <= 5")
def bm25_second_field(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", plain_text(F.col("html")).alias("body"))
    scored = lexical.search(lexical.build(pages, "page_id", "body", STOP, fold=True), table(spark, sf, "benchmark"), "item_id", "text").withColumn("score", F.round("lexical", 6))
    return top_k(scored, 5, [F.col("score").desc(), F.col("key")], ["item_id"]).select("item_id", F.col("key").alias("page_id"), "score")


@query(f"""WITH tok AS (SELECT doc_id AS key, unnest({ANALYSED}) AS term FROM documents), tf AS (SELECT key, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT key, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), u AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM w)
    SELECT b.key AS doc_id, round(sum(a.w * b.w), 6) AS sim FROM u a JOIN u b USING (term) WHERE a.key = 0 AND b.key <> 0 GROUP BY b.key ORDER BY sim DESC, doc_id LIMIT 20""")
def tfidf_cosine(spark, sf):
    postings = _index(spark, sf).postings
    size = F.broadcast(table(spark, sf, "documents").agg(F.count("*").alias("n")))
    frequency = _index(spark, sf).terms.crossJoin(size).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weights = postings.join(frequency, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = weights.groupBy("key").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("length"))
    mine = weights.filter("key = 0").select("term", F.col("w").alias("mine"))
    sums = weights.filter("key <> 0").join(F.broadcast(mine), "term").groupBy("key").agg(F.sum(F.col("w") * F.col("mine")).alias("product"))
    own = F.broadcast(lengths.filter("key = 0").select(F.col("length").alias("own")))
    scored = sums.join(lengths, "key").crossJoin(own).select(F.col("key").alias("doc_id"), F.round(F.col("product") / F.col("length") / F.col("own"), 6).alias("sim"))
    return scored.orderBy(F.col("sim").desc(), "doc_id").limit(20)


# Weights of the channels, of the prior, and the clip of z-scores.
W = {"lexical": 1.0, "synopsis": 0.6, "keyword": 0.8, "maxsim": 0.5}
PRIOR, CLIP = 0.35, 8.0
_QUERY, _SYN, _KEY = 3, 3, 11

#: What a title is to a film, the head of a text is to a document: the share of the query's words in it stands for the name score.
_NAME = f"(len(list_intersect((SELECT list(term) FROM asked WHERE item_id = {_QUERY}), {ANALYSED.replace('text', 'left(text, 60)')}))::DOUBLE / (SELECT count(*) FROM asked WHERE item_id = {_QUERY}))"
#: The same of the first 400 characters stands for a second, dearer scorer.
_SECOND = _NAME.replace("left(text, 60)", "left(text, 400)")

S = f"""{BM}, {V}, scored AS (
    SELECT doc_id, lang, source, text, coalesce(b.lexical, 0) AS lexical, {_DOT.format('v.e', 's.e')} AS synopsis, {_DOT.format('v.e', 'w.e')} AS keyword, l.best AS maxsim, ln(1 + n_chars) AS prior
    FROM documents CROSS JOIN (SELECT e FROM v WHERE vec_id = {_SYN}) s CROSS JOIN (SELECT e FROM v WHERE vec_id = {_KEY}) w LEFT JOIN v ON v.vec_id = doc_id
         LEFT JOIN (SELECT * FROM bm WHERE item_id = {_QUERY}) b ON b.key = doc_id
         LEFT JOIN (SELECT label AS lab, max({_DOT.format('v.e', 'q.e')}) AS best FROM v, (SELECT e FROM v WHERE vec_id = {_SYN}) q GROUP BY label) l ON l.lab = v.label),
    z AS (SELECT *, {', '.join(f"CASE WHEN {c} IS NULL THEN 0 ELSE greatest(-{CLIP}, least({CLIP}, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())) END AS z_{c}" for c in (*W, 'prior'))} FROM scored),
    fused AS (SELECT *, {' + '.join(f"{w} * greatest(z_{c}, 0)" for c, w in W.items())} AS content, {' + '.join(f"{w} * greatest(z_{c}, 0)" for c, w in W.items())} + {PRIOR} * z_prior AS fusion FROM z)"""


def _scored(spark, sf):
    """All signals of one query for every document. z-scores are over the documents that have the signal; without it they are 0, and the document stays."""
    docs, rows = table(spark, sf, "documents"), _vectors(spark, sf)
    asked = table(spark, sf, "benchmark").filter(F.col("item_id") == _QUERY)
    hits = lexical.search(_index(spark, sf), asked, "item_id", "text").select(F.col("key").alias("doc_id"), "lexical")
    sims = rows.crossJoin(_one(spark, sf, _SYN, "s")).crossJoin(_one(spark, sf, _KEY, "w"))
    sims = sims.select(F.col("vec_id").alias("doc_id"), "label", dot(F.col("e"), F.col("s")).alias("synopsis"), dot(F.col("e"), F.col("w")).alias("keyword"))
    best = sims.groupBy("label").agg(F.max("synopsis").alias("maxsim"))
    joined = docs.drop("text").join(sims.join(best, "label"), "doc_id", "left").join(hits, "doc_id", "left").fillna(0.0, ["lexical"]).withColumn("prior", F.log1p("n_chars"))
    joined = kept(joined, "signals")  # numbers only; the moments and every list read it again
    return z_scores(joined, [*W, "prior"], clip=CLIP).fillna(0.0, [f"z_{c}" for c in (*W, "prior")])


def _with_cover(rows, spark, sf, head: int, name: str, few: bool = False):
    """``rows``, of which there are few if ``few``, with ``name``, the share of the query's distinct words that stand in the first ``head`` characters of the document."""
    index = _index(spark, sf)
    asked = lexical.asked_terms(index, table(spark, sf, "benchmark").filter(F.col("item_id") == _QUERY), "item_id", "text")
    words = F.broadcast(asked.agg(F.collect_set("term").alias("__asked")))  # one row, the words of one query
    docs = table(spark, sf, "documents")
    docs = docs.join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi") if few else docs
    heads = docs.select("doc_id", index.analyser.words(F.left("text", F.lit(head))).alias("__head"))
    cover = heads.crossJoin(words).select("doc_id", (F.size(F.array_intersect("__asked", "__head")) / F.size("__asked")).alias(name))
    return rows.join(cover, "doc_id")


def _fused(spark, sf, weights=W):
    content = sum((F.lit(w) * F.greatest(F.col(f"z_{c}"), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return _scored(spark, sf).withColumn("content", content).withColumn("fusion", F.col("content") + PRIOR * F.col("z_prior"))


@query(f"WITH {S} SELECT doc_id, round(z_lexical, 5) AS z_lexical, round(z_synopsis, 5) AS z_synopsis, round(fusion, 5) AS fusion FROM fused")
def fusion_score(spark, sf):
    return _fused(spark, sf).select("doc_id", *[F.round(c, 5).alias(c) for c in ("z_lexical", "z_synopsis", "fusion")])


@query(f"WITH {S} SELECT doc_id, round(fusion, 5) AS fusion FROM fused WHERE fusion > 0 ORDER BY round(fusion, 5) DESC, doc_id LIMIT 40")
def fusion_topk(spark, sf):
    return _fused(spark, sf).filter("fusion > 0").select("doc_id", F.round("fusion", 5).alias("fusion")).orderBy(F.col("fusion").desc(), "doc_id").limit(40)


@query(C + ", p AS (SELECT item_id, ln(1 + votes) AS x FROM catalog) SELECT item_id, round(0.35 * (x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS prior FROM p")
def popularity_prior(spark, sf):
    return z_scores(catalog(spark, sf).select("item_id", F.log1p("votes").alias("x")), ["x"]).select("item_id", F.round(PRIOR * F.col("z_x"), 6).alias("prior"))


@query(f"WITH {S} SELECT doc_id, round(least(1, greatest(1 / (1 + exp(-0.85 * (greatest(z_lexical, z_synopsis, z_keyword) - 1.4))), {_NAME})), 5) AS confidence FROM fused")
def confidence(spark, sf):
    logistic = 1 / (1 + F.exp(-0.85 * (F.greatest("z_lexical", "z_synopsis", "z_keyword") - 1.4)))
    rows = _with_cover(_scored(spark, sf), spark, sf, 60, "name")
    return rows.select("doc_id", F.round(F.least(F.lit(1.0), F.greatest(logistic, F.col("name"))), 5).alias("confidence"))


_CONTENT = f"len(list_filter(regexp_extract_all(strip_accents(lower(text)), '[^ \\t\\n]+'), lambda w: len(w) > 2 AND NOT list_contains({_STOP}, w)))"


@query(f"SELECT item_id, CASE WHEN n <= 3 THEN 0.30 WHEN n <= 6 THEN 0.25 ELSE 0.20 END::DOUBLE AS lexical_weight, CASE WHEN n <= 3 THEN 0.6 WHEN n <= 5 THEN 0.3 ELSE 0.05 END::DOUBLE AS name_weight FROM (SELECT item_id, {_CONTENT} AS n FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:1 + item_id % 12], ' ') AS text FROM benchmark))")
def adaptive_weight(spark, sf):
    """By the number of content words; the items' first one to twelve words are the queries."""
    asked = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, (F.col("item_id") % 12 + 1).cast("int")), " ").alias("text"))
    n = F.col("n")
    return asked.select("item_id", F.size(content_words(F.col("text"))).alias("n")).select("item_id", F.when(n <= 3, 0.30).when(n <= 6, 0.25).otherwise(0.20).alias("lexical_weight"), F.when(n <= 3, 0.6).when(n <= 5, 0.3).otherwise(0.05).alias("name_weight"))


@query("SELECT p_partkey, CASE WHEN best >= 0.92 THEN 0.9 WHEN best >= 0.85 THEN greatest(base, 0.6) ELSE base END::DOUBLE AS weight, CASE WHEN best >= 0.85 THEN 'name' ELSE 'description' END AS intent FROM (SELECT p_partkey, p_size / 50.0 AS best, CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 0.05 END AS base FROM part)")
def intent_weight(spark, sf):
    best, base = F.col("p_size") / 50, F.when(F.col("p_size") % 2 == 0, 0.3).otherwise(0.05)
    return table(spark, sf, "part").select("p_partkey", F.when(best >= 0.92, 0.9).when(best >= 0.85, F.greatest(base, F.lit(0.6))).otherwise(base).alias("weight"), F.when(best >= 0.85, "name").otherwise("description").alias("intent"))


_SHARES = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS signal, {w} * greatest(z_{c}, 0) AS x FROM z" for c, w in W.items())


@query(f"WITH {S}, x AS ({_SHARES}) SELECT doc_id, signal, round(x / sum(x) OVER (PARTITION BY doc_id), 4) AS share FROM x WHERE x > 0")
def signal_shares(spark, sf):
    parts = F.array(*[F.struct(F.lit(c).alias("signal"), (w * F.greatest(F.col(f"z_{c}"), F.lit(0.0))).alias("x")) for c, w in W.items()])
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, y: s + y["x"])
    rows = _scored(spark, sf).select("doc_id", parts.alias("p")).select("doc_id", F.explode("p").alias("s"), total(F.col("p")).alias("total"))
    return rows.filter("s.x > 0").select("doc_id", "s.signal", F.round(F.col("s.x") / F.col("total"), 4).alias("share"))


#: Clues about a person, as (item whose text is the clue, vector that stands for its encoding).
_CLUES = ((3, 3), (5, 11), (8, 20))
_PEOPLE = 97


@query(f"""WITH {BM}, {V}, {CREDITS}, clues AS (SELECT * FROM (VALUES {', '.join(map(str, _CLUES))}) c(item_id, vec)), people AS (SELECT DISTINCT doc_id % {_PEOPLE} + 1 AS person FROM documents),
    lex AS (SELECT c.item_id, person, coalesce(max(lexical), 0) AS x FROM clues c CROSS JOIN people LEFT JOIN bm ON bm.item_id = c.item_id AND bm.key % {_PEOPLE} + 1 = person GROUP BY ALL),
    sem AS (SELECT c.item_id, v.vec_id % {_PEOPLE} + 1 AS person, max({_DOT.format('v.e', 'q.e')}) AS x FROM clues c JOIN v q ON q.vec_id = c.vec CROSS JOIN v GROUP BY ALL),
    zl AS (SELECT item_id, person, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS z FROM lex WINDOW w AS (PARTITION BY item_id)), zs AS (SELECT item_id, person, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS z FROM sem WINDOW w AS (PARTITION BY item_id)),
    best AS (SELECT person, round(min(greatest(0, coalesce(zl.z, 0), coalesce(zs.z, 0))), 6) AS score FROM zl LEFT JOIN zs USING (item_id, person) GROUP BY person),
    top AS (SELECT * FROM best WHERE score > 0 ORDER BY score DESC, person LIMIT 50)
    SELECT item_id, max(score) AS boost FROM top JOIN credits ON person_id = top.person WHERE role = 'actor' AND rank < 10 OR role = 'director' GROUP BY item_id""")
def person_bio_match(spark, sf):
    """Items of the people whose biographies fit every clue.

    A person's biography is the documents that fall to them, each a passage. A
    clue's score is the better of words (BM25) and meaning (the best passage's
    product), both as positive z-scores over people; the weakest clue counts.
    """
    clues = F.broadcast(spark.createDataFrame(_CLUES, "item_id int, vec int"))
    person = lambda key: (F.col(key) % _PEOPLE + 1).alias("person")
    people = table(spark, sf, "documents").select(person("doc_id")).distinct()
    asked = table(spark, sf, "benchmark").join(clues.select("item_id"), "item_id", "left_semi")
    hits = lexical.search(_index(spark, sf), asked, "item_id", "text").groupBy("item_id", person("key")).agg(F.max("lexical").alias("lex"))
    queries = F.broadcast(_vectors(spark, sf).join(clues, F.col("vec_id") == F.col("vec")).select("item_id", F.col("e").alias("q")))
    close = _vectors(spark, sf).crossJoin(queries).groupBy("item_id", person("vec_id")).agg(F.max(dot(F.col("e"), F.col("q"))).alias("sem"))  # three clues
    rows = people.crossJoin(clues.select("item_id")).join(hits, ["item_id", "person"], "left").fillna(0.0, ["lex"]).join(close, ["item_id", "person"], "left")
    fit = F.greatest(F.lit(0.0), F.coalesce("z_lex", F.lit(0.0)), F.coalesce("z_sem", F.lit(0.0)))
    best = z_scores(rows, ["lex", "sem"], by=["item_id"]).groupBy("person").agg(F.round(F.min(fit), 6).alias("score")).filter("score > 0")
    top = F.broadcast(best.orderBy(F.col("score").desc(), "person").limit(50))
    roles = credits(spark, sf).filter("role = 'actor' AND rank < 10 OR role = 'director'")
    return roles.join(top.withColumnRenamed("person", "person_id"), "person_id").groupBy("item_id").agg(F.max("score").alias("boost"))


_TOKENS = ("redd", "gear", "widgets")


@query(C + f", t AS (SELECT DISTINCT unnest(string_split(lower(title), ' ')) AS tok FROM catalog), q AS (SELECT unnest({list(_TOKENS)}) AS q), m AS (SELECT q, tok, jaro_winkler_similarity(q, tok) AS s FROM q, t WHERE jaro_winkler_similarity(q, tok) >= 0.93), h AS (SELECT item_id, q FROM catalog JOIN m ON list_contains(string_split(lower(title), ' '), tok)) SELECT item_id, round(count(DISTINCT q) / 3, 6) AS entity FROM h GROUP BY item_id HAVING count(DISTINCT q) >= 2")
def entity_channel(spark, sf):
    from marlstone.functions.fuzzy import similarity

    words = catalog(spark, sf).select("item_id", F.explode(F.split(F.lower("title"), " ")).alias("tok"))
    asked = F.broadcast(spark.createDataFrame([(t,) for t in _TOKENS], "q string"))
    near = words.select("tok").distinct().crossJoin(asked).filter(similarity(F.col("q"), F.col("tok"), "jaro_winkler") >= 0.93)  # distinct tokens only
    hits = words.join(near, "tok").groupBy("item_id").agg(F.countDistinct("q").alias("n")).filter("n >= 2")
    return hits.select("item_id", F.round(F.col("n") / len(_TOKENS), 6).alias("entity"))


_BLEND = f", c AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY round(fusion, 5) DESC, doc_id) AS a, row_number() OVER (ORDER BY round(z_lexical, 5) DESC, doc_id) AS b, row_number() OVER (ORDER BY round(z_synopsis, 5) DESC, doc_id) AS d FROM fused) WHERE a <= 60 OR b <= 60 OR d <= 60), r AS (SELECT doc_id, lang, source, round({{0}}, 5) AS f, {{1}} AS name FROM fused JOIN c USING (doc_id))"


@query(f"WITH {S}{_BLEND.format('fusion', _NAME)} SELECT doc_id, round(0.3 * name + 0.7 * CASE WHEN max(f) OVER () = min(f) OVER () THEN 0 ELSE (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) END, 4) AS blended FROM r")
def auto_blend(spark, sf):
    return _blended(spark, sf, "fusion").select("doc_id", F.round("blended", 4).alias("blended"))


def _blended(spark, sf, signal: str, name_weight: float = 0.3):
    """Name score and min-max fused score over the union of the top lists of several signals."""
    fused = _fused(spark, sf).select("doc_id", "lang", "source", *[F.round(c, 5).alias(c) for c in ("fusion", "content", "z_lexical", "z_synopsis")])
    tops = [fused.orderBy(F.col(c).desc(), "doc_id").limit(60).select("doc_id") for c in ("fusion", "z_lexical", "z_synopsis")]
    pool = _with_cover(kept(fused.join(F.broadcast(tops[0].union(tops[1]).union(tops[2]).distinct()), "doc_id"), "pool"), spark, sf, 60, "name", few=True)
    ends = F.broadcast(pool.agg(F.min(signal).alias("low"), F.max(signal).alias("high")))
    scaled = F.when(F.col("high") == F.col("low"), 0.0).otherwise((F.col(signal) - F.col("low")) / (F.col("high") - F.col("low")))
    return pool.crossJoin(ends).withColumn("blended", name_weight * F.col("name") + (1 - name_weight) * scaled)


@query(f"WITH {S}{_BLEND.format('content', _NAME)} SELECT doc_id, round(0.2 * name + 0.8 * CASE WHEN max(f) OVER () = min(f) OVER () THEN 0 ELSE (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) END, 4) AS blended FROM r")
def constrained_rank(spark, sf):
    """Without the prior, and with the name's base weight."""
    return _blended(spark, sf, "content", 0.2).select("doc_id", F.round("blended", 4).alias("blended"))


@query(f"WITH {S} SELECT doc_id, round(content, 5) AS score FROM fused WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') ORDER BY round(content, 5) DESC, doc_id LIMIT 10")
def facet_search(spark, sf):
    """The facets apply after the z-scores, which are over all documents, and before the limit."""
    found = _fused(spark, sf).filter((F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", F.round("content", 5).alias("score"))
    return found.orderBy(F.col("score").desc(), "doc_id").limit(10)


@query(f"WITH {S}, h AS (SELECT doc_id, text, round(fusion, 5) AS f FROM fused ORDER BY f DESC, doc_id LIMIT 200), hk AS (SELECT *, row_number() OVER (ORDER BY f DESC, doc_id) AS k FROM h), c AS (SELECT doc_id, f, k, {_SECOND} AS ce FROM hk WHERE k <= 50), m AS (SELECT *, CASE WHEN max(ce) OVER () = min(ce) OVER () THEN 0 ELSE (ce - min(ce) OVER ()) / (max(ce) OVER () - min(ce) OVER ()) END AS a, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) AS b FROM c), u AS (SELECT doc_id, 0 AS tail, round(0.5 * a + 0.5 * b, 5) AS s, k FROM m UNION ALL SELECT doc_id, 1, 0, k FROM hk WHERE k > 50) SELECT doc_id, row_number() OVER (ORDER BY tail, s DESC, k) AS position FROM u")
def rerank_blend(spark, sf):
    """The first 200, of which the first 50 are reordered by half a second score and the others keep their places."""
    order = top_k(_fused(spark, sf).select("doc_id", F.round("fusion", 5).alias("f")), 200, [F.col("f").desc(), F.col("doc_id")], name="k")
    head = _with_cover(order.filter("k <= 50"), spark, sf, 400, "ce", few=True)
    ends = F.broadcast(head.agg(*[f(c).alias(f"{n}_{c}") for c in ("f", "ce") for n, f in (("lo", F.min), ("hi", F.max))]))
    scaled = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    mixed = head.crossJoin(ends).select("doc_id", F.lit(0).alias("tail"), F.round(0.5 * scaled("ce") + 0.5 * scaled("f"), 5).alias("s"), "k")
    both = mixed.unionByName(order.filter("k > 50").select("doc_id", F.lit(1).alias("tail"), F.lit(0.0).alias("s"), "k"))
    return ranked(both, [F.col("tail"), F.col("s").desc(), F.col("k")], name="position").select("doc_id", "position")


@query("WITH local AS (SELECT p_partkey AS id, p_size / 50.0 AS s FROM part WHERE p_size > 30), remote AS (SELECT p_partkey AS id, 0.9 * (1 - 0.015 * (row_number() OVER (ORDER BY p_partkey) - 1)) AS s FROM (SELECT p_partkey FROM part WHERE p_brand = 'Brand#5' ORDER BY p_partkey LIMIT 20)) SELECT id, round(max(s), 6) AS score FROM (SELECT * FROM local UNION ALL SELECT * FROM remote WHERE s >= 0.55) GROUP BY id")
def rank_decay_merge(spark, sf):
    parts = table(spark, sf, "part")
    local = parts.filter("p_size > 30").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("s"))
    hits = top_k(parts.filter("p_brand = 'Brand#5'").select(F.col("p_partkey").alias("id")), 20, [F.col("id")])
    remote = hits.select("id", (0.9 * (1 - 0.015 * (F.col("rank") - 1))).alias("s")).filter("s >= 0.55")
    return local.unionByName(remote).groupBy("id").agg(F.round(F.max("s"), 6).alias("score"))


@query(f"WITH {S}, t AS (SELECT *, row_number() OVER (ORDER BY round(fusion, 5) DESC, doc_id) AS position FROM fused), x AS ({_SHARES}), s AS (SELECT doc_id, x.signal, round(x / sum(x) OVER (PARTITION BY doc_id), 3) AS share FROM x WHERE x > 0), g AS (SELECT doc_id, string_agg(signal || '=' || printf('%.3f', share), ';' ORDER BY share DESC, signal) AS signals FROM s GROUP BY doc_id) SELECT doc_id, position, signals FROM t LEFT JOIN g USING (doc_id) WHERE position <= 20")
def explain_signals(spark, sf):
    top = top_k(_fused(spark, sf).withColumn("f", F.round("fusion", 5)), 20, [F.col("f").desc(), F.col("doc_id")], name="position")
    weighted = {c: w * F.greatest(F.col(f"z_{c}"), F.lit(0.0)) for c, w in W.items()}
    total = sum(weighted.values(), F.lit(0.0))
    parts = F.filter(F.array(*[F.struct((-F.round(x / total, 3)).alias("k"), F.lit(c).alias("signal")) for c, x in weighted.items()]), lambda s: s["k"] < 0)
    named = F.transform(F.array_sort(parts), lambda s: F.concat(s["signal"], F.lit("="), F.format_string("%.3f", -s["k"])))
    return top.select("doc_id", "position", F.when(total > 0, F.array_join(named, ";")).alias("signals"))


@query(f"WITH {V}, p AS (SELECT d.vec_id AS doc_id, t.vec_id AS term, round({_DOT.format('d.e', 't.e')}, 6) AS sim FROM v d, v t WHERE t.label = 0 AND t.vec_id <> d.vec_id) SELECT doc_id, term, sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, term) AS k FROM p WHERE sim >= 0.30) WHERE k <= 4")
def matched_keywords(spark, sf):
    rows = _vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("e").alias("v"), "label")
    near = vectors.best_products(rows.withColumn("skip", F.array("id")), rows.filter("label = 0").withColumn("bias", F.lit(0.0)), 4)
    return near.filter("score >= 0.30").select(F.col("id").alias("doc_id"), F.col("other").alias("term"), F.col("score").alias("sim"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN lang = 'en' THEN 'in English' END, CASE WHEN n_chars > 2000 THEN 'long read' END, CASE WHEN source IN ('src1', 'src2') THEN 'from ' || source END], lambda x: x IS NOT NULL)[1:2], '; ') AS reasons FROM documents")
def why_reasons(spark, sf):
    parts = F.array(F.when(F.col("lang") == "en", "in English"), F.when(F.col("n_chars") > 2000, "long read"), F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit("from "), F.col("source"))))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.array_compact(parts), 1, 2), "; ").alias("reasons"))


#: Known-item retrieval: an item's relevant documents hold its whole text; the best-ranked one counts.
_RANKS = f"{BM}, order_of AS (SELECT item_id, key, row_number() OVER (PARTITION BY item_id ORDER BY round(lexical, 6) DESC, key) AS rank FROM bm), hits AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), best AS (SELECT b.item_id, min(rank) AS rank FROM benchmark b LEFT JOIN hits USING (item_id) LEFT JOIN order_of o ON o.item_id = b.item_id AND o.key = hits.doc_id GROUP BY b.item_id)"


def held_by(spark, sf):
    """(item_id, key): the documents that hold an item's whole text.

    An item's inner words stand between others of its own, so they are words of
    every document that holds it: the postings of its rarest one are the
    candidates. Only items of fewer than three words meet all documents.
    """
    index, texts = _index(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body"))
    plain = lexical.Analyser((), index.analyser.fold).words(F.col("text"))
    items = table(spark, sf, "benchmark").select("item_id", "text", plain.alias("w"))
    items = items.withColumn("inner", F.filter(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda w: ~w.isin(*index.analyser.stop))).drop("w")
    rarest = items.select("item_id", F.explode("inner").alias("term")).join(index.terms, "term").groupBy("item_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    # stored, so that the planner knows their size and exchanges the texts only for many of them
    found = kept(index.postings.select("term", "key").join(F.broadcast(rarest), "term").select("item_id", "key"), "candidates")  # one word an item
    candidates = texts.join(found, "key").join(items.select("item_id", "text"), "item_id")
    short = texts.join(items.filter(F.size("inner") == 0).select("item_id", "text"), F.contains("body", "text"))
    return candidates.filter(F.contains("body", "text")).select("item_id", "key").unionByName(short.select("item_id", "key")).distinct()


def _ranks(spark, sf):
    items = table(spark, sf, "benchmark")
    return items.select("item_id").join(lexical.best_ranks(_index(spark, sf), items, "item_id", "text", held_by(spark, sf)), "item_id", "left")


@query(f"WITH {_RANKS} SELECT item_id, rank FROM best")
def rank_of_target(spark, sf):
    return _ranks(spark, sf)


@query(f"WITH {_RANKS} SELECT count(*) AS n, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END), 6) AS recall50, round(avg(CASE WHEN rank <= 10 THEN 0.1 ELSE 0 END), 6) AS precision10, count(*) FILTER (rank = 1) AS hits1 FROM best")
def ir_metrics(spark, sf):
    rank = F.col("rank")
    share = lambda k, value: F.round(F.avg(F.when(rank <= k, value).otherwise(0.0)), 6)
    return _ranks(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / rank, F.lit(0.0))), 6).alias("mrr"), share(10, 1 / F.log2(rank + 1)).alias("ndcg10"), share(50, F.lit(1.0)).alias("recall50"), share(10, F.lit(0.1)).alias("precision10"), F.count_if(rank == 1).alias("hits1"))


@query(f"WITH {V}, q AS (SELECT e FROM v WHERE vec_id = 2), s AS (SELECT v.vec_id, v.e, {_DOT.format('v.e', 'q.e')} AS sim FROM v, q), t AS (SELECT e FROM s ORDER BY round(sim, 6) DESC, vec_id LIMIT 8), m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(e[i]) AS x FROM t, range(1, 65) r(i) GROUP BY i)), mu AS (SELECT list_transform(m, lambda x: x / sqrt({_DOT.format('m', 'm')})) AS m FROM m), n AS (SELECT list_transform(list_zip(q.e, mu.m), lambda p: 0.65 * p[1] + 0.35 * p[2]) AS n FROM q, mu), u AS (SELECT list_transform(n, lambda x: x / sqrt({_DOT.format('n', 'n')})) AS n FROM n) SELECT vec_id, round({_DOT.format('s.e', 'u.n')}, 6) AS sim FROM s, u ORDER BY sim DESC, vec_id LIMIT 20")
def prf_rocchio(spark, sf):
    """The mean of the first 8 results pulls the query towards it; then all are scored again."""
    rows = _vectors(spark, sf).crossJoin(_one(spark, sf, 2))
    first = rows.withColumn("s", F.round(dot(F.col("e"), F.col("q")), 6)).orderBy(F.col("s").desc(), "vec_id").limit(8)
    mean = F.broadcast(centroids(first, "e", []).select(unit(F.col("centroid")).alias("m")))
    return rows.crossJoin(mean).select("vec_id", F.round(dot(F.col("e"), blend(F.col("q"), F.col("m"), 0.35)), 6).alias("sim")).orderBy(F.col("sim").desc(), "vec_id").limit(20)


_PIPES = {"lexical": "z_lexical", "synopsis": "z_synopsis", "keyword": "z_keyword", "fusion": "fusion", "content": "content"}


@query(f"WITH {S} " + " UNION ALL ".join(f"SELECT '{name}' AS pipeline, doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY round({c}, 5) DESC, doc_id) AS rank FROM fused) WHERE rank <= 10" for name, c in _PIPES.items()))
def ablation_table(spark, sf):
    flat = _fused(spark, sf).select("doc_id", F.explode(F.create_map(*[x for name, c in _PIPES.items() for x in (F.lit(name), F.round(c, 5))])).alias("pipeline", "score"))
    return top_k(flat, 10, [F.col("score").desc(), F.col("doc_id")], ["pipeline"]).select("pipeline", "doc_id", "rank")


@query(f"WITH {S} " + " UNION ALL ".join(f"SELECT * FROM (SELECT 'no_{out}' AS setting, doc_id, round({' + '.join(f'{w} * greatest(z_{c}, 0)' for c, w in W.items() if c != out)} + {PRIOR} * z_prior, 5) AS score FROM z ORDER BY score DESC, doc_id LIMIT 10)" for out in W))
def ablation_weights(spark, sf):
    """One channel left out at a time: a table of weights against the scored rows, in one pass."""
    settings = {f"no_{out}": sum((F.lit(w) * F.greatest(F.col(f"z_{c}"), F.lit(0.0)) for c, w in W.items() if c != out), F.lit(0.0)) + PRIOR * F.col("z_prior") for out in W}
    flat = _scored(spark, sf).select("doc_id", F.explode(F.create_map(*[x for name, s in settings.items() for x in (F.lit(name), F.round(s, 5))])).alias("setting", "score"))
    return top_k(flat, 10, [F.col("score").desc(), F.col("doc_id")], ["setting"]).select("setting", "doc_id", "score")


@query(f"WITH {V}, {_MEAN}, d AS (SELECT vec_id, label, list_transform(list_zip(e, m), lambda p: p[1] - p[2]) AS d FROM v, m), s AS (SELECT d.vec_id, d.label, round({_DOT.format('d.d', 'q.d')} / sqrt({_DOT.format('d.d', 'd.d')} * {_DOT.format('q.d', 'q.d')}), 6) AS sim FROM d, d q WHERE q.vec_id = 5 AND d.vec_id <> 5), a AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS k FROM s), b AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS k FROM s WHERE label = (SELECT label FROM v WHERE vec_id = 5)), u AS (SELECT 'content' AS src, vec_id, 1.0 / (20 + k) AS x FROM a WHERE k < 60 UNION ALL SELECT 'collaborative', vec_id, 0.6 / (20 + k) FROM b WHERE k < 60) SELECT vec_id, round(sum(x), 6) AS score, string_agg(src, '+' ORDER BY src) AS source FROM u GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 20")
def similar_items(spark, sf):
    rows = _vectors(spark, sf)
    mine = rows.filter("vec_id = 5").select(F.col("e").alias("q"), F.col("label").alias("own"))
    scored = _centred(rows.filter("vec_id <> 5").crossJoin(F.broadcast(mine)), centroids(rows, "e", [])).select("vec_id", "label", "own", "sim")
    lists = [(top_k(scored, 60, [F.col("sim").desc(), F.col("vec_id")]), 1.0, "content"), (top_k(scored.filter("label = own"), 60, [F.col("sim").desc(), F.col("vec_id")]), 0.6, "collaborative")]
    parts = [df.select("vec_id", F.lit(name).alias("src"), (F.lit(w) / (19 + F.col("rank"))).alias("x")) for df, w, name in lists]
    fused = parts[0].unionByName(parts[1]).groupBy("vec_id").agg(F.round(F.sum("x"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("src")), "+").alias("source"))
    return fused.orderBy(F.col("score").desc(), "vec_id").limit(20)
