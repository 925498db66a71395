"""Text scalars, name matching, and structures built from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import fuzzy
from marlstone.functions import text as T
from marlstone.operators.relational import top_k
from marlstone.plans.base import CATALOG, CREDITS, catalog, credits, query, table

CP = f"WITH {CATALOG}, {CREDITS} "

# Stop words of these corpora's queries.
STOP = ("the", "and", "of", "in", "to", "la", "le", "de", "und", "die", "der", "que", "el", "en", "et")
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


def _stopped(word):
    return word.isin(*STOP)


def content_words(text):
    """Words of over two characters, without accents and stop words."""
    return F.filter(F.regexp_extract_all(T.strip_accents(F.lower(text)), F.lit("[^ \\t\\n]+"), 0), lambda w: (F.length(w) > 2) & ~_stopped(w))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS plain FROM documents")
def strip_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.strip_accents(F.lower("text"))).alias("plain"))


@query(rf"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[^ \t\n]+'), lambda w: len(w) > 2 AND NOT list_contains({_STOP}, w)) AS t FROM documents)")
def content_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content_words(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(rf"""WITH w AS (SELECT item_id, regexp_extract_all(trim(text), '[^ ]+') AS t FROM benchmark), f AS (SELECT item_id, t, coalesce(list_position(list_transform(t[1:len(t) - 1], lambda x: list_contains({_STOP}, strip_accents(lower(trim(x, '?!.,;:'))))), false), len(t)) AS k FROM w)
    SELECT item_id, trim(array_to_string(t[k:], ' '), ' ?!.,;:') AS cleaned FROM f""")
def clean_query(spark, sf):
    split = lambda text: F.regexp_extract_all(F.trim(text), F.lit("[^ ]+"), 0)
    # accents go from the text as a whole, which leaves its words where they are
    words = table(spark, sf, "benchmark").select("item_id", split("text").alias("t"), split(T.strip_accents(F.lower("text"))).alias("plain"))
    lead = F.transform(F.slice("plain", 1, F.size("t") - 1), lambda x: _stopped(F.btrim(x, F.lit("?!.,;:"))))
    first = F.array_position(lead, F.lit(False))
    begin = F.when(first == 0, F.size("t")).otherwise(first).cast("int")
    return words.select("item_id", F.btrim(F.array_join(F.slice("t", begin, F.size("t")), " "), F.lit(" ?!.,;:")).alias("cleaned"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '^(red|hot|the) ', '') AS name_key, trim(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS alnum_key FROM part")
def name_keys(spark, sf):
    joined = F.lower(F.concat("p_name", F.lit("-"), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "^(red|hot|the) ", "").alias("name_key"), F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " ")).alias("alnum_key"))


@query("SELECT a.p_name AS a, b.p_name AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS score FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b")
def jaro_winkler(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("a")).crossJoin(names.select(F.col("p_name").alias("b")))  # a vocabulary against itself
    return pairs.withColumn("score", F.round(fuzzy.similarity(F.col("a"), F.col("b"), "jaro_winkler"), 6))


@query(r"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents)")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(r"SELECT doc_id, CASE WHEN len(text) <= 80 THEN text ELSE regexp_replace(regexp_replace(left(text, 80), '\s\S*\z', ''), '[.,;:!?]+\z', '') || '…' END AS short FROM documents")
def truncate_words(spark, sf):
    cut = F.regexp_replace(F.regexp_replace(F.left("text", F.lit(80)), r"\s\S*\z", ""), r"[.,;:!?]+\z", "")
    return table(spark, sf, "documents").select("doc_id", F.when(F.length("text") <= 80, F.col("text")).otherwise(F.concat(cut, F.lit("…"))).alias("short"))


_LABELS = ("Mara Quill (voice)", "Clerk #2", "Sailor # 14", "Herself", "Ann / The Owl", "Tall Man (uncredited)", "Crowd member uncredited", None, "  Oda -", "· Ilse /", "Them #selves", "x" * 80)
_NO_NAMES = ("himself", "herself", "themselves", "self", "him", "her")


@query(rf"""WITH raw AS (SELECT p_name || CASE WHEN p_size % 3 = 0 THEN ' (voice)' WHEN p_size % 3 = 1 THEN ' # 2' ELSE ' (uncredited)' END AS label FROM part UNION ALL SELECT label FROM (VALUES {', '.join('(NULL)' if x is None else f"('{x}')" for x in _LABELS)}) v(label))
    , c AS (SELECT label, trim(regexp_replace(label, '\s*\([^)]*\)\s*$', ''), ' -/·') AS t FROM raw) SELECT label, count(*) AS n, min(CASE WHEN len(t) <= 60 AND t <> '' AND lower(t) NOT IN {_NO_NAMES} AND NOT contains(lower(t), 'uncredited') AND NOT regexp_matches(t, '#\s*\d+\s*$') THEN t END) AS cleaned FROM c GROUP BY label""")
def clean_label(spark, sf):
    size = F.col("p_size") % 3
    made = table(spark, sf, "part").select(F.concat("p_name", F.when(size == 0, " (voice)").when(size == 1, " # 2").otherwise(" (uncredited)")).alias("label"))
    fixed = spark.createDataFrame([(x,) for x in _LABELS], "label string")
    return made.unionByName(fixed).groupBy("label").agg(F.count("*").alias("n"), F.min(cleaned_label(F.col("label"))).alias("cleaned"))


def cleaned_label(label):
    """The name in a cast label: a last bracket and outer marks go; what is no name (numbered, uncredited, "himself", over 60 characters) is null."""
    t = F.btrim(F.regexp_replace(label, r"\s*\([^)]*\)\s*$", ""), F.lit(" -/·"))
    good = (F.length(t) <= 60) & (t != "") & ~F.lower(t).isin(*_NO_NAMES) & ~F.contains(F.lower(t), F.lit("uncredited")) & ~t.rlike(r"#\s*\d+\s*$")
    return F.when(good, t)


@query(CP + "SELECT term, count(DISTINCT item_id) AS items FROM (SELECT item_id, unnest(string_split(lower(title), ' ')) AS term FROM catalog) WHERE len(term) >= 3 GROUP BY term")
def entity_index(spark, sf):
    words = catalog(spark, sf).select("item_id", F.explode(F.split(F.lower("title"), " ")).alias("term")).filter("length(term) >= 3")
    return words.groupBy("term").agg(F.countDistinct("item_id").alias("items"))


#: Rewrites of markup to text, in order.
_MARKUP = ((r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?s)<!--.*?-->", " "), (r"(?is)<br\s*/?>|</p>|</h1>|</li>", "\n"), (r"<[^>]*>", ""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{2,}", "\n"))


def _markup_sql(column: str) -> str:
    for pattern, by in _MARKUP:
        by = by.replace("\n", "' || chr(10) || '")
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return f"trim({column}, ' ' || chr(10))"


def plain_text(html):
    for pattern, by in _MARKUP:
        html = F.regexp_replace(html, pattern, by.replace("\\", "\\\\").replace("$", "\\$"))
    return F.btrim(html, F.lit(" \n"))


@query(f"SELECT page_id, len(t)::INT AS n, md5(t) AS digest FROM (SELECT page_id, {_markup_sql('html')} AS t FROM pages)")
def strip_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", plain_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


#: Rewrites of wiki markup to prose, in order; templates are taken out from the inside, six deep.
_WIKI = (
    (r"(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""), (r"(?s)<!--.*?-->", ""), *[(r"\{\{[^{}]*\}\}", "")] * 6,
    (r"(?i)\[\[(?:File|Image|Media):[^\]]*\]\]", ""), (r"\[\[[^\]|]+\|([^\]]+)\]\]", r"\1"), (r"\[\[([^\]]+)\]\]", r"\1"), (r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1"),
    ("\'{2,}", ""), (r"<[^>]+>", ""), (r"(?m)^=+\s*.*?\s*=+$", ""), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
)
_WIKI_CHARS = 20_000


def wiki_text(markup, limit: int = _WIKI_CHARS):
    """The prose of wiki markup, cut at a word's end after ``limit`` characters."""
    for pattern, by in _WIKI:
        markup = F.regexp_replace(markup, pattern, by.replace("\\1", "$1"))
    text = F.btrim(markup, F.lit(" \t\n"))
    return F.when(F.length(text) > limit, F.regexp_replace(F.left(text, F.lit(limit)), r" [^ ]*\z", "")).otherwise(text)


def _wiki_sql(column: str) -> str:
    for pattern, by in _WIKI:
        column = "regexp_replace(" + column + ", '" + pattern.replace("'", "''") + "', '" + by.replace("\n", "' || chr(10) || '") + "', 'g')"
    return f"(SELECT CASE WHEN len(t) > {_WIKI_CHARS} THEN regexp_replace(left(t, {_WIKI_CHARS}), ' [^ ]*\\z', '') ELSE t END FROM (SELECT trim({column}, ' ' || chr(9) || chr(10)) AS t))"


_MARKED_UP = "'== Plot ==' || chr(10) || '''''''' || left(text, 12) || '''''''' || ' met [[the fox]] and [[Old town|the town]] {{a|{{b|c}}}}.<ref name=r>p. 3</ref> <!-- no --> [[File:x.png|thumb|y]] See [https://example.org here].<br/>&nbsp;' || text"


@query(f"SELECT doc_id, len(t)::INT AS n, md5(t) AS digest FROM (SELECT doc_id, {_wiki_sql(_MARKED_UP)} AS t FROM documents)")
def strip_wikitext(spark, sf):
    """Documents with wiki markup put round them, as prose again."""
    head = F.concat(F.lit("== Plot ==\n'\''"), F.left("text", F.lit(12)), F.lit("'\'' met [[the fox]] and [[Old town|the town]] {{a|{{b|c}}}}.<ref name=r>p. 3</ref> <!-- no --> [[File:x.png|thumb|y]] See [https://example.org here].<br/>&nbsp;"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", wiki_text(head).alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n]+') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, len(t), 330)) AS i FROM w)
    SELECT doc_id, (i // 330)::INT AS chunk, len(t[i + 1:i + 380])::INT AS n, md5(array_to_string(t[i + 1:i + 380], ' ')) AS digest FROM s""")
def chunk_words(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[^ \\t\\n]+"), 0).alias("t"))
    pieces = words.select("doc_id", F.posexplode(T.chunks(F.col("t"), 380, 50)).alias("chunk", "words"))
    return pieces.select("doc_id", "chunk", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


_PHRASES = "array_to_string(list_filter([CASE WHEN year < 1960 THEN 'classic' WHEN year >= 1990 THEN 'recent' END, CASE WHEN votes >= 35 THEN 'popular' END, CASE WHEN score >= 5.8 THEN 'acclaimed' WHEN score < 5.0 THEN 'panned' END, ((year // 10) * 10)::VARCHAR || 's'], lambda x: x IS NOT NULL), ' ')"


def _phrases():
    year, votes, score = F.col("year"), F.col("votes"), F.col("score")
    parts = [F.when(year < 1960, "classic").when(year >= 1990, "recent"), F.when(votes >= 35, "popular"), F.when(score >= 5.8, "acclaimed").when(score < 5.0, "panned"), F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s"))]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


@query(CP + f"SELECT item_id, {_PHRASES} AS phrases FROM catalog")
def attribute_phrases(spark, sf):
    return catalog(spark, sf).select("item_id", _phrases().alias("phrases"))


# Synonyms of title words.
SYNONYMS = {"red": "crimson scarlet", "hot": "warm", "small": "little tiny", "gear": "cog"}
_SYN = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in SYNONYMS.items()) + "}"


def _expanded():
    lookup = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.array_join(F.transform(F.split(F.lower("title"), " "), lambda w: F.concat_ws(" ", w, F.try_element_at(lookup, w))), " ")


_EXPANDED = f"array_to_string(list_transform(string_split(lower(title), ' '), lambda w: concat_ws(' ', w, {_SYN}[w])), ' ')"


@query(CP + f"SELECT item_id, {_EXPANDED} AS expanded FROM catalog")
def synonym_expand(spark, sf):
    return catalog(spark, sf).select("item_id", _expanded().alias("expanded"))


@query(CP + f", cast_of AS (SELECT item_id, string_agg(DISTINCT person, ' ' ORDER BY person) AS people FROM credits WHERE rank <= 2 GROUP BY item_id) SELECT item_id, concat_ws(' ', lower(genre), {_EXPANDED}, {_PHRASES}, people) AS document FROM catalog LEFT JOIN cast_of USING (item_id)")
def thematic_document(spark, sf):
    people = credits(spark, sf).filter("rank <= 2").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("person")), " ").alias("people"))
    return catalog(spark, sf).join(people, "item_id", "left").select("item_id", F.concat_ws(" ", F.lower("genre"), _expanded(), _phrases(), "people").alias("document"))


@query("SELECT p_partkey, array_to_string(list_filter(list_distinct(string_split(p_name, ' ')), lambda w: w IN ('red', 'gear', 'bolt')), ' ') AS terms FROM part WHERE len(string_split(p_name, ' ')) = 2 AND string_split(p_name, ' ')[1] NOT IN ('red', 'gear', 'bolt')")
def matched_terms(spark, sf):
    shared = F.array_intersect(F.array_distinct(F.split("p_name", " ")), F.lit(["red", "gear", "bolt"]))
    parts = table(spark, sf, "part").filter(F.size(F.split("p_name", " ")) == 2).filter(~F.split("p_name", " ")[0].isin("red", "gear", "bolt"))
    return parts.select("p_partkey", F.array_join(shared, " ").alias("terms"))


@query(r"SELECT doc_id, md5(regexp_replace(trim(lower(text)), '\s+', ' ', 'g')) AS digest FROM documents")
def norm_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("digest"))


@query("SELECT c_custkey, try_cast(string_split(rtrim(raw, '%'), '/')[1] AS INT) AS pct FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 101)::VARCHAR || '%' WHEN 1 THEN (c_custkey % 90)::VARCHAR || '/100' WHEN 2 THEN 'N/A' END AS raw FROM customer)")
def parse_pct(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat((k % 101).cast("string"), F.lit("%"))).when(k % 4 == 1, F.concat((k % 90).cast("string"), F.lit("/100"))).when(k % 4 == 2, "N/A")
    return table(spark, sf, "customer").select("c_custkey", F.split(F.rtrim(raw, F.lit("%")), "/")[0].try_cast("int").alias("pct"))


@query("SELECT s_suppkey, sha1(lower(trim(s_name)) || '|' || s_nationkey::VARCHAR) AS key FROM supplier")
def sha_key(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.sha1(F.concat_ws("|", F.lower(F.trim("s_name")), F.col("s_nationkey").cast("string"))).alias("key"))


@query("SELECT p_partkey, concat_ws(' ', p_name, array_to_string(list_filter(['Red', 'machine', 'gear'], lambda c: NOT contains(lower(p_name), lower(c))), ' ')) AS asked FROM part")
def append_missing_terms(spark, sf):
    missing = F.filter(F.lit(["Red", "machine", "gear"]), lambda c: ~F.contains(F.lower("p_name"), F.lower(c)))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.array_join(missing, " ")).alias("asked"))


@query("""WITH a AS (SELECT * FROM (VALUES (1, '[{"n": 2, "c": "high"}, {"n": 9, "c": "high"}, {"n": 2, "c": "medium"}, {"n": 1, "c": "low"}, {"n": 3, "c": "medium"}]'), (2, 'broken'), (3, '[]')) v(qid, answer)),
    p AS (SELECT qid, unnest(range(1, json_array_length(answer)::BIGINT + 1)) AS i, answer::JSON AS j FROM a WHERE json_valid(answer)), r AS (SELECT qid, i, (j ->> ('$[' || (i - 1) || '].n'))::INT AS n, j ->> ('$[' || (i - 1) || '].c') AS c FROM p)
    SELECT qid, n, row_number() OVER (PARTITION BY qid ORDER BY i) AS position FROM (SELECT qid, n, min(i) AS i FROM r WHERE c IN ('high', 'medium') AND n BETWEEN 1 AND 5 GROUP BY ALL)""")
def confirm_parse(spark, sf):
    answers = spark.createDataFrame([(1, '[{"n": 2, "c": "high"}, {"n": 9, "c": "high"}, {"n": 2, "c": "medium"}, {"n": 1, "c": "low"}, {"n": 3, "c": "medium"}]'), (2, "broken"), (3, "[]")], "qid int, answer string")
    picks = answers.select("qid", F.posexplode(F.from_json("answer", "array<struct<n:int,c:string>>")).alias("i", "p")).filter("p.c IN ('high', 'medium') AND p.n BETWEEN 1 AND 5")
    firsts = picks.groupBy("qid", F.col("p.n").alias("n")).agg(F.min("i").alias("i"))
    return top_k(firsts, 1_000_000, [F.col("i")], ["qid"], "position").select("qid", "n", "position")


_ASKED = ("red wigdet", "small gear box", "hot bolt", "blue")


def _name_queries(spark):
    return F.broadcast(spark.createDataFrame(list(enumerate(_ASKED)), "qid int, asked string"))


@query()
def fuzzy_name(spark, sf):
    """The 8 best titles of each asked name at a weighted ratio of 0.5 or more; titles are scored once each."""
    titles = table(spark, sf, "part").select(F.lower("p_name").alias("title")).distinct().crossJoin(_name_queries(spark))
    scored = titles.withColumn("score", F.round(fuzzy.similarity(F.col("asked"), F.col("title")), 6)).filter("score >= 0.5")
    return top_k(scored, 8, [F.col("score").desc(), F.col("title")], ["qid"]).select("qid", "title", "score", "rank")


@query()
def fuzzy_person(spark, sf):
    """People like an asked name (15 best at 0.75 or more), then their items with the largest score."""
    people = table(spark, sf, "supplier").select("s_suppkey", "s_name").withColumn("score", F.round(fuzzy.similarity(F.lit("Supplier#00000012"), F.col("s_name")), 6)).filter("score >= 0.75")
    best = people.orderBy(F.col("score").desc(), "s_name").limit(15)
    items = credits(spark, sf).join(F.broadcast(best), F.col("person_id") == F.col("s_suppkey")).groupBy("item_id").agg(F.max("score").alias("score"))
    return items.join(catalog(spark, sf).select("item_id", "votes"), "item_id").orderBy(F.col("score").desc(), F.col("votes").desc(), "item_id").limit(50)


@query()
def fuzzy_keyword(spark, sf):
    """Brands like an asked one (15 best at 0.8 or more), then their items with the sum of scores."""
    brands = table(spark, sf, "part").select("p_brand").distinct().withColumn("score", F.round(fuzzy.similarity(F.lit("Brand#1"), F.col("p_brand")), 6)).filter("score >= 0.8")
    best = F.broadcast(brands.orderBy(F.col("score").desc(), "p_brand").limit(15))
    return table(spark, sf, "part").join(best, "p_brand").groupBy(F.col("p_partkey").alias("item_id")).agg(F.round(F.sum("score"), 6).alias("score"))


def name_match(asked, title):
    """A weighted ratio, raised for exact and prefix matches, else scaled by the cover of characters and of content words."""
    base = fuzzy.similarity(asked, title)
    content = F.filter(F.split(asked, " "), lambda w: (F.length(w) > 2) & ~_stopped(w))
    shared = F.filter(content, lambda w: F.array_contains(F.split(title, " "), w))
    chars = F.least(F.lit(1.0), F.length(title) / F.greatest(F.length(asked), F.lit(1)))
    words = F.when(F.size(content) > 0, F.size(shared) / F.size(content)).otherwise(1.0)
    return F.when(title == asked, base + 0.5).when(title.startswith(asked), base + 0.15).otherwise(base * (0.4 + 0.6 * chars) * (0.2 + 0.8 * words))


@query()
def name_score(spark, sf):
    titles = table(spark, sf, "part").select(F.lower("p_name").alias("title")).distinct().crossJoin(_name_queries(spark))
    return titles.select("qid", "title", F.round(name_match(F.col("asked"), F.col("title")), 6).alias("score"))


@query()
def indel_ratio(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.crossJoin(_name_queries(spark)).select("qid", "p_name", F.round(fuzzy.similarity(F.col("asked"), F.col("p_name"), "indel"), 6).alias("score"))


@query(CP + """, q AS (SELECT * FROM (VALUES (1, 'red widgt', 1961), (2, 'smal bolt', 1975), (3, 'hot gear', NULL)) v(qid, name, year)), c AS (
    SELECT qid, item_id, levenshtein(name, title) AS d FROM q JOIN catalog c ON q.year IS NULL OR abs(c.year - q.year) <= 1) SELECT qid, item_id, d::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, item_id) AS k FROM c WHERE d <= 3) WHERE k = 1""")
def band_join_fuzzy(spark, sf):
    asked = spark.createDataFrame([(1, "red widgt", 1961), (2, "smal bolt", 1975), (3, "hot gear", None)], "qid int, name string, asked_year int")
    items = catalog(spark, sf).select("item_id", "title", "year")
    # the band becomes equal keys; only names without a year meet the whole catalog
    banded = items.join(F.broadcast(asked.filter("asked_year IS NOT NULL").withColumn("year", F.explode(F.array(*[F.col("asked_year") + k for k in (-1, 0, 1)])))), "year")
    every = items.crossJoin(F.broadcast(asked.filter("asked_year IS NULL")))
    scored = banded.select("qid", "item_id", "name", "title").unionByName(every.select("qid", "item_id", "name", "title")).withColumn("distance", F.levenshtein("name", "title")).filter("distance <= 3")
    return top_k(scored, 1, [F.col("distance"), F.col("item_id")], ["qid"]).select("qid", "item_id", "distance")
