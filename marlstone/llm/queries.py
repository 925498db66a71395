"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontam, exact, licenses, lines, mixing, quality, secrets, simhash, substrings, transcripts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.annotate(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.annotate(table(spark, sf_dir, "documents"))


def op4_transcript_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as raw transcripts with varied and missing markers, parsed line by line and rendered."""
    raw = transcripts.with_markers(table(spark, sf_dir, "conversations"))
    return transcripts.rendered(transcripts.parse(raw.drop("role"), transcripts.train(raw)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.annotate(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.annotate(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.annotate(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.withColumn("position", F.round("position", 6)).drop("copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.annotate(table(spark, sf_dir, "documents"))


def op10_single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.annotate(table(spark, sf_dir, "documents"), gram=1, span=1)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_transcript_parsing": op4_transcript_parsing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_mix_sources": op9_mix_sources,
    "op10_line_dedup": op10_line_dedup,
    "op10_single_lines": op10_single_lines,
}

def _secret_sql() -> str:
    """Positions of a rule's matches: the text between them, split off by the same pattern, and the matches before."""
    both = {"(?i:password|passwd|secret|token|api_?key)": "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"}
    parts = []
    for number, rule in enumerate(secrets.RULES):
        pattern = rule.pattern
        for folded, spelled in both.items():
            pattern = pattern.replace(folded, spelled)
        pattern = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g,"
            f" regexp_split_to_array(text, '{pattern}') AS s, {rule.least} AS least FROM texts WHERE regexp_matches(text, '{pattern}')"
        )
    kinds = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return rf"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        found AS ({' UNION ALL '.join(parts)}),
        one AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
        spans AS (
            SELECT doc_id, k, kind, len(m[i]) AS size, list_sum(list_transform(s[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS a
            FROM one WHERE len(g[i]) >= least),
        texts_of AS (SELECT *, kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT AS span FROM spans),
        joined AS (
            SELECT doc_id, {sums}, string_agg(span, ',' ORDER BY a, k) FILTER (kind IN ({kinds})) AS base, string_agg(span, ',' ORDER BY a, k) AS spans
            FROM texts_of GROUP BY doc_id)
        SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN joined USING (doc_id)"""


def _license_sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    wide = lambda x: x.replace(" ", "  ")
    rows = ", ".join(f"({i}, {text(r.label)}, {licenses.RANKS[r.kind][0]}, {licenses.RANKS[r.kind][1]}, {text(wide(r.keyword))}, {text(r.pattern)})" for i, r in enumerate(licenses.RULES))
    base = ", ".join(f"({text(wide(phrase))}, {text(label)}, {phrase.count(' ') + 1})" for phrase, label in licenses.BASE.items())
    return rf"""
        WITH rules AS (SELECT * FROM (VALUES {rows}) r(id, label, rank, score, keyword, pattern)),
        base AS (SELECT * FROM (VALUES {base}) b(phrase, label, size)),
        docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        texts AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN '' ELSE ' ' || array_to_string(w, '  ') || ' ' END AS c FROM docs),
        phrases AS (
            SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda k: array_to_string(list_slice(w, k + 1, k + size), '  ') = phrase)) AS k
            FROM texts JOIN base ON contains(c, ' ' || phrase || ' ')),
        counted AS (
            SELECT doc_id, count(*) AS n, min(k) AS first_word, max(k) AS last_word, list_distinct(list(label)) AS labels FROM phrases GROUP BY doc_id),
        marked AS (
            SELECT doc_id, id, label, rank, score, string_split(trim(regexp_replace(c, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS m
            FROM texts JOIN rules ON contains(c, keyword) AND regexp_matches(c, pattern)),
        spans AS (
            SELECT doc_id, id, label, rank, score,
                   unnest(list_filter(range(0, len(m)), lambda k: starts_with(m[k + 1], chr(1)))) AS a,
                   unnest(list_filter(range(0, len(m)), lambda k: ends_with(m[k + 1], chr(2)))) + 1 AS b
            FROM marked),
        kept AS (
            SELECT * FROM spans x WHERE NOT EXISTS (
                SELECT 1 FROM spans y WHERE y.doc_id = x.doc_id AND y.a <= x.a AND y.b >= x.b
                AND (y.rank < x.rank OR y.rank = x.rank AND (y.b - y.a > x.b - x.a OR y.b - y.a = x.b - x.a AND y.id < x.id)))),
        best AS (SELECT doc_id, max(score)::DOUBLE AS score, list_distinct(list(label)) AS labels FROM kept GROUP BY doc_id)
        SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(array_to_string(list_sort(c.labels), ','), '') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(c.labels, []), coalesce(b.labels, [])))), ',') AS labels,
               greatest(coalesce(b.score, 0), CASE WHEN n > 0 THEN {licenses.BASE_SCORE} ELSE 0 END)::DOUBLE AS score
        FROM texts t LEFT JOIN counted c USING (doc_id) LEFT JOIN best b USING (doc_id)"""


SQL = {
    "op2_secret_scan": _secret_sql(),
    "op5_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        places AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
        least AS (SELECT h, min(doc_id) AS first_id FROM places GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM places JOIN least USING (h) WHERE first_id < doc_id),
        lost AS (SELECT doc_id, count(*) AS n, list(k) AS ks FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(coalesce(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                      ELSE (SELECT string_agg(t.x, ' ' ORDER BY t.k) FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k) t WHERE NOT list_contains(ks, t.k)) END, '')) AS kept_sha256
        FROM docs d LEFT JOIN lost USING (doc_id)""",
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g USING (text)""",
    "op7_license_scan": _license_sql(),
    "op8_benchmark_decontamination": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        items AS (
            SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        grams AS (
            SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM grams),
        places AS (
            SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs CROSS JOIN sizes)),
        hits AS (SELECT doc_id, i, size, item FROM places JOIN grams USING (size, gram)),
        words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
        found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_mix_sources": r"""
        WITH rows AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord
            FROM documents),
        sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM rows GROUP BY skey),
        ranked AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight FROM sizes),
        ratio AS (SELECT *, 3.0::DOUBLE * source_size / weight AS r FROM ranked),
        levels AS (
            SELECT *, row_number() OVER (ORDER BY r, skey) AS k,
                   ((sum(source_size) OVER ())::BIGINT - coalesce((sum(3 * source_size) OVER (ORDER BY r, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
                   / (sum(weight) OVER (ORDER BY r, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
            FROM ratio),
        chosen AS (SELECT arg_min(level, k) AS level FROM levels WHERE level * weight <= 3.0::DOUBLE * source_size),
        plan AS (
            SELECT l.skey, l.source_size, [0.5, 0.0, -0.5][l.weight]::DOUBLE AS slope,
                   least(3.0::DOUBLE * l.source_size, c.level * l.weight) AS target
            FROM levels l CROSS JOIN chosen c),
        placed AS (
            SELECT *, coalesce((sum(size) OVER (PARTITION BY skey ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS begins
            FROM rows JOIN plan USING (skey)),
        taken AS (
            SELECT *, (greatest(0, least(size, floor(target)::BIGINT - begins)) + greatest(0, least(size, floor(target)::BIGINT - begins - source_size))
                       + greatest(0, least(size, floor(target)::BIGINT - begins - 2 * source_size)))::BIGINT AS taken
            FROM placed)
        SELECT doc_id, size, source_size, target, taken,
               CASE WHEN taken > 0 THEN abs(round(CASE WHEN abs(slope) < 1e-9 THEN begins / target
                    ELSE (sqrt((1.0 - slope) * (1.0 - slope) + slope * (begins / target) * 4) - (1.0 - slope)) / (slope * 2) END, 6)) END AS position
        FROM taken""",
    "op10_line_dedup": r"""
        WITH parts AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS part
            FROM documents),
        marked AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM parts),
        units AS (SELECT doc_id, body, part, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS k FROM marked WHERE body <> ''),
        windows AS (
            SELECT doc_id, k, md5(body || chr(10) || lead(body) OVER w || chr(10) || lead(body, 2) OVER w) AS h
            FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
        later AS (
            SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS nth FROM windows WHERE h IS NOT NULL) WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 3)) AS k FROM later),
        lost AS (SELECT DISTINCT doc_id, part FROM gone JOIN units USING (doc_id, k)),
        kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY part) AS text FROM parts ANTI JOIN lost USING (doc_id, part) GROUP BY doc_id)
        SELECT d.doc_id, (SELECT count(*) FROM units u WHERE u.doc_id = d.doc_id) AS n_lines,
               (SELECT count(*) FROM lost l WHERE l.doc_id = d.doc_id) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op10_single_lines": r"""
        WITH parts AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS part
            FROM documents),
        marked AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM parts),
        units AS (SELECT doc_id, body, part, row_number() OVER (PARTITION BY body ORDER BY doc_id, part) AS nth FROM marked WHERE body <> ''),
        lost AS (SELECT doc_id, part FROM units WHERE nth > 1),
        kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY part) AS text FROM parts ANTI JOIN lost USING (doc_id, part) GROUP BY doc_id)
        SELECT d.doc_id, (SELECT count(*) FROM units u WHERE u.doc_id = d.doc_id) AS n_lines,
               (SELECT count(*) FROM lost l WHERE l.doc_id = d.doc_id) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept k USING (doc_id)""",
}
