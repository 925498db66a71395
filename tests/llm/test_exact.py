from marlstone.llm import exact

SCHEMA = "doc_id bigint, text string, kept string, __ms_x string"
ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (8, "x" * 200_000), (9, "x" * 200_000), (9, "x" * 200_000), (None, "b"), (None, None)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "no", "y") for d, t in rows], SCHEMA)


def test_keeps_the_largest_id(spark):
    for options in ({}, {"max_bits": 1}):
        out = exact.annotate(frame(spark), **options).collect()
        assert len(out) == len(ROWS)
        by_id = {}
        for r in out:
            by_id.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
        assert by_id[1] == [(3, 2, False)] and by_id[3] == [(3, 2, True)]
        assert by_id[2] == [(2, 2, True)] and by_id[4] == [(5, 3, False)] and by_id[5] == [(5, 3, True)]
        assert by_id[6] == [(6, 1, True)] and by_id[7] == [(7, 1, True)] and by_id[8] == [(9, 3, False)]
        assert sorted(x[2] for x in by_id[9]) == [False, True]
        assert sorted(by_id[None]) == [(2, 2, False), (5, 3, False)]


def test_drop_copies_keeps_columns(spark):
    docs = frame(spark)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [2, 3, 5, 6, 7, 9]


def many(spark, parts=6):
    rows = [(i, f"text {i if i % 5 else i // 50}") for i in range(60_000)] + [(None, "text 7"), (7, "text 7"), (7, "text 7"), (None, None)]
    return rows, spark.createDataFrame([(d, t, "no", "y") for d, t in rows], SCHEMA).repartition(parts)


def test_a_full_filter_loses_nothing(spark):
    """A filter bounded far below the number of repeats flags most rows, and the groups are the same."""
    rows, docs = many(spark)
    best = {}
    for d, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if d is None else d)
    for bits in (exact.MAX_BITS, 1):
        out = exact.annotate(docs, max_bits=bits).collect()
        assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(best)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in exact.drop_copies(docs, max_bits=bits).collect()) == sorted((d, t) for t, d in best.items())


def test_cleared_rows_are_not_moved(spark, tmp_path):
    """The filter clears nearly all unique rows, and texts are exchanged only behind it."""
    _, docs = many(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for bits in (exact.MAX_BITS, 1):
        plan = exact.drop_copies(docs, max_bits=bits)._jdf.queryExecution().executedPlan().toString()
        cleared, others = plan.split("   :- ", 1)[1].split("\n   +- ", 1)
        assert "BroadcastExchange" in cleared and "Exchange hashpartitioning" not in cleared
        assert [line for line in others.splitlines() if "Exchange hashpartitioning" in line and "__ms_key" not in line and "__ms_sha" not in line] == []
    keys = docs.selectExpr("xxhash64(text) h")
    flagged = exact.flag_maybe(keys, "h", *exact.dense_filter(exact.repeated_marks(keys, "h")))
    unique = docs.groupBy("text").count().filter("count = 1").count()
    assert flagged.filter("not __ms_maybe").count() > 0.99 * unique


def test_empty(spark):
    assert exact.annotate(frame(spark, [])).collect() == []
    assert exact.drop_copies(frame(spark, [])).collect() == []
