import json

import numpy as np
import pytest

from marlstone.functions.encode import encoded, hashed_words
from marlstone.operators import channels, evaluation, lexical
from marlstone.operators.relational import numbered
from marlstone.plans import evaluation as plans
from marlstone.plans import registry
from marlstone.plans.textual import cleaned_label, content_words, wiki_text
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_metrics(spark):
    ranks = [1, 2, 4, None, 60]
    row = evaluation.rank_metrics(spark.createDataFrame([(i, r) for i, r in enumerate(ranks)], "qid int, rank bigint")).first()
    known = [r for r in ranks if r]
    assert row["n"] == 5 and row["mrr"] == round(sum(1 / r for r in known) / 5, 6) and row["recall10"] == 0.6 and row["recall50"] == 0.6
    assert row["ndcg10"] == round(sum(1 / np.log2(r + 1) for r in known if r <= 10) / 5, 6) and row["hits1"] == 0.2 and row["hits3"] == 0.4
    assert row["median_rank"] == 3.0 and row["mean_rank"] == 16.75


def test_label_set_fails_on_what_does_not_resolve(spark):
    items = spark.createDataFrame([(1, "Red Fox", 2000), (2, "Red Fox Returns", 2000), (3, "Owl", 2001), (4, "Elm", 2001)], "item_id bigint, title string, year int")
    hints = lambda *rows: spark.createDataFrame(rows, "qid string, query string, hint string, year int")
    good = {r["qid"]: (r["item_id"], r["split"]) for r in evaluation.label_set(hints(("a", "x", "fox", 2000), ("b", "y", "owl", 2001), ("c", "z", "returns", 2000)), items).collect()}
    assert {q: i for q, (i, _) in good.items()} == {"a": 1, "b": 3, "c": 2} and sorted(s for _, s in good.values()) == ["dev", "dev", "test"]
    with pytest.raises(ValueError, match="1 labels do not resolve: b: no item"):
        evaluation.label_set(hints(("a", "x", "fox", 2000), ("b", "y", "owl", 2000)), items)
    with pytest.raises(ValueError, match="2 labels do not resolve: a: item of several, b: item of several"):
        evaluation.label_set(hints(("a", "x", "red fox", 2000), ("b", "y", "fox", 2000)), items)


def test_results_and_gate(spark, tmp_path):
    row = evaluation.rank_metrics(spark.createDataFrame([(1, 1), (2, 20)], "qid int, rank bigint"))
    evaluation.write_results(row, str(tmp_path), "dev", "2024-01-01T00:00:00Z")
    evaluation.write_results(row.withColumn("mrr", F.lit(0.9)), str(tmp_path), "dev", "2024-01-02T00:00:00Z")
    read = lambda name: spark.read.json(f"{tmp_path}/{name}")
    assert [r["mrr"] for r in read("latest__dev").collect()] == [0.9] and read("history").count() == 2
    assert read("2024-01-01T00-00-00Z__dev").first()["timestamp"] == "2024-01-01T00:00:00Z"
    assert evaluation.gate(row, "recall10", 0.5) == 0.5
    with pytest.raises(evaluation.BelowGate):
        evaluation.gate(row, "recall10", 0.51)


def test_rank_function_can_be_any(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, query string")
    relevant = spark.createDataFrame([(1, 7), (2, 9)], "qid int, key int")
    fixed = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.9), (2, 8, 1.0)], "qid int, key int, score double")
    assert sorted(map(tuple, evaluation.target_ranks(queries, relevant, lambda asked: fixed.join(asked, "qid").select("qid", "key", "score")).collect())) == [(1, 2), (2, None)]


def test_numbers_without_one_task(spark):
    rows = spark.createDataFrame([(int(k),) for k in np.random.default_rng(1).permutation(500) * 3], "k int")
    for width in (1, 40, 10_000):
        out = numbered(rows, "k", F.floor(F.col("k") / width))
        assert sorted((r["k"], r["number"]) for r in out.collect()) == [(3 * i, i) for i in range(500)]
    for name in ("ratings_ingest", "dense_remap", "seeded_split"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        alone = [line for line in plan.splitlines() if "Window" in line and "__bucket" not in line and "partition" not in line.lower() and "row_number" in line and "user_id" not in line]
        assert alone == []


def test_stored_index_equals_the_built_one(spark, tmp_path):
    docs = spark.createDataFrame([(0, "Élan the red gear"), (1, "blue gear elan"), (2, None), (3, "the of"), (4, "éclair und gear " * 50)], "id bigint, t string")
    built = lexical.build(docs, "id", "t", ("the", "of"), fold=True)
    built.save(str(tmp_path / "index"))
    stored = lexical.load(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "The ÉLAN gear"), (2, "eclair"), (3, "of the"), (4, "nothing")], "q int, t string")
    score = lambda index: {(r["q"], r["key"]): round(r["lexical"], 9) for r in lexical.search(index, queries, "q", "t").collect()}
    assert score(built) == score(stored) and {k for q, k in score(stored) if q == 1} == {0, 1, 4} and (2, 4) in score(stored)
    assert stored.analyser == built.analyser and stored.totals.first()["n"] == 5
    assert [sorted(map(tuple, a.collect())) for a in (built.documents, built.terms)] == [sorted(map(tuple, a.collect())) for a in (stored.documents, stored.terms)]
    plan = lexical.search(stored, queries.filter("q = 2"), "q", "t")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,eclair)" in plan or "In(term, [eclair])" in plan


def test_channels_may_be_absent(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "id bigint")
    channels.save(str(tmp_path / "ix"), {"lexical": spark.createDataFrame([(1, 0.5)], "id bigint, score double")}, {"encoder": "none"})
    found, meta = channels.load(spark, str(tmp_path / "ix"))
    both = channels.with_channel(channels.with_channel(rows, found, "lexical", "id"), found, "plot", "id")
    assert sorted(map(tuple, both.collect())) == [(1, 0.5, 0.0), (2, 0.0, 0.0)] and meta == {"encoder": "none"}
    assert json.dumps(sorted(found)) == '["lexical"]'


def test_modes(spark):
    text = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id = 65").first()["text"]
    asked = "red gear " + next(w for w in text.lower().split() if w.isalpha() and len(w) > 4)
    by_mode = lambda mode, **k: [r["item_id"] for r in plans.search(spark, SF, asked, mode, **k).orderBy("rank").collect()]
    assert set(by_mode("keyword", n=5)) <= {r["item_id"] for r in plans.catalog(spark, SF).filter("lower(title) RLIKE 'red|gear'").collect()}
    every = {m: by_mode(m) for m in plans.MODES if m != "person"}
    assert all(every.values()) and set(every["auto"]) & (set(every["name"]) | set(every["synopsis"]))
    ranked = plans.search(spark, SF, asked, "auto", n=60)
    filtered = plans.search(spark, SF, asked, "auto", n=5, filters={"year_max": 1980})
    years = {r["item_id"]: r["year"] for r in plans.catalog(spark, SF).collect()}
    want = [r["item_id"] for r in ranked.orderBy("rank").collect() if years[r["item_id"]] <= 1980][:5]
    assert [r["item_id"] for r in filtered.orderBy("rank").collect()][: len(want)] == want
    roles = plans.search(spark, SF, "Supplier#00000003", "person", role="director").count()
    assert 0 < roles <= 10 and plans.search(spark, SF, "  ", "auto").count() == 0
    with pytest.raises(ValueError):
        plans.search(spark, SF, "x", "other")


def test_dispatched_modes_and_encoded_documents(spark):
    found = registry.QUERIES["search_dispatch"](spark, SF).collect()
    for mode in plans.MODES:
        mine = [(r["rank"], r["item_id"], r["score"]) for r in found if r["mode"] == mode]
        asked = "small red gear" if mode != "person" else "Supplier#00000012"
        direct = plans.search(spark, SF, asked, mode, filters={"year_min": 1960}).collect()
        assert sorted(mine) == sorted((r["rank"], r["item_id"], r["score"]) for r in direct) and [r for r, *_ in sorted(mine)] == list(range(1, len(mine) + 1))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r["doc_id"]: (r["head"], r["length"]) for r in registry.QUERIES["encode_documents"](spark, SF).collect()}
    assert out.keys() == texts.keys()
    for d, t in texts.items():
        v = hashed_words(64)([t])[0]
        assert out[d] == (round(v[0], 6) + 0.0, round(float(v @ v), 6))


def test_encoder_is_loaded_once_a_task(spark):
    rows = spark.createDataFrame([(i, f"word{i} and more" if i % 3 else None) for i in range(90)], "id int, t string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return hashed_words(16)

    out = {r["id"]: r["e"] for r in rows.select("id", encoded("t", load).alias("e")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = hashed_words(16)([f"word{i} and more" for i in range(90)])
    assert loads.value == 2 and all(out[i] is None if i % 3 == 0 else np.allclose(out[i], want[i]) for i in range(90))


def test_labels_and_markup(spark):
    labels = {"Ada Rook": "Ada Rook", "Ada Rook (voice)": "Ada Rook", "Nurse uncredited": None, "Old Man (uncredited)": "Old Man", "Cook #3": None, "Sailor # 12": None, "Herself": None, "THEMSELVES": None, "him": None, "": None, "y" * 61: None, "Z": "Z", "- Ivo ·": "Ivo", "A #1 Fan": "A #1 Fan"}
    out = {r["x"]: r["c"] for r in spark.createDataFrame([(x,) for x in labels], "x string").select("x", cleaned_label(F.col("x")).alias("c")).collect()}
    assert out == labels
    raw = "'''Ada''' is a [[pilot]] of {{lang|x|{{y}}}}the [[Owl (plane)|Owl]].<ref name=a>no</ref><ref b/> <!-- c --> [[Image:o.jpg|thumb|z]]See [https://e.org site] &amp; more.\n== Part ==\n\n\n\nEnd."
    got = spark.createDataFrame([(raw,), ("word " * 5000,)], "x string").select(wiki_text(F.col("x")).alias("c")).collect()
    assert got[0]["c"] == "Ada is a pilot of the Owl. See site & more.\n\nEnd." and len(got[1]["c"]) == 19_999
    words = spark.createDataFrame([("Él cáfe und THE night",)], "x string").select(content_words(F.col("x")).alias("w")).first()["w"]
    assert words == ["cafe", "night"]


@pytest.mark.parametrize("mode", ["name", "synopsis", "person", "keyword"])
def test_a_search_broadcasts_no_items(spark, mode):
    asked = "small red gear" if mode != "person" else "Supplier#00000012"
    plan = plans.search(spark, SF, asked, mode, filters={"year_min": 1960})._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "FileScan" in line and "p_partkey" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i in at:
        over = [line for j, line in enumerate(plan[:i]) if all(depth(line) < depth(x) for x in plan[j + 1 : i + 1])]
        assert not any("BroadcastExchange" in line for line in over), mode
    assert at
