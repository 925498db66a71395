"""Known-item ranks on tables made for them."""

import pytest

from marlstone.operators import evaluation, lexical
from marlstone.plans import registry
from marlstone.plans.base import table
from marlstone.plans.retrieval import _index, held_by

SF = "/root/testdata/sf0.001"


def test_targets_below_rank_200_count(spark, tmp_path):
    item = "amber birch cedar"
    rows = [(i, f"{item.replace(' ', ' x ')}") for i in range(250)] + [(900, item + " filler" * 400), (901, "nothing here")]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "absent words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["item_id"]: r["rank"] for r in registry.QUERIES["rank_of_target"](spark, str(tmp_path)).collect()}
    assert out == {1: 251, 2: None}
    metrics = registry.QUERIES["ir_metrics"](spark, str(tmp_path)).first()
    assert metrics["mrr"] == round(1 / 251 / 2, 6)


@pytest.mark.parametrize("cells", [lexical.CELLS, 70])
def test_ranks_keep_no_scores(spark, monkeypatch, cells):
    asked = table(spark, SF, "benchmark").select("item_id", "text")
    scored = lexical.search(_index(spark, SF), asked, "item_id", "text").selectExpr("item_id AS qid", "key", "round(lexical, 6) AS score")
    found = evaluation.best_ranks(scored, held_by(spark, SF).withColumnRenamed("item_id", "qid")).collect()
    want = {r["item_id"]: None for r in asked.collect()} | {r["qid"]: r["rank"] for r in found}

    def kept(*_):
        raise AssertionError("scores of all matched documents are stored")

    monkeypatch.setattr(evaluation, "kept", kept)
    monkeypatch.setattr(lexical, "CELLS", cells)
    assert {r["item_id"]: r["rank"] for r in registry.QUERIES["rank_of_target"](spark, SF).collect()} == want
    assert registry.QUERIES["harness_metrics"](spark, SF).first()["n"] == len(want)
