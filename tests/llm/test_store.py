import os

from marlstone.llm import store


def test_saved_tables_go_when_cleared(spark):
    store.clear(spark)
    df = store.saved(spark.range(5), "probe")
    path = store._written[-1]
    local = path.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(local)
    assert store.clear(spark) == 1 and not os.path.exists(local) and store.clear(spark) == 0
