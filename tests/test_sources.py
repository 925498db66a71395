import gzip
import hashlib
import json

import pytest

from marlstone.sources import files


def test_tsv_and_semi_join(spark, tmp_path):
    with gzip.open(tmp_path / "r.tsv.gz", "wt") as f:
        f.write("tconst\taverageRating\tnumVotes\ntt1\t7.5\t10\ntt2\t\\N\tx\ntt3\t5.0\t3\n")
    df = files.tsv(spark, str(tmp_path / "r.tsv.gz"), "tconst string, averageRating double, numVotes bigint")
    known = spark.createDataFrame([("tt1",), ("tt2",)], "tconst string")
    assert sorted(map(tuple, files.known_only(df, known, "tconst").collect())) == [("tt1", 7.5, 10), ("tt2", None, None)]


def test_csvs(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Date,Name,Year,URI,Rating,Review\n2020,Up,2009,u,4.5,ok\n2020,,2009,u,3,\n2020,Bad,20x,u,2.0,\n2020,No,2000,u,n/a,\n")
    assert [(r["name"], r["year"], r["rating"]) for r in files.diary_csv(spark, str(tmp_path / "d.csv")).orderBy("name").collect()] == [("Bad", None, 2.0), ("Up", 2009, 4.5)]
    (tmp_path / "l.csv").write_text("movieId,imdbId,tmdbId\n1,1,10\n2,2, \n3,3,\n4,4,x\n")
    assert [tuple(r) for r in files.links_csv(spark, str(tmp_path / "l.csv")).collect()] == [(1, 10)]
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,1,4.0,0\n1,2,3.0,1\n2,1,5.0,2\n")
    assert files.ratings_csv(spark, str(tmp_path / "r.csv"), 2).count() == 2


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": "x"}, {"id": 2}]))
    assert sorted((r["id"], r["t"]) for r in files.json_array(spark, str(tmp_path / "a.json"), "id int, t string").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "q.jsonl").write_text('{"qid": "a", "split": "dev"}\n{"qid": "b", "split": "test"}\n')
    assert files.json_lines(spark, str(tmp_path / "q.jsonl"), "qid string, split string", "dev", ("dev", "test")).count() == 1
    with pytest.raises(ValueError):
        files.json_lines(spark, str(tmp_path / "q.jsonl"), "qid string", "other", ("dev",))


def test_digest_append_and_evolution(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert files.digests(spark, str(tmp_path / "x.bin")).first()["md5"] == hashlib.md5(b"abc").hexdigest()
    df = spark.createDataFrame([(1, "2024-01-01")], "id int, day string")
    files.append_by_day(df, str(tmp_path / "t"))
    files.append_by_day(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert files.with_missing_columns(df, "id int, late double").columns == ["id", "day", "late"]
