"""BM25 over an inverted index held as tables, in memory or stored."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.functions.text import without_accents

K1, B = 1.5, 0.75
#: Distinct terms up to which a search names them to the scan of a stored index, whose files are in order of terms.
PUSHED_TERMS = 500
#: Postings in a range of a stored index, about 100 MB to sort.
RANGE = 1 << 21
#: Characters of text that are analysed at once.
RUN = 1 << 20


_WORD = re.compile(r"\w{2,}")


@dataclass(frozen=True)
class Analyser:
    """Words of a text, the same for documents and queries: runs of two or more letters, digits and underscores, lower-cased,
    without accents if ``fold``, without ``stop`` words. A null text has none."""

    stop: tuple[str, ...] = ()
    fold: bool = False

    def split(self, text: str | None) -> list[str]:
        text = (text or "").lower()
        found = _WORD.findall(without_accents(text) if self.fold else text)
        return [w for w in found if w not in self.stop] if self.stop else found

    def words(self, text: Column) -> Column:
        return F.pandas_udf(lambda texts: texts.map(self.split), "array<string>")(text)


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # key, dl, term, tf
    documents: DataFrame  # key, dl, k
    terms: DataFrame  # term, df, idf
    totals: DataFrame  # one row: n, avgdl
    analyser: Analyser = Analyser()
    analysed: DataFrame | None = None  # what the others derive from; None for a stored index
    counted: DataFrame | None = None  # key, dl, terms, tfs: a row for each document

    def save(self, path: str, files: int = 8) -> None:
        """Writes the index. Postings lie in order of terms, so that a search reads the row groups of the asked terms only. ``files``
        is the least number of ranges of terms; there are more of them as there are more postings, so a range keeps its size. Texts are
        analysed once: what they give is written first, and all else is derived from it; postings are exchanged once."""
        spark = self.analysed.sparkSession
        self.analysed.write.mode("overwrite").parquet(f"{path}/analysed")
        index = _index(spark.read.schema(self.analysed.schema).parquet(f"{path}/analysed"), self.analyser)
        index.totals.withColumn("analyser", F.lit(json.dumps([self.analyser.stop, self.analyser.fold]))).write.mode("overwrite").parquet(f"{path}/totals")
        index.documents.write.mode("overwrite").parquet(f"{path}/documents")
        index.terms.write.mode("overwrite").parquet(f"{path}/terms")
        rows = spark.read.parquet(f"{path}/terms").agg(F.sum("df")).first()[0] or 0
        ordered = index.postings.select("term", "key", "tf", "dl").repartitionByRange(max(files, -(-rows // RANGE)), "term", "key").sortWithinPartitions("term", "key")
        ordered.write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")


def load(spark: SparkSession, path: str) -> Index:
    """An index that ``save`` wrote."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    stop, fold = json.loads(read("totals").first()["analyser"])
    return Index(read("postings"), read("documents"), read("terms"), read("totals").select("n", "avgdl"), Analyser(tuple(stop), fold), None, read("analysed"))


def _length_norm() -> Column:
    return K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))


def _weights(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """Postings with idf, and ``weight``, what each gives to its document's score."""
    return hits.crossJoin(F.broadcast(totals.select("avgdl"))).withColumn("weight", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + _length_norm()))


def _with_idf(postings: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf). df is summed over tf so that the plan reads the same columns as the postings' other readers and shares their exchange."""
    counted = postings.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("bigint")).alias("df")).crossJoin(F.broadcast(totals.select("n")))
    return counted.select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def build(docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), fold: bool = False) -> Index:
    """``key`` is unique. Documents without terms count in N but not in the mean length.

    Texts are analysed and their terms counted on Arrow batches, document by
    document, so postings need no exchange; a posting carries its document's
    length, so scoring joins no lengths.
    """
    analyser = Analyser(stop, fold)
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lengths, terms, counts, ends, size = [], [], [], [], [0], 0
            for i, body in enumerate(batch.column("text")):
                body = body.as_py()
                words = analyser.split(body)
                found = Counter(words)
                at.append(i)
                lengths.append(len(words))
                terms += found
                counts += found.values()
                ends.append(len(terms))
                size += len(body or "")
                if size >= RUN or i == batch.num_rows - 1:
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(terms, pa.string()), pa.array(counts, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["key", "dl", "terms", "tfs"])
                    at, lengths, terms, counts, ends, size = [], [], [], [], [0], 0

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _index(rows.mapInArrow(counted, f"key {kind}, dl bigint, terms array<string>, tfs array<bigint>"), analyser)


def _index(analysed: DataFrame, analyser: Analyser) -> Index:
    """``analysed`` has a row for each document, with its terms and their counts."""
    lengths = analysed.select("key", "dl")
    postings = analysed.select("key", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("key", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))
    documents = lengths.filter("dl > 0").crossJoin(F.broadcast(totals.select("avgdl"))).select("key", "dl", _length_norm().alias("k"))
    return Index(postings, documents, _with_idf(postings, totals), totals, analyser, analysed, analysed)


def asked_terms(index: Index, queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, term): the distinct terms of every query, by the index's own analyser."""
    return queries.select(qid, F.explode(F.array_distinct(index.analyser.words(F.col(text)))).alias("term"))


def search(index: Index, queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, key, lexical): the distinct terms of every query against the postings; unmatched documents score 0 and have no row.

    The postings are cut to the terms asked for before they are counted or
    exchanged; the planner broadcasts those terms while they are small. A stored
    index has its terms' idf already: nothing is counted, and a few terms are
    named to its scan.
    """
    asked = asked_terms(index, queries, qid, text)
    if index.analysed is None:
        some = [r["term"] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        named = F.col("term").isin(some) if len(some) <= PUSHED_TERMS else F.lit(True)
        postings, weighed = index.postings.filter(named), asked.join(index.terms.filter(named).select("term", "idf"), "term")
        return _weights(postings.join(weighed, "term"), index.totals).groupBy(qid, "key").agg(F.sum("weight").alias("lexical"))
    postings = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    weighed = asked.join(_with_idf(postings, index.totals), "term").select(qid, "term", "idf")
    return _weights(postings.join(weighed, "term"), index.totals).groupBy(qid, "key").agg(F.sum("weight").alias("lexical"))


#: Scores of documents and queries that are held at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Asked:
    """Queries against single documents. Term t is asked for by the queries query[first[t]:first[t + 1]]."""

    qids: list
    terms: pa.Array
    idf: np.ndarray
    first: np.ndarray
    query: np.ndarray
    avgdl: float

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of rows and queries in millionths, -1 where they share no term): BM25 rounded to 6 digits. A document is summed up in the order of its own terms, so that it scores the same in any batch."""
        width, terms, tfs = len(self.qids), batch.column("terms"), batch.column("tfs")
        dl = batch.column("dl").to_numpy(zero_copy_only=False)
        rows = max(1, CELLS // max(width, 1))
        for a in range(0, batch.num_rows, rows):
            n = min(rows, batch.num_rows - a)
            some = terms.slice(a, n)
            at = pc.fill_null(pc.index_in(some.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(at >= 0)
            t, tf = at[hit], tfs.slice(a, n).flatten().to_numpy(zero_copy_only=False)[hit].astype(float)
            row = np.repeat(np.arange(n), some.value_lengths().to_numpy(zero_copy_only=False))[hit]
            weight = self.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[a + row] / self.avgdl))
            many = self.first[t + 1] - self.first[t]
            entry = np.repeat(self.first[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
            total = np.bincount(np.repeat(row, many) * width + self.query[entry], np.repeat(weight, many), n * width)
            yield a, np.where(total > 0, np.floor(total * 1e6 + 0.5), -1.0).reshape(n, width)


def asked_of(index: Index, queries: DataFrame, qid: str, text: str) -> Asked:
    """The queries' terms with their idf, in the driver: a few numbers for each word of a query."""
    rows = asked_terms(index, queries, qid, text).join(index.terms.select("term", "idf"), "term").toArrow().combine_chunks()
    pairs = sorted(zip(rows.column("term").to_pylist(), rows.column(qid).to_pylist(), rows.column("idf").to_pylist(), strict=True))
    names, qids = list(dict.fromkeys(t for t, *_ in pairs)), sorted({q for _, q, _ in pairs})
    idf, at = {t: x for t, _, x in pairs}, {q: i for i, q in enumerate(qids)}
    many = Counter(t for t, *_ in pairs)
    starts = np.cumsum([0, *(many[t] for t in names)])
    return Asked(qids, pa.array(names, pa.string()), np.array([idf[t] for t in names], float), starts, np.array([at[q] for _, q, _ in pairs], np.int64), index.totals.first()["avgdl"] or 1.0)


def best_ranks(index: Index, queries: DataFrame, qid: str, text: str, relevant: DataFrame) -> DataFrame:
    """(qid, rank): the place of each query's first relevant key (qid, key) in BM25's order of all documents, by score rounded to 6 digits, then the smaller key.

    Documents are read one by one, twice, and no score leaves its task: the first
    time those with relevant keys give each query's first place, the second time
    all are counted that stand before it. Exchanged are relevant keys and a number
    a query and task.
    """
    spark, kind, key_kind = queries.sparkSession, queries.schema[qid].dataType.simpleString(), index.counted.schema["key"].dataType.simpleString()
    qid_type = to_arrow_type(queries.schema[qid].dataType)
    held = spark.sparkContext.broadcast(asked_of(index, queries, qid, text))
    documents = index.counted.filter("key IS NOT NULL")
    wanted = relevant.groupBy("key").agg(F.collect_set(qid).alias("of"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        at = {q: i for i, q in enumerate(asked.qids)}
        for batch in batches:
            keys, of, found = batch.column("key"), batch.column("of").to_pylist(), []
            for a, scores in asked.scores(batch):
                found += [(q, a + i, scores[i, at[q]]) for i in range(len(scores)) for q in of[a + i] if q in at and scores[i, at[q]] >= 0]
            rows = pa.array([i for _, i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([q for q, *_ in found], qid_type), keys.take(rows), pa.array([s for *_, s in found], pa.float64())], names=["qid", "key", "score"])

    places = documents.join(wanted, "key").mapInArrow(placed, f"qid {kind}, key {key_kind}, score double")
    first = {r["qid"]: r["first"] for r in places.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("down"), "key")).alias("first")).collect()}
    firsts = spark.sparkContext.broadcast({q: (-f["down"], f["key"]) for q, f in first.items()})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        column = [i for i, q in enumerate(asked.qids) if q in firsts.value]
        names = [asked.qids[i] for i in column]
        score = np.array([firsts.value[q][0] for q in names])
        place = np.array([firsts.value[q][1] for q in names])
        before = np.zeros(len(names), np.int64)
        for batch in batches if names else ():
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for a, scores in asked.scores(batch):
                scores = scores[:, column]
                before += (scores > score).sum(axis=0)
                i, q = np.nonzero(scores == score)
                before += np.bincount(q[keys[a + i] < place[q]], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names, qid_type), pa.array(before)], names=["qid", "before"])

    return documents.mapInArrow(counted, f"qid {kind}, before bigint").groupBy("qid").agg((F.sum("before") + 1).alias("rank")).withColumnRenamed("qid", qid)
