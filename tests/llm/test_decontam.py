import random
import re

from marlstone.llm import decontam

DOCS = "doc_id bigint, text string, spans string, __text string"
BENCH = "item_id bigint, text string"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, bench, window=10):
    out = {}
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item, body in bench:
            b = words(body)
            n = min(window, len(b))
            for i in range(len(b) - n + 1 if b else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == b[i : i + n]:
                        hit |= set(range(k, k + n))
                        items.add(str(item))
        out[doc_id] = (len(w), len(hit), len(items), decontam.items_digest(sorted(items)), bool(hit))
    return out


def fixture():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["É", "ß", "x1"]
    bench = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 10, 14, 30])))) for i in range(12)] + [(50, None), (51, "..."), (52, "Only"), (52, "two words")]
    docs = []
    for i in range(30):
        body = rng.choices(vocab + ["z"], k=rng.randrange(0, 80))
        item = rng.choice(bench)[1] or ""
        docs.append((i, " ".join(body[:20]) + ",  " + item.upper() + "! " + " ".join(body[20:])))
    return [*docs, (90, None), (91, ""), (92, "only"), (93, "z " * 200_000 + (bench[4][1] or ""))], bench


def test_matches_brute_force(spark):
    docs, bench = fixture()
    docs = docs[:-1]
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in docs], DOCS)
    for block_words in (1_000_000, 60):
        out = decontam.annotate(df, spark.createDataFrame(bench, BENCH), block_words=block_words).collect()
        assert {r["doc_id"]: tuple(r)[1:6] for r in out} == brute(docs, bench)


def test_removal(spark):
    docs, bench = fixture()
    df, items = spark.createDataFrame([(d, t, "a", "b") for d, t in docs], DOCS), spark.createDataFrame(bench, BENCH)
    kept = decontam.drop_contaminated(df, items)
    assert kept.columns == df.columns
    hit = {r["doc_id"] for r in decontam.annotate(df, items).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - hit and 93 in hit
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(df, items).collect()}
    want = {r["doc_id"]: r["n_words"] - r["n_hit"] for r in decontam.annotate(df, items).collect()}
    assert {d: len(words(t)) for d, t in cut.items()} == want and cut[90] is None


def test_empty(spark):
    docs, bench = fixture()
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in docs], DOCS)
    none = spark.createDataFrame([], BENCH)
    assert not any(r["contaminated"] for r in decontam.annotate(df, none).collect())
    assert decontam.annotate(df.limit(0), spark.createDataFrame(bench, BENCH)).collect() == []


def test_blocks_hold_one_broadcast_at_a_time(spark):
    docs, bench = fixture()
    df, items = spark.createDataFrame([(d, t, "a", "b") for d, t in docs[:-1]], DOCS), spark.createDataFrame(bench, BENCH)
    sizes, real = [], decontam.Grams.__init__
    decontam.Grams.__init__ = lambda self, found, window: sizes.append(sum(len(t or "") for _, t in found)) or real(self, found, window)
    try:
        kept = decontam.drop_contaminated(df, items, block_words=25)
    finally:
        decontam.Grams.__init__ = real
    assert len(sizes) >= 5 and max(sizes) < sum(sizes) / 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BlockScanner" not in plan and plan.count("MapInArrow") <= 1
    found = brute(docs[:-1], bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, x in found.items() if not x[4]} and kept.columns == df.columns
