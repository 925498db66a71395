import itertools
import random
import zlib

import numpy as np

from marlstone.llm import transcripts as t

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seen string, conv int"


def fixture(n=200):
    rng = random.Random(3)
    rows = []
    for c in range(n):
        role = rng.choice(["system", "user", "user"])
        for turn in range(rng.randrange(1, 9)):
            size = {"system": 30, "user": 12, "assistant": 90}[role]
            rows.append((c, turn, role, "\n".join(" ".join(["w"] * rng.randrange(size // 3, size)) for _ in range(3 if role == "assistant" else 1)) + ("?" if role == "user" else "."), "x", 1))
            role = "assistant" if role == "user" else "user"
    return rows


def value(model, seen, path):
    return model.start[path[0]] + sum(model.emit[r, o] for r, o in zip(path, seen, strict=True)) + sum(model.move[a, b] for a, b in itertools.pairwise(path))


def brute(model, seen):
    return max(value(model, seen, path) for path in itertools.product(range(t.STATES), repeat=len(seen)))


def some_model(seed):
    rng = np.random.default_rng(seed)
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return t.Model(log(rng.random(t.STATES)), log(rng.random((t.STATES, t.STATES))), log(rng.random((t.STATES, t.CLASSES))))


def test_viterbi_and_chunks_match_brute_force():
    for seed in range(8):
        model, rng = some_model(seed), random.Random(seed)
        seen = [[rng.randrange(t.CLASSES) for _ in range(n)] for n in (5, 1, 4, 5, 2)]
        paths = t.viterbi(model, [np.array(x) for x in seen], [None] * 5, [None] * 5)
        assert all(abs(value(model, x, p) - brute(model, x)) < 1e-9 for x, p in zip(seen, paths, strict=True))
        chunks = [seen[0][:2], seen[0][2:3], seen[0][3:]]
        ends = t.boundaries([t.chunk_matrix(model, c) for c in chunks])
        parts = t.viterbi(model, [np.array(c) for c in chunks], [None, *ends[:-1]], ends)
        assert abs(value(model, seen[0], np.concatenate(parts)) - brute(model, seen[0])) < 1e-9
    long = [np.array([random.Random(n).randrange(t.CLASSES) for _ in range(n)]) for n in (3000, 1, 40, 41)]
    alone = [t.viterbi(model, [x], [None], [None])[0] for x in long]
    assert all((a == b).all() for a, b in zip(alone, t.viterbi(model, long, [None] * 4, [None] * 4), strict=True))


def held_out(rows):
    return {(c, n): (role, text) for c, n, role, text, *_ in rows if zlib.crc32(str(c).encode()) % 3 == 1}


def test_recovers_roles_and_turns(spark):
    """Held-out dialogues with markers of all styles, a fifth of them missing: roles, and turns neither lost nor invented."""
    rows = fixture()
    raw = t.with_markers(spark.createDataFrame(rows, SCHEMA))
    out = {(r["conv_id"], r["turn"]): r for r in t.rendered(t.parse(raw.drop("role"), t.train(raw))).collect()}
    held = held_out(rows)
    assert np.mean([out[k]["role"] == role for k, (role, _) in held.items()]) > 0.95 and len(out) == len(rows)
    assert np.mean([out[k]["n_turns"] == 1 for k in held]) > 0.95
    marked = {(r["conv_id"], r["turn"]): r["text"] for r in raw.collect()}
    bare = sum(t.marker_role(marked[k].split("\n")[0]) is None for k in held)
    assert 0.1 < bare / len(held) < 0.3


def test_pieces_make_the_whole_transcript(spark):
    """A transcript as one row and as many gives the same canonical text, also where pieces cut turns apart."""
    rows = fixture(30)
    raw = t.with_markers(spark.createDataFrame(rows, SCHEMA))
    model = t.train(raw)
    stored = sorted((r["conv_id"], r["turn"], r["text"]) for r in raw.collect())
    whole = {c: "\n".join(x[2] for x in group) for c, group in itertools.groupby(stored, key=lambda x: x[0])}
    single = [(c, k, line) for c, text in whole.items() for k, line in enumerate(text.split("\n"))]
    joined = []
    for data in (stored, [(c, 0, text) for c, text in whole.items()], single):
        out = t.rendered(t.parse(spark.createDataFrame(data, "conv_id bigint, turn bigint, text string"), model)).orderBy("conv_id", "turn").collect()
        joined.append({c: "".join(r["rendered"] for r in group) for c, group in itertools.groupby(out, key=lambda r: r["conv_id"])})
    blank = lambda d: {c: x.count("<|im_start|>") for c, x in d.items()}  # noqa: E731  lines after blank ones may be told otherwise at a cut
    assert joined[0] == joined[1] and blank(joined[1]) == blank(joined[2])
    for c, text in joined[1].items():
        assert text.count("<|im_start|>") == text.count("<|im_end|>") and text.endswith("<|im_end|>") and text.startswith("<|im_start|>")
        kept = [x for x in text.replace("<|im_end|>", "").split("\n") if x and not x.startswith("<|im_start|>")]
        assert " ".join(kept).split().count("w") <= whole[c].split().count("w")


def test_long_and_crowded_conversations(spark, monkeypatch):
    model = some_model(1)
    rng = random.Random(2)
    rows = [(1, n, "w " * rng.randrange(1, 300) + "\nq?" * (n % 3)) for n in range(300)] + [(2, 5, f"same turn {k} " * (k % 40)) for k in range(90)] + [(3, 1, "one\n" * 50_000)]
    pieces = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    whole = sorted(map(str, t.parse(pieces, model).collect()))
    for turns_in, blocks in ((16, 4096), (1000, 20), (7, 3)):
        monkeypatch.setattr(t, "CHUNK_TURNS", turns_in)
        monkeypatch.setattr(t, "CHUNK_PIECES", blocks)
        assert sorted(map(str, t.parse(pieces, model).collect())) == whole


def test_raw_transcripts(spark):
    raw = "Preamble\nUser: hi there\nmore\n### Assistant\nanswer one\nHUMAN> again?\n<|im_start|>assistant\nyes\n[System] rules\n**User:** bye"
    rows = [(1, 0, raw), (2, 0, None), (3, 0, "no marker")]
    out = {r["conv_id"]: r for r in t.rendered(t.parse(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string"), t.model_from({}, {}, {}))).collect()}
    turns = out[1]["rendered"].split("<|im_start|>")[1:]
    assert turns[1:] == [
        "user\nhi there\nmore<|im_end|>\n", "assistant\nanswer one<|im_end|>\n", "user\nagain?<|im_end|>\n", "assistant\nyes<|im_end|>\n", "system\nrules<|im_end|>\n", "user\nbye<|im_end|>",
    ]
    assert out[1]["n_turns"] == 7 and out[2]["n_turns"] == 1 and out[3]["rendered"].endswith("no marker<|im_end|>")
    assert t.marker_role("Q: x") == "user" and t.marker_role("quiet") is None


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 0, "user", "a?", "x", 1), (None, 0, "user", "b?", "x", 1), (1, None, "user", None, "x", 1), (1, 0, None, "c", "x", 1), (1, 0, None, "c", "x", 1), (2, 0, "other", "", "x", 1)]
    turns = t.with_markers(spark.createDataFrame(rows, SCHEMA))
    out = t.rendered(t.parse(turns, t.train(turns))).collect()
    assert len(out) == 5 and all(r["role"] in t.ROLES for r in out)
    assert t.parse(turns.limit(0), t.train(turns.limit(0))).collect() == []
