import random
import re
import time

from marlstone.llm import licenses
from marlstone.llm.regex_tree import parse

SCHEMA = "doc_id bigint, text string, labels string, c string"


PATTERNS = [re.compile(rule.pattern) for rule in licenses.RULES]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + phrase.count(" ") + 1] == phrase.split()]
    c = " " + "  ".join(w) + " " if w else ""
    found = []
    for i, rule in enumerate(licenses.RULES):
        for m in PATTERNS[i].finditer(c):
            a = c[: m.start()].count(" ") // 2
            found.append((i, rule.label, licenses.RANKS[rule.kind], a, a + len(m[1].split())))
    better = lambda y, x: (y[2][0], x[3] - x[4], x[0]) and (y[2][0] < x[2][0] or y[2][0] == x[2][0] and (y[4] - y[3] > x[4] - x[3] or y[4] - y[3] == x[4] - x[3] and y[0] < x[0]))
    kept = [x for x in found if not any(y[3] <= x[3] and y[4] >= x[4] and better(y, x) for y in found)]
    starts = [k for k, _ in places]
    score = max([0.0, *(x[2][1] for x in kept), *([licenses.BASE_SCORE] if places else [])])
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted({x for _, x in places} | {x[1] for x in kept})), score)


def fixture():
    rng = random.Random(6)
    pieces = [
        "Licensed under the Apache License, Version 2.0.", "GNU General Public License v3", "CC BY-NC 4.0", "mit license", "MIT  License mit-license", "all rights reserved", "Copyright (c) 2019-2021 X",
        "SPDX-License-Identifier: GPL-2.0-only", "Permission is hereby granted, free of charge, to any person obtaining a copy", "released into the public domain", "Mozilla Public License 2.0", "cc by", "CC-BY CC BY-SA 3.0",
        "redistribution and use in source and binary forms, with or without modification", "mit", "gnu general public", "under the bsd", "the unlicense", "zlib license", "É", "日本", "9",
    ]
    rows = [(i, rng.choice([" ", "\n", "; "]).join(rng.choice([*pieces, "x", "word", "the"]) for _ in range(rng.randrange(0, 25)))) for i in range(100)]
    rows += [(300 + i, p) for i, p in enumerate(pieces)]
    return [*rows, (800, None), (801, ""), (802, "..."), (803, "İ mit license K"), (804, "long " * 50_000 + "mit license"), (None, "mit license"), (5, rows[5][1])]


def test_matches_brute_force(spark):
    rows = fixture()
    out = licenses.annotate(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()
    assert sorted(((r["doc_id"], *tuple(r)[1:]) for r in out), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_rules_are_gated():
    words = set(licenses.gate_words(licenses.RULES))
    assert len(licenses.RULES) > 300
    assert all(words & set(r.keyword.split()) for r in licenses.RULES)


def test_empty(spark):
    assert licenses.annotate(spark.createDataFrame([], SCHEMA)).collect() == []


def matches(pattern, pick):
    """A text that ``pattern`` matches, with each branch and repeat chosen by ``pick``."""
    out = []
    for op, arg in parse(pattern) if isinstance(pattern, str) else pattern:
        kind = str(op)
        if kind == "LITERAL":
            out.append(chr(arg))
        elif kind == "SUBPATTERN":
            out.append(matches(arg[3], pick))
        elif kind == "BRANCH":
            out.append(matches(pick(arg[1]), pick))
        elif kind == "MAX_REPEAT":
            out += [matches(arg[2], pick) for _ in range(pick([arg[0], min(arg[1], arg[0] + 2)]))]
        elif kind == "IN":
            first = arg[0]
            out.append("x" if str(first[0]) == "CATEGORY" else chr(first[1] if str(first[0]) == "LITERAL" else first[1][0]))
        else:
            out.append(".")
    return "".join(out)


def test_each_rule_is_found_alone(spark):
    rng = random.Random(2)
    rows, pure = [], set()
    for i, rule in enumerate(licenses.RULES):
        for text in {matches(rule.words, pick) for pick in (lambda x: x[0], lambda x: x[-1], rng.choice)}:
            found = PATTERNS[i].search(" " + text.replace(" ", "  ") + " ")
            assert found and f" {rule.keyword} " in f" {text} ", (rule, text)
            rows.append((len(rows), text))
            pure.add(i)
    assert len(pure) == len(licenses.RULES)
    rows += [(len(rows), "Copyrighted by X"), (len(rows) + 1, "this is copyrighted material")]
    out = {r["doc_id"]: tuple(r)[1:] for r in licenses.annotate(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()}
    assert out == {d: brute(t) for d, t in rows}
    assert all(x[5] for x in out.values()) and out[rows[-1][0]][5:] == ("copyright", 0.9)


def test_very_many_detections_in_one_text(spark):
    began = time.time()
    text = "mit license. " * 200_000
    out = licenses.annotate(spark.createDataFrame([(1, text, "x", "y")], SCHEMA)).first()
    assert (out["n_base"], out["labels"], out["score"]) == (200_000, "mit", 0.6)
    assert time.time() - began < 20


def test_spellings_of_versions(spark):
    want = {
        "GPLv2": "gpl-2.0", "under GPLv3 or later": "gpl-3.0", "LGPLv2.1": "lgpl-2.1", "3-clause BSD": "bsd-3-clause", "AGPL3": "agpl-3.0",
        "either version 2 of the License, or (at your option) any later version": "gpl-or-later", "GNU GPL version 3": "gpl-3.0", "MPLv2.0": "mpl-2.0",
    }
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(want)], SCHEMA)
    out = {r["doc_id"]: r["labels"].split(",") for r in licenses.annotate(docs).collect()}
    assert [t for i, t in enumerate(want) if want[t] not in out[i]] == []


def test_only_ascii_letters_are_lowered(spark):
    out = licenses.annotate(spark.createDataFrame([(1, "G\u212a MIT LICENSE \u0130", "x", "y")], SCHEMA)).first()
    assert out["n_words"] == 4 and out["base_labels"] == "mit"


def test_hand_written_signatures():
    assert len(licenses.SENTENCES) > 100
