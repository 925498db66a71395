"""Transcript parsing: a hidden Markov model over lines recovers turns and speakers, Viterbi decodes it, and turns are rendered.

A state is a role that begins a turn with this line, or a role that goes on with
it. A line emits a class made of its speaker marker, its length, whether it asks
and whether a blank line stands before it. Transition and emission counts come
from a bounded sample of labelled transcripts. So a turn is found where the path
enters a beginning state, with a marker or without one, and a marker inside a
quoted answer need not begin a turn.

A transcript is stored as one row or as many pieces in order; where a piece ends
tells the model nothing. It is decoded in chunks: each chunk gives the best path
value from every state before it to every state at its end, these small matrices
are combined in order, and each chunk is then decoded between the states that
the combination fixes. That is the Viterbi path of the whole, and no task holds
more than a chunk. Only classes travel to the chunks; the texts are exchanged
once, to meet the states of their lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import saved

ROLES = ("system", "user", "assistant")
#: Labelled transcripts that are counted at most: those whose ids hash lowest.
SAMPLE = 20_000
#: Piece numbers of a chunk, and the pieces above which a chunk is dealt on by number and text.
CHUNK_TURNS = 64
CHUNK_PIECES = 4096
SMOOTHING = 0.5

# Markers that transcripts put before a speaker's words, by role.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "student", "question", "q", "me", "prompt"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a", "response"),
}
_WORDS = "|".join(sorted((m for names in MARKERS.values() for m in names), key=lambda m: (-len(m), m)))
#: A speaker marker at the head of a line: a heading or an opening tag with nothing after the name, or a name that punctuation closes; the name is in the first or the second group.
MARKER = rf"(?i)^[ \t]*(?:(?:#{{1,4}}[ \t]*|<\|im_start\|>)({_WORDS})[ \t]*$|(?:#{{1,4}}[ \t]*|<\||\[|\*\*)?({_WORDS})[ \t]*(?:\|>|\]|:\*\*|\*\*:?|:|>)[ \t]*)"
_N = len(ROLES)
#: State k begins a turn of role k, state _N + k goes on with one.
STATES = 2 * _N
_N_LENGTH = 8
CLASSES = (_N + 1) * _N_LENGTH * 2 * 2
_NEVER = -1e30


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def observed(text: Column) -> Column:
    """The class that each line of a piece emits, from 0 to CLASSES - 1."""
    lines = lines_of(text)

    def of_line(line: Column, before: Column) -> Column:
        name = F.lower(F.concat(F.regexp_extract(line, MARKER, 1), F.regexp_extract(line, MARKER, 2)))
        marker = F.lit(0)
        for k, role in enumerate(ROLES, 1):
            marker = F.when(name.isin(*MARKERS[role]), F.lit(k)).otherwise(marker)
        length = F.least(F.floor(F.log2(F.length(line) / 8 + 1)), F.lit(_N_LENGTH - 1))
        asks, after_blank = F.rtrim(line).endswith("?").cast("int"), (F.trim(before) == "").cast("int")
        return (((marker * _N_LENGTH + length) * 2 + asks) * 2 + after_blank).cast("smallint")

    # each line next to the one before it: a lambda that looked into the lines would split the text again for every line
    before = F.concat(F.array(F.lit("-")), F.slice(lines, 1, F.size(lines) - 1))
    return F.zip_with(lines, before, of_line)


def with_markers(turns: DataFrame, missing: int = 20) -> DataFrame:
    """Labelled (conv_id, turn, role, text) as raw pieces: a speaker marker of varied style before each text, in ``missing`` of a hundred turns none.

    Style, name and lack depend on a hash of the row, so reruns agree. Turns
    without a known role get no marker; other columns are kept.
    """
    h = F.xxhash64("conv_id", "turn", "text")
    part = lambda shift, n: F.pmod(F.shiftrightunsigned(h, shift), F.lit(n)).cast("int")
    name = F.lit(None).cast("string")
    for role in ROLES:
        name = F.when(F.col("role") == role, F.element_at(F.lit(list(MARKERS[role])), part(8, len(MARKERS[role])) + 1)).otherwise(name)
    name = F.when(part(16, 2) == 0, F.initcap(name)).otherwise(name)
    styles = [("", ": "), ("### ", "\n"), ("<|im_start|>", "\n"), ("[", "] "), ("**", ":** "), ("", "> ")]
    marker = F.element_at(F.array(*[F.concat(F.lit(a), name, F.lit(b)) for a, b in styles]), part(24, len(styles)) + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    return turns.withColumn("text", F.when((part(32, 100) < missing) | marker.isNull(), text).otherwise(F.concat(marker, text)))


@dataclass(frozen=True)
class Model:
    """Logarithms: start[state], move[state, next state], emit[state, class]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pseudo-counts: dialogues open with a system or user turn and alternate; markers mostly begin a turn and tell the truth."""
    start = np.zeros(STATES)
    start[:_N] = [1.0, 2.0, 0.2]
    move = np.zeros((STATES, STATES))
    turn = np.array([[0.2, 2.0, 0.2], [0.05, 0.3, 3.0], [0.05, 3.0, 0.3]])
    for k in range(_N):
        move[[k, _N + k], :_N] = turn[k]
        move[[k, _N + k], _N + k] = 3.0
    emit = np.full((STATES, CLASSES), SMOOTHING / CLASSES * 4)
    marker = np.arange(CLASSES) // (_N_LENGTH * 4)
    for k in range(_N):
        emit[k, marker == k + 1] += 20 / (marker == k + 1).sum()
        emit[k, (marker > 0) & (marker != k + 1)] /= 20
        emit[_N + k, marker > 0] /= 20
        emit[_N + k, marker == 0] += 5 / (marker == 0).sum()
    return start, move, emit


def model_from(starts: dict, moves: dict, emits: dict) -> Model:
    """Counts by state; what the prior rules out (a turn that goes on without beginning, or under another role) stays so."""
    start, move, emit = _prior()
    for state, n in starts.items():
        start[state] += n
    for (a, b), n in moves.items():
        move[a, b] += n
    for (state, seen), n in emits.items():
        emit[state, seen] += n

    def log(x: np.ndarray) -> np.ndarray:
        x = x / x.sum(axis=-1, keepdims=True)
        return np.where(x > 0, np.log(np.maximum(x, 1e-300)), _NEVER)

    return Model(log(start), log(move), log(emit))


def fold() -> Column:
    """crc32 of the id's text, modulo 3; remainder 1 is held out."""
    return F.crc32(F.col("conv_id").cast("string")) % 3


def train(turns: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts over labelled raw (conv_id, turn, role, text), one row a turn, of at most ``sample`` conversations outside the held-out fold."""
    known = turns.filter(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & (fold() != 1))
    chosen = known.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    role = F.array_position(F.lit(list(ROLES)), F.col("role")).cast("int") - 1
    rows = saved(known.join(F.broadcast(chosen), "conv_id").select("conv_id", "turn", role.alias("r"), observed(F.col("text")).alias("seen")), "labelled")
    emits = rows.select("r", F.posexplode("seen").alias("at", "o")).groupBy("r", (F.col("at") > 0).cast("int").alias("on"), "o").agg(F.count("*").alias("n")).collect()
    # a turn's predecessor is the one a number below it; that needs no ordered gathering of a conversation
    shape = rows.select("conv_id", "turn", "r", F.size("seen").alias("n"))
    before = shape.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r").alias("p"), (F.col("n") > 1).cast("int").alias("long")).distinct()
    pairs = shape.join(before, ["conv_id", "turn"], "left").groupBy("p", "long", "r").agg(F.count("*").alias("turns"), F.sum((F.col("n") > 1).cast("int")).alias("several"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("more")).collect()
    starts, moves = {}, {}
    for p, long, r, n, several, more in pairs:
        for key, count in (((r, _N + r), several), ((_N + r, _N + r), more)):
            moves[key] = moves.get(key, 0) + count
        if p is None:
            starts[r] = starts.get(r, 0) + n
        else:
            moves[_N * long + p, r] = moves.get((_N * long + p, r), 0) + n
    return model_from(starts, moves, {(_N * on + r, o): n for r, on, o, n in emits})


def viterbi(model: Model, sequences: list[np.ndarray], firsts: list[int | None], lasts: list[int | None]) -> list[np.ndarray]:
    """Best states of each sequence; ``firsts`` are the states before them (None: it starts here), ``lasts`` those at their ends (None: any).

    Sequences of like length are stepped through together.
    """
    out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(sequences)
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
    before = np.vstack([model.move, model.start])
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and len(sequences[order[end]]) <= 2 * len(sequences[order[at]]) + 8:
            end += 1
        group, at = order[at:end], end
        sizes = np.array([len(sequences[i]) for i in group])
        seen = np.zeros((len(group), sizes.max()), dtype=np.int64)
        for row, i in enumerate(group):
            seen[row, : sizes[row]] = sequences[i]
        value = before[[STATES if firsts[i] is None else firsts[i] for i in group]] + model.emit[:, seen[:, 0]].T
        back = np.zeros((*seen.shape, STATES), dtype=np.int8)
        for step in range(1, seen.shape[1]):
            live = int(np.searchsorted(sizes, step, side="right"))  # sorted by length: the rows from here on go on
            options = value[live:, :, None] + model.move[None]
            back[live:, step] = options.argmax(axis=1)
            value[live:] = options.max(axis=1) + model.emit[:, seen[live:, step]].T
        state = np.array([value[row].argmax() if lasts[i] is None else lasts[i] for row, i in enumerate(group)])
        path = np.zeros(seen.shape, dtype=np.int64)
        for step in range(seen.shape[1] - 1, -1, -1):
            live = int(np.searchsorted(sizes, step, side="right"))
            path[live:, step] = state[live:]
            state[live:] = back[np.arange(live, len(group)), step, state[live:]]
        for row, i in enumerate(group):
            out[i] = path[row, : sizes[row]]
    return out


def chunk_matrix(model: Model, seen: list[int]) -> np.ndarray:
    """Best value of the chunk from each state before it (the last row: from the start) to each state at its end."""
    value = np.vstack([model.move, model.start]) + model.emit[:, seen[0]]
    for o in seen[1:]:
        value = (value[:, :, None] + model.move[None]).max(axis=1) + model.emit[:, o]
    return value


def boundaries(matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of each chunk on the best path through all."""
    value, back = matrices[0][-1], []
    for m in matrices[1:]:
        options = value[:, None] + m[:-1]
        back.append(options.argmax(axis=0))
        value = options.max(axis=0)
    at = int(value.argmax())
    out = [at]
    for step in reversed(back):
        at = int(step[at])
        out.append(at)
    return out[::-1]


_CHUNK = "conv string, c1 bigint, c2 bigint, c3 bigint"


def _matrices(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [chunk_matrix(model, [o for piece in pieces for o in piece["seen"]]).ravel().tolist() for pieces in batch.column("pieces").to_pylist()]
        yield batch.select(["conv", "c1", "c2", "c3"]).append_column("m", pa.array(values, pa.list_(pa.float64())))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for chunks in batch.column("chunks").to_pylist():
            ends = boundaries([np.array(c["m"]).reshape(-1, STATES) for c in chunks])
            out.append([{"c1": c["c1"], "c2": c["c2"], "c3": c["c3"], "before": ends[i - 1] if i else None, "last": end, "final": i == len(ends) - 1} for i, (c, end) in enumerate(zip(chunks, ends, strict=True))])
        kind = pa.list_(pa.struct([("c1", pa.int64()), ("c2", pa.int64()), ("c3", pa.int64()), ("before", pa.int32()), ("last", pa.int32()), ("final", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out, kind)], names=["conv", "fixed"])


def _decoded(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """One row a piece: its key, the states of its lines, and whether it opens or closes its transcript."""
    for batch in batches:
        convs, chunks, befores, lasts, finals = (batch.column(c).to_pylist() for c in ("conv", "pieces", "before", "last", "final"))
        paths = viterbi(model, [np.array([o for piece in pieces for o in piece["seen"]]) for pieces in chunks], befores, lasts)
        rows = {k: [] for k in ("conv", "at", "tie", "states", "opens", "closes")}
        for conv, pieces, path, before, final in zip(convs, chunks, paths, befores, finals, strict=True):
            done = 0
            for k, piece in enumerate(pieces):
                rows["conv"].append(conv)
                rows["at"].append(piece["at"])
                rows["tie"].append(piece["tie"])
                rows["states"].append(path[done : done + len(piece["seen"])].astype(np.int8))
                rows["opens"].append(before is None and not k)
                rows["closes"].append(final is not False and k == len(pieces) - 1)
                done += len(piece["seen"])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int8()), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))


def parse(pieces: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, text, states, opens, closes): the state of every line of every piece, and whether it is its transcript's first or last.

    ``pieces`` has conv_id, turn and text; a role column is not read. Pieces are
    ordered by turn (null first), of equal turns by a hash of the text; repeated
    rows count as one piece. Rows without a conv_id are each a transcript of
    their own; null texts count as empty, and an empty text is one empty line.
    Other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.col("turn").cast("bigint")
    conv = F.when(F.col("conv_id").isNull(), F.concat(F.lit("n"), F.sha2(F.concat_ws(":", turn, text), 256))).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    # the order within a conversation: turn, then a hash of the text
    keys = [conv.alias("conv"), F.coalesce(turn, F.lit(-(1 << 62))).alias("at"), F.xxhash64(text).alias("tie")]
    narrow = saved(pieces.select(*keys, observed(text).alias("seen")), "lines").withColumn("c1", F.floor(F.col("at") / CHUNK_TURNS))
    crowded = narrow.groupBy("conv", "c1").agg(F.count("*").alias("pieces_n")).filter(F.col("pieces_n") > CHUNK_PIECES)
    keyed = narrow.join(crowded, ["conv", "c1"], "left")
    deal = F.col("pieces_n").isNotNull()
    keyed = keyed.withColumn("c2", F.when(deal, F.col("at")).otherwise(F.lit(0))).withColumn("c3", F.when(deal, F.expr("shiftright(tie, 40)")).otherwise(F.lit(0).cast("bigint")))
    chunks = keyed.groupBy("conv", "c1", "c2", "c3").agg(F.sort_array(F.collect_set(F.struct("at", "tie", "seen"))).alias("pieces"))
    chunks = saved(chunks, "chunks")
    several = chunks.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    matrices = chunks.join(several, "conv", "left_semi").mapInArrow(lambda it: _matrices(it, model), f"{_CHUNK}, m array<double>")
    combined = matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("c1", "c2", "c3", "m"))).alias("chunks"))
    fixed = combined.mapInArrow(_ends, "conv string, fixed array<struct<c1:bigint,c2:bigint,c3:bigint,before:int,last:int,final:boolean>>")
    fixed = fixed.select("conv", F.explode("fixed").alias("f")).select("conv", "f.*")
    ready = chunks.join(fixed, ["conv", "c1", "c2", "c3"], "left").select("conv", "pieces", "before", "last", "final")
    paths = ready.mapInArrow(lambda it: _decoded(it, model), "conv string, at bigint, tie bigint, states array<tinyint>, opens boolean, closes boolean")
    texts = pieces.select("conv_id", turn.alias("turn"), text.alias("text"), *keys).dropDuplicates(["conv", "at", "tie"])
    return texts.join(paths, ["conv", "at", "tie"]).select("conv_id", "turn", "text", "states", "opens", "closes")


def rendered(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_turns, rendered) of ``parse``'s rows.

    ``rendered`` is the piece's share of the canonical transcript: every turn as
    ``<|im_start|>role``, its lines without their marker, ``<|im_end|>``. Pieces
    joined in order, with nothing between them, are the transcript. ``n_turns``
    counts the turns that begin in the piece, ``role`` is that of its first line.
    """
    named = lambda state: F.element_at(F.lit(list(ROLES)), state.cast("int") % _N + 1)
    numbered = F.arrays_zip(lines_of(F.col("text")).alias("line"), F.col("states").alias("state"), F.sequence(F.lit(0), F.size("states") - 1).alias("k"))

    def shown(x: Column) -> Column:
        body = F.regexp_replace(x["line"], MARKER, "")
        close = F.when(F.col("opens") & (x["k"] == 0), F.lit("")).otherwise(F.lit("<|im_end|>\n"))
        begin = F.concat(close, F.lit("<|im_start|>"), named(x["state"]), F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("\n"), body)))
        return F.when(x["state"] < _N, begin).otherwise(F.concat(F.lit("\n"), x["line"]))

    text = F.concat(F.array_join(F.transform(numbered, shown), ""), F.when(F.col("closes"), F.lit("<|im_end|>")).otherwise(F.lit("")))
    begun = F.size(F.filter("states", lambda s: s < _N)).cast("bigint")
    return parsed.select("conv_id", "turn", named(F.get("states", F.lit(0))).alias("role"), begun.alias("n_turns"), text.alias("rendered"))


def marker_role(line: str) -> str | None:
    """The role that a line's own marker names."""
    found = re.match(MARKER, line)
    return next(r for r, names in MARKERS.items() if (found[1] or found[2]).lower() in names) if found else None
