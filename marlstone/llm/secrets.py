"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived
that every text with a match satisfies. Texts are indexed in shards of some
megabytes: for each trigram that any query names, the shard's texts that have
it. A rule's query is answered by intersecting and uniting these postings, and
only the candidates are searched; a rule without mandatory trigrams searches
all texts. Shards need no exchange between machines, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.regex_tree import op, parse

#: Exact strings that are followed at once while a query is derived; beyond, the expression counts as unknown there.
MOST_STRINGS = 64

Query = tuple  # ("all",), ("one", trigram), ("and", ...) or ("or", ...)
ALL: Query = ("all",)


@dataclass(frozen=True)
class Rule:
    """``least`` is the shortest accepted length of ``group``; shorter matches are dropped, and do not free their characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.encode())

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)


# The base kinds, then further public token formats, as (kind, pattern, shortest length, group).
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs are maximal, so this is the runs of 24 and more
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{22,255}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~-]+:[^\x00-\x20:/@]+@"),
    Rule("telegram", r"[0-9]{8,10}:[A-Za-z0-9_-]{35}"),
)
RULES = (*BASE, *MORE)


def _trigrams(text: str) -> Query:
    """All trigrams of a string."""
    return _and([("one", text[i : i + 3]) for i in range(len(text) - 2)])


def _and(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return parts[0] if len(parts) == 1 else ("and", *parts) if parts else ALL


def _or(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


class _Walk:
    """Follows a parsed expression; strings are lower-cased, as the index is."""

    def __init__(self):
        self.parts: list[Query] = []
        self.now: set[str] = {""}

    def cut(self) -> None:
        """What was followed so far is mandatory; what comes next is not known to join it."""
        self.parts.append(_or([_trigrams(s) for s in sorted(self.now)]))
        self.now = {""}

    def put(self, strings: set[str]) -> None:
        joined = {a + b for a, b in product(self.now, strings)}
        if len(joined) > MOST_STRINGS:
            self.cut()
            joined = strings if len(strings) <= MOST_STRINGS else {""}
        self.now = joined


def _exact(tree) -> set[str] | None:
    """All strings that an expression matches, or None if they are too many."""
    found = {""}
    for kind, value in tree:
        more = None
        if kind is op.LITERAL:
            more = {chr(value).lower()}
        elif kind is op.IN:
            more = _members(value)
        elif kind is op.SUBPATTERN:
            more = _exact(value[3])
        elif kind is op.BRANCH:
            branches = [_exact(b) for b in value[1]]
            more = None if None in branches else set().union(*branches)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] is not op.MAXREPEAT and value[1] <= 8:
            body = _exact(value[2])
            more = body and {"".join(p) for n in range(value[0], value[1] + 1) for p in (product(body, repeat=n) if len(body) ** n <= MOST_STRINGS else [None]) if p is not None}
            if body and any(len(body) ** n > MOST_STRINGS for n in range(value[0], value[1] + 1)):
                more = None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _derive(tree) -> Query:
    walk = _Walk()
    for item in tree:
        kind, value = item
        strings = _exact([item])
        if strings is not None:
            walk.put(strings)
            continue
        walk.cut()
        if kind is op.SUBPATTERN:
            walk.parts.append(_derive(value[3]))
        elif kind is op.BRANCH:
            walk.parts.append(_or([_derive(b) for b in value[1]]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            walk.parts.append(_derive(value[2]))
    walk.cut()
    return _and(walk.parts)


def trigram_query(pattern: str) -> Query:
    """A query that every text satisfies in which ``pattern`` matches, over lower-cased trigrams."""
    return _derive(parse(pattern))


def _named(query: Query) -> set[str]:
    return {query[1]} if query[0] == "one" else set().union(*map(_named, query[1:])) if query != ALL else set()


class Scanner:
    """The rules with one table of all trigrams that their queries name."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.names = {t: i + 1 for i, t in enumerate(sorted(set().union(*(_named(r.query) for r in rules))))}
        self.lookup = np.zeros(1 << 24, dtype=np.uint16)
        for trigram, number in self.names.items():
            a, b, c = trigram.encode()
            self.lookup[a << 16 | b << 8 | c] = number

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """For each named trigram the sorted numbers of the texts that have it."""
        folded = tokens.LOWER[data].astype(np.uint32)
        if len(folded) < 3:
            return {}
        numbers = self.lookup[folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]]
        at = np.flatnonzero(numbers)
        texts = np.searchsorted(offsets, at, side="right") - 1
        at = at[(offsets[texts + 1] - at) >= 3]  # not across two texts
        texts = np.searchsorted(offsets, at, side="right") - 1
        pairs = np.unique(numbers[at].astype(np.int64) << 40 | texts)
        cuts = np.searchsorted(pairs, np.arange(len(self.names) + 2, dtype=np.int64) << 40)
        return {name: pairs[cuts[n] : cuts[n + 1]] & ((1 << 40) - 1) for name, n in self.names.items()}

    def candidates(self, query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query == ALL:
            return np.arange(n)
        if query[0] == "one":
            return postings.get(query[1], np.empty(0, dtype=np.int64))
        found = [self.candidates(part, postings, n) for part in query[1:]]
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each text with spans: (start, rule number, end) in bytes of the text."""
        postings, body, out = self.postings(data, offsets), data.tobytes(), {}
        for number, rule in enumerate(self.rules):
            for text in self.candidates(rule.query, postings, len(offsets) - 1).tolist():
                for match in rule.compiled.finditer(body[offsets[text] : offsets[text + 1]]):
                    if match.end(rule.group) - match.start(rule.group) >= rule.least:
                        out.setdefault(text, []).append((match.start(), number, match.end()))
        return out


def _code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte positions to code points, sorted by start, then rule."""
    if not text.isascii():
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
        spans = [(int(heads[a]), k, int(heads[b])) for a, k, b in spans]
    return sorted(spans)


_scanners: dict[tuple, Scanner] = {}


def _per_batch(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    scanner = _scanners[rules]
    for batch in batches:
        data, offsets = tokens.utf8(batch.column("text"))
        spans: list[list[tuple[int, int, int]]] = []
        for at, end, run in _shards(data, offsets):
            found = scanner.scan(data[offsets[at] : offsets[end]], run)
            spans += [_code_points(data[offsets[at + i] : offsets[at + i + 1]].tobytes(), found[i]) if i in found else [] for i in range(end - at)]
        flat = [s for one in spans for s in one]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32))
        kinds = [rules[k].kind for _, k, _ in flat]
        values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())], names=["kind", "start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "found"])


def _shards(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + tokens.RUN_BYTES, side="right")) - 1)
        yield at, end, offsets[at : end + 1] - offsets[at]
        at = end


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): the spans of every text as (kind, start, end) in code points, by start, then by the rules' order.

    Matches of one rule are the leftmost that do not overlap; spans of different
    rules may. Null texts have none. Rows that repeat return each; an empty table
    gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _per_batch(it, rules), f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def annotate(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans; see ``find``."""
    joined = lambda where: f"array_join(transform({where}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    return find(docs, (*BASE, *more)).select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(found, s -> s.kind = '{r.kind}')) AS bigint)").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.expr(joined(f"filter(found, s -> s.kind IN ({kinds}))")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined("found")).alias("spans"),
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first stands for all."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (found,) = _per_batch(iter([batch.select(["doc_id", "text"])]), rules)
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), found.column("found").to_pylist(), strict=True):
                parts, at = [], 0
                for span in spans:
                    if span["start"] >= at:
                        parts += [text[at : span["start"]], mark.format(kind=span["kind"])]
                    at = max(at, span["end"])
                texts.append(text if text is None or not spans else "".join([*parts, text[at:]]))
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, type=batch.schema.field("text").type))

    return docs.mapInArrow(per_batch, docs.schema)


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
