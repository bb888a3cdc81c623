"""Secret scan: fixed patterns, and probabilistic automata inferred from the credentials that they find.

The base patterns label credentials in the corpus. For each kind a prefix tree of labelled
strings (over character classes) is folded into an automaton by merging states of one depth
whose symbol and end frequencies agree within Hoeffding's bound, so a format keeps its lengths.
A further automaton, whose states are the last ``CONTEXT`` classes, describes the other
candidates; what it has rarely seen backs off to shorter contexts. A candidate is a run of at
least as many credential characters as the shortest base credential has, or the part of a
run that lies beside base spans, as it stands and without the signs at its ends. Every candidate
of every text is scored. It is added as an ``inferred`` span if a format explains it, which is
when the format's own log probability per character is within what labelled strings that it was
not learned from reach, and if the log-likelihood ratio against the rest is above the kind's
threshold, so that being rare is not enough. The rest are all candidates but those that such a
format explains; a format that explains more than the share ``common`` of all candidates is no
mark of a secret, so these stay in the rest, and its threshold lies above nearly all of them.
Background, shares and thresholds come from the counts of all candidates' shapes; only the
labelled strings are bounded.

Offsets are code points, ends exclusive.

Edge cases: a null or empty text has no spans. Without credentials of a kind, that kind has no
automaton and adds nothing. Repeated rows have the same spans; other columns pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyscope.llm import textscan as ts
from tallyscope.llm.storage import free_name, stored

# Fixed patterns of the base kinds.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
INFERRED = "inferred"
LEAST = {"assign": 6, "access": 20, "hex": 24}
_ORDER = {k: i for i, k in enumerate((*KINDS, INFERRED))}

#: A text without any of these, in lower case, has no assignment.
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Shortest candidate, and shortest run that can hold a base access or hex match.
LEAST_RUN = min(LEAST.values())
LEAST_LONG = min(LEAST["access"], LEAST["hex"])
#: Classes that a state of the background remembers.
CONTEXT = 4
#: Scores of candidates are counted in steps of this part of a bit.
STEPS = 64
SIGNS = b"+/_.=-"
#: Bits a character by which a candidate may fall short of all labelled strings kept apart.
SLACK = 0.1
#: Weight of the shorter context where the background backs off, in counts.
BACK_OFF = 4.0
_IN_RUN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"))

Span = tuple[str, int, int]


def _classes() -> dict[str, str]:
    """Character classes: digits, small and capital letters (hexadecimal or not), each sign itself."""
    groups = {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}
    return {c: name for name, members in groups.items() for c in members} | {c: c for c in "+/_.=-"}


_CLASS = str.maketrans(_classes())
_SYMBOLS = len(set(_classes().values()))
_CLASS_OF = np.arange(256, dtype=np.uint8)
_CLASS_OF[list(map(ord, _classes()))] = list(map(ord, _classes().values()))


def shape(value: str) -> str:
    """The value with each character replaced by its class."""
    return value.translate(_CLASS)


class Automaton:
    """Deterministic probabilistic automaton; state 0 is the start."""

    def __init__(self, edges: list[dict[str, tuple[int, float]]], ends: list[float], other: list[float], final: list[bool] | None = None):
        self.edges, self.ends, self.other = edges, ends, other
        #: states where a string has ended
        self.final = final or [True] * len(ends)

    def log2(self, symbols: str) -> float:
        """log2 probability of the string and its end."""
        return self.read(symbols)[0]

    def read(self, symbols: str) -> tuple[float, bool]:
        """The probability, and whether a string has ended in the last state before."""
        state, total = 0, 0.0
        for s in symbols:
            found = self.edges[state].get(s)
            if found is None:
                total += self.other[state]
            else:
                state, p = found
                total += p
        return total + self.ends[state], self.final[state]


def infer(samples: Sequence[str], alpha: float = 0.05, smooth: float = 0.5) -> Automaton:
    """Fold the prefix tree of ``samples`` by merging compatible states of one depth, most visited first.

    Deep states of the tree have a visit or two each; merged, they know together how often strings
    of their length end.
    """
    children: list[dict[str, list[int]]] = [{}]  # symbol -> [state, times]
    visits, ends, depth = [0], [0], [0]
    for sample in samples:
        at = 0
        visits[0] += 1
        for s in sample:
            edge = children[at].get(s)
            if edge is None:
                edge = children[at][s] = [len(children), 0]
                children.append({})
                visits.append(0)
                ends.append(0)
                depth.append(depth[at] + 1)
            edge[1] += 1
            at = edge[0]
            visits[at] += 1
        ends[at] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = visits[a], visits[b]
            if not n or not m:
                continue
            most = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most >= 1:  # too few visits for any difference to count, here and below
                continue
            if abs(ends[a] / n - ends[b] / m) > most:
                return False
            for s in children[a].keys() | children[b].keys():
                x, y = children[a].get(s), children[b].get(s)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > most:
                    return False
                if x and y:
                    stack.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            visits[a] += visits[b]
            ends[a] += ends[b]
            for s, (to, times) in children[b].items():
                mine = children[a].get(s)
                if mine is None:
                    children[a][s] = [to, times]
                else:
                    mine[1] += times
                    stack.append((mine[0], to))

    # folding below a state only joins states of one depth, so depth by depth every state is met once
    kept, layer = [0], [0]
    while layer:
        front = [(edge, edge[0]) for a in layer for edge in children[a].values()]
        front.sort(key=lambda x: (-visits[x[1]], x[1]))
        layer = []
        for edge, b in front:
            same = next((a for a in layer if compatible(a, b)), None)
            if same is None:
                layer.append(b)
            else:
                edge[0] = same
                fold(same, b)
        kept += layer

    number = {s: i for i, s in enumerate(kept)}
    out_edges, out_ends, other = [], [], []
    for a in kept:
        total = visits[a] + smooth * (_SYMBOLS + 1)
        out_edges.append({s: (number[to], math.log2((times + smooth) / total)) for s, (to, times) in children[a].items()})
        out_ends.append(math.log2((ends[a] + smooth) / total))
        other.append(math.log2(smooth / total))
    return Automaton(out_edges, out_ends, other, [ends[a] > 0 for a in kept])


@dataclass
class Formats:
    """Automata of the kinds, that of other candidates, and each kind's threshold in bits and least bits a character."""

    kinds: dict[str, Automaton]
    rest: Automaton | None
    thresholds: dict[str, float]
    floors: dict[str, float]

    def __post_init__(self):
        self._known: dict[bytes, bool] = {}

    def scores(self, symbols: str) -> dict[str, float]:
        rest = self.rest.log2(symbols)
        return {k: a.log2(symbols) - rest for k, a in self.kinds.items()}

    def explained(self, symbols: str, kinds: Iterable[str] | None = None) -> list[str]:
        """The kinds whose strings the shape could be: of a length that was seen, and as probable a character as they are."""
        found = {k: self.kinds[k].read(symbols) for k in (self.kinds if kinds is None else kinds)}
        return [k for k, (p, final) in found.items() if final and p >= self.floors[k] * (len(symbols) + 1)]

    def bits(self, symbols: bytes) -> float:
        """Bits a character of the format that explains a secret best; of no secret, minus infinity."""
        value = symbols.decode()
        if not self.is_secret(symbols):
            return -math.inf
        return max(self.kinds[k].log2(value) / (len(value) + 1) for k in self.explained(value))

    def is_secret(self, symbols: bytes) -> bool:
        """Whether a candidate of this shape is a secret."""
        if self.rest is None:
            return False
        known = self._known.get(symbols)
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            value = symbols.decode()
            known = any(self.kinds[k].log2(value) - self.rest.log2(value) >= self.thresholds[k] for k in self.explained(value))
            if len(symbols) < 64:
                self._known[symbols] = known
        return known


def runs(inside: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs of bytes that are ``inside``, of at least ``least`` bytes."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    change = np.ones(len(inside) + 1, bool)
    change[1:-1] = (inside[1:] != inside[:-1]) | edge[1:-1]
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    keep = (ends - starts >= least) & inside[starts] if len(inside) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return np.searchsorted(bounds, starts, side="right") - 1, starts, ends


def _cut(texts: pa.Array) -> tuple[ts.Scan, bytes, dict[int, list[Span]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The scan, its bytes, base spans by row, and the row, start and end of all candidates; offsets are bytes of all."""
    s = ts.scan(texts)
    raw, inside = s.data.tobytes(), _IN_RUN[s.data]
    low, bounds = raw.lower(), s.bounds.tolist()
    base: dict[int, list[Span]] = {}
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        if any(low.find(x, lo, hi) >= 0 for x in _NAMES):
            found = [("assign", *m.span()) for m in ASSIGN.finditer(raw, lo, hi) if len(m[2]) >= LEAST["assign"]]
            if found:
                base[i] = found
    for i, a, b in zip(*(x.tolist() for x in runs(inside, s.bounds, LEAST_LONG))):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found = [(kind, *m.span()) for m in pattern.finditer(raw, a, b) if len(m[0]) >= LEAST[kind]]
            if found:
                base.setdefault(i, []).extend(found)
    for spans in base.values():
        for _, a, b in spans:
            inside[a:b] = False
    return s, raw, base, runs(inside, s.bounds, LEAST_RUN)


def found_in(texts: pa.Array, formats: Formats | None = None) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    """Row, text, base spans and further candidates of each text that has any; with ``formats``, only candidates that are secrets."""
    s, raw, base, (row, starts, ends) = _cut(texts)
    classes = _CLASS_OF[s.data].tobytes()
    others: dict[int, list[Span]] = {}
    for i, a, b in zip(row.tolist(), starts.tolist(), ends.tolist()):
        if formats is None:
            others.setdefault(i, []).append((INFERRED, a, b))
            continue
        # a full stop or a slash beside a key is none of its characters, unless the format says so
        whole, inner = classes[a:b], classes[a:b].strip(SIGNS)
        if LEAST_RUN <= len(inner) < b - a and formats.bits(inner) > formats.bits(whole):
            a = classes.index(inner, a, b)
            others.setdefault(i, []).append((INFERRED, a, a + len(inner)))
        elif formats.is_secret(whole):
            others.setdefault(i, []).append((INFERRED, a, b))
    # characters before each byte
    chars = np.append(0, np.cumsum((s.data & 0xC0) != 0x80))
    for i in sorted(base.keys() | others.keys()):
        lo, hi = int(s.bounds[i]), int(s.bounds[i + 1])
        spans = [[(k, int(chars[a] - chars[lo]), int(chars[b] - chars[lo])) for k, a, b in x.get(i, [])] for x in (base, others)]
        yield i, raw[lo:hi].decode(), sorted(spans[0], key=lambda x: (x[1], _ORDER[x[0]])), spans[1]


def _examples(docs: DataFrame, each: int) -> DataFrame:
    """``(kind, value, h, n)``: labelled strings of the least hashes, and all other candidates' shapes with counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        shapes: Counter[bytes] = Counter()

        def cut(kind: str) -> None:
            least = sorted(held[kind].items(), key=lambda x: (x[1], x[0]))[:each]
            held[kind] = dict(least)

        def counted() -> pa.RecordBatch:
            n = len(shapes)
            arrays = [pa.array([INFERRED] * n, pa.string()), pa.array([x.decode() for x in shapes], pa.string()), pa.array([0] * n, pa.int64()), pa.array(list(shapes.values()), pa.int64())]
            shapes.clear()
            return pa.RecordBatch.from_arrays(arrays, ["kind", "value", "h", "n"])

        for batch in ts.slices(batches):
            s, raw, base, (_, starts, ends) = _cut(batch.column(0))
            for spans in base.values():
                for kind, a, b in spans:
                    value = (ASSIGN.match(raw, a, b)[2] if kind == "assign" else raw[a:b]).decode()
                    held.setdefault(kind, {})[value] = xxhash.xxh64_intdigest(value.encode()) >> 1
                    if len(held[kind]) > 4 * each:
                        cut(kind)
            classes = _CLASS_OF[s.data].tobytes()
            shapes.update([classes[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
            if len(shapes) > 200_000:
                yield counted()
        yield counted()
        for kind in held:
            cut(kind)
        rows = [(kind, value, h, 1) for kind, values in held.items() for value, h in values.items()]
        if rows:
            kind, value, h, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(value), pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["kind", "value", "h", "n"])

    return stored(docs.select("text").mapInArrow(run, "kind string, value string, h long, n long"), "secret-examples")


def _shares(shapes: DataFrame, formats: Formats) -> dict[str, float]:
    """Share of all candidates that each kind explains, in their shapes or without the signs at their ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[""] += n
                for kind in {*formats.explained(value), *formats.explained(_inner(value))}:
                    seen[kind] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "n"])

    found = {r["kind"]: r["n"] for r in shapes.mapInArrow(run, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    return {k: found.get(k, 0) / max(found.get("", 0), 1) for k in formats.kinds}


def _inner(value: str) -> str:
    return value.strip(SIGNS.decode())


def background(shapes: DataFrame, formats: Formats | None = None, kinds: Sequence[str] = ()) -> Automaton | None:
    """Automaton of all ``(value, n)`` shapes that no format of ``kinds`` explains; a state is the last ``CONTEXT`` classes (``^`` is the start), an end the empty symbol."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if kinds and (formats.explained(value, kinds) or formats.explained(_inner(value), kinds)):
                    continue
                at = "^"
                for x in value:
                    steps[at, x] += n
                    at = (at + x)[-CONTEXT:]
                steps[at, ""] += n
        rows = list(steps.items())
        yield pa.RecordBatch.from_arrays([pa.array([c for (c, _), _ in rows], pa.string()), pa.array([x for (_, x), _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["at", "x", "n"])

    # contexts of at most CONTEXT classes: their number is bounded
    counts: dict[str, Counter[str]] = {}
    for at, x, n in shapes.mapInArrow(run, "at string, x string, n long").groupBy("at", "x").agg(F.sum("n")).orderBy("at", "x").collect():
        for k in range(len(at) + 1):
            counts.setdefault(at[k:], Counter())[x] += n
    if not counts:
        return None
    symbols = [*sorted(set(_classes().values())), ""]
    known: dict[str, dict[str, float]] = {}
    for at in sorted(counts, key=len):  # each context backs off to itself without its first class
        total, shorter = sum(counts[at].values()), known.get(at[1:]) if at else None
        known[at] = {x: (counts[at][x] + BACK_OFF * (shorter[x] if shorter else 1 / len(symbols))) / (total + BACK_OFF) for x in symbols}
    states = ["^", *sorted(c for c in counts if c != "^")]
    number = {at: i for i, at in enumerate(states)}

    def after(at: str, x: str) -> int:
        at = (at + x)[-CONTEXT:]
        while at not in number:
            at = at[1:]
        return number[at]

    edges = [{x: (after(at, x), math.log2(known[at][x])) for x in symbols if x} for at in states]
    return Automaton(edges, [math.log2(known[at][""]) for at in states], [0.0] * len(states))


def _quantiles(shapes: DataFrame, formats: Formats, spare: float) -> dict[str, float]:
    """Of each kind, the score that the share ``spare`` of all candidates does not exceed, to a step; at least 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, score in formats.scores(value).items():
                    seen[kind, max(math.ceil(score * STEPS), 0)] += n
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([x for (_, x), _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["kind", "x", "n"])

    found: dict[str, list[tuple[int, int]]] = {}
    for kind, x, n in shapes.mapInArrow(run, "kind string, x long, n long").groupBy("kind", "x").agg(F.sum("n")).orderBy("kind", "x").collect():
        found.setdefault(kind, []).append((x, n))
    out = {}
    for kind, rows in found.items():
        x, n = np.array(rows).T
        reached = np.cumsum(n)
        out[kind] = float(x[np.searchsorted(reached, spare * reached[-1])]) / STEPS
    return out


def least_reached(values: Sequence[str], folds: int = 5) -> float:
    """Fewest bits a character that a string reaches under the automaton of the other folds' strings; of very few, under their own."""
    found = []
    for fold in range(min(folds, len(values))):
        apart = values[fold::folds]
        others = [v for i, v in enumerate(values) if i % folds != fold] if len(values) >= folds else values
        automaton = infer(others)
        found += [automaton.log2(v) / (len(v) + 1) for v in apart]
    return min(found)


def learn(docs: DataFrame, text: str = "text", each: int = 1500, margin: float = 12.0, spare: float = 0.999, common: float = 0.02) -> Formats:
    """Infer the automata from at most ``each`` labelled strings of a kind, and the background from all other candidates.

    A kind's threshold is ``margin`` bits; of one that explains more than ``common`` of all other
    candidates, ``margin`` bits above what the share ``spare`` of them reach.
    """
    found = _examples(docs.select(F.col(text).alias("text")), each)
    order = Window.partitionBy("kind").orderBy("h", "value")
    labelled = found.where(F.col("kind") != INFERRED).select("kind", "value", "h").distinct()
    rows = labelled.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).orderBy("kind", "n").collect()
    shapes = stored(found.where(F.col("kind") == INFERRED).groupBy("value").agg(F.sum("n").alias("n")), "secret-shapes")
    formats = Formats({}, None, {}, {})
    for kind in KINDS:
        values = [shape(r["value"]) for r in rows if r["kind"] == kind]
        if values:
            formats.kinds[kind] = infer(values)
            formats.floors[kind] = least_reached(values) - SLACK
    shares = _shares(shapes, formats)
    rare = [k for k, x in shares.items() if x <= common]
    formats.rest = background(shapes, formats, rare) or background(shapes)
    if formats.rest is None:
        return Formats({}, None, {}, {})
    crowded = _quantiles(shapes, formats, spare) if len(rare) < len(shares) else {}
    formats.thresholds = {k: margin if k in rare else crowded[k] + margin for k in shares}
    return formats


def _ordered(base: list[Span], others: list[Span]) -> list[Span]:
    """All spans by start and kind."""
    return sorted([*base, *others], key=lambda x: (x[1], _ORDER[x[0]]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def with_spans(docs: DataFrame, formats: Formats, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` without its text and with all spans as an array of structs, in place of any column of that name."""
    kept = [c for c in docs.columns if c not in (text, into)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(into, ArrayType(_SPAN))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, text):
            all_spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, _, base, others in found_in(batch.column(text), formats):
                all_spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b in _ordered(base, others)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(all_spans, kind)], [*kept, into])

    return docs.mapInArrow(run, schema)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def redacted(docs: DataFrame, formats: Formats | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All documents with their secrets replaced by ``mark`` and ``n_chars`` counted anew, columns as given."""
    formats = formats or learn(docs)
    names, schema = docs.columns, docs.schema
    counted = free_name(names, "n_chars") != "n_chars"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches):
            texts: dict[int, str] = {}
            for i, whole, base, others in found_in(batch.column("text"), formats):
                parts, at = [], 0
                for _, a, b in _ordered(base, others):
                    if b > at:
                        parts += [whole[at : max(a, at)], mark if a >= at else ""]
                        at = b
                if parts:
                    texts[i] = "".join(parts) + whole[at:]
            columns = {c: batch.column(c) for c in names}
            if texts:
                rows = [texts.get(i, v) for i, v in enumerate(columns["text"].to_pylist())]
                columns["text"] = pa.array(rows, pa.string())
                if counted:
                    old = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(rows[i]) if i in texts else n for i, n in enumerate(old)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.mapInArrow(run, schema)
