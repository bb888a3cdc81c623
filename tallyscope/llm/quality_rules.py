"""Quality rules: a learned decision list over text statistics, emitted as a Spark expression.

Sequential covering grows one conjunction of thresholds at a time on two thirds of the
labelled rows, prunes it on the rest, removes what it covers and goes on. The rules come
out in order, each as a condition that rejects; whatever no rule meets is kept.

Edge cases: a null or empty text has no words (all counts 0, base_failed true). Null or
repeated ids and further columns pass through; an empty table gives an empty result. With
no labelled rows, or one class only, no rule is learned and only the base test decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyscope.llm import textscan as ts
from tallyscope.llm.storage import free_name

SYMBOLS = b"#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
              "n_marks", "n_same_next"]
#: Statistics as ratios, which do not depend on the length of a text.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "mark_share": ("n_marks", "n_words"),
    "same_next_share": ("n_same_next", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_MARK = np.isin(np.arange(256), list(b"!?"))
_CODES = np.arange(256)
_IS_UPPER = (_CODES >= 65) & (_CODES <= 90)
_IS_LETTER = _IS_UPPER | ((_CODES >= 97) & (_CODES <= 122))
_IS_POINT = (_CODES & 0xC0) != 0x80  # first byte of a code point


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of an Arrow column."""
    s = ts.scan(texts)
    n, first = len(texts), s.first
    row = ts.owners(first)
    prefix = s.prefix()
    words = s.hashes(s.starts, s.ends, prefix)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = s.count(_IS_POINT[s.data] & ~ts.SPACE[s.data])
    out["n_symbols"] = s.count(_IS_SYMBOL[s.data])

    line_row, a, b = ts.lines(s)
    holds = np.searchsorted(s.starts, b) > np.searchsorted(s.starts, a)  # a word begins inside
    line_row, a, b = line_row[holds], a[holds], b[holds]
    again = ts.later(ts.pair(s.hashes(a, b, prefix), line_row.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)
    out["n_lines"] = np.bincount(line_row, minlength=n)

    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        own = row.astype(np.uint64)
        windows = ts.pair(ts.pair(ts.pair(words[:-2], words[1:-1]), words[2:]), own[2:])
        inside = row[2:] == row[:-2]
        twice = np.zeros(len(windows), bool)
        at = np.flatnonzero(inside)
        twice[at] = ts.repeated(windows[at])
        for shift in range(3):
            covered[shift : shift + len(twice)] |= twice
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    out["n_same_next"] = np.bincount(row[same], minlength=n)
    out["n_upper"] = s.count(_IS_UPPER[s.data])
    out["n_letters"] = s.count(_IS_LETTER[s.data])
    out["n_marks"] = s.count(_IS_MARK[s.data])
    return out


def with_statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """All columns of ``docs``, and a struct ``into`` (in place of any column of that name) with the statistics of the whole text."""
    kept = [c for c in docs.columns if c != into]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(into, StructType([StructField(x, LongType()) for x in STATISTICS]))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, text):
            found = statistics_of(batch.column(text))
            struct = pa.StructArray.from_arrays([pa.array(found[x], pa.int64()) for x in STATISTICS], STATISTICS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], struct], [*kept, into])

    return docs.mapInArrow(run, schema)


def ratio(name: str, stats: str | None = None) -> Column:
    """A ratio of ``RATIOS`` as a column; 0 where its base is 0."""
    above, below = (F.col(f"{stats}.{x}" if stats else x) for x in RATIOS[name])
    return F.when(below > 0, above / below).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.bound if self.above else x[self.feature] < self.bound

    def column(self, stats: str | None) -> Column:
        value = ratio(self.feature, stats)
        return value >= F.lit(self.bound) if self.above else value < F.lit(self.bound)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x, bad, weight_cuts: int) -> tuple[Condition | None, float]:
    """The condition with the largest information gain over the rows given."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 / (p0 + n0))
    best, most = None, 0.0
    for name, values in x.items():
        cuts = np.unique(np.quantile(values, np.linspace(0, 1, weight_cuts)))
        cuts = (cuts[1:] + cuts[:-1]) / 2
        if not len(cuts):
            continue
        order = np.argsort(values)
        at = np.searchsorted(values[order], cuts)
        below_p = np.append(0, np.cumsum(bad[order]))[at]
        below_n = at - below_p
        for above in (True, False):
            p = p0 - below_p if above else below_p
            n = n0 - below_n if above else below_n
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > most + 1e-9:
                best, most = Condition(name, above, float(cuts[i])), float(gain[i])
    return best, most


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, least_rows: int = 5,
                max_conditions: int = 5, cuts: int = 200) -> list[Rule]:
    """Sequential covering with grow and prune; rules reject rows where ``bad`` is true.

    A rule stays only if it is right on ``least_precision`` of the rows that it rejects, both
    where it was grown and where it was pruned. Ends when no rule qualifies any more.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    every = np.arange(len(bad))
    while True:
        grow = left & (every % 3 != 0)
        prune = left & (every % 3 == 0)
        if bad[grow].sum() < least_rows or bad[prune].sum() < 1:
            return rules
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_conditions and (~bad[inside]).any():
            best, _ = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside], cuts)
            if best is None:
                break
            rule += (best,)
            inside &= best.holds(x)

        def worth(r: Rule) -> float:
            hit = prune & _covers(r, x, len(bad))
            p, n = bad[hit].sum(), (~bad[hit]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())
        hit = left & _covers(rule, x, len(bad))
        checked = [hit & grow, hit & prune]
        if not rule or bad[hit].sum() < least_rows or any(m.any() and bad[m].mean() < least_precision for m in checked):
            return rules
        rules.append(rule)
        left &= ~hit


def rules_column(rules: list[Rule], stats: str | None = None) -> Column:
    """The decision list as one ordered conditional expression: false where a rule rejects."""
    out = None
    for rule in rules:
        test = rule[0].column(stats)
        for c in rule[1:]:
            test = test & c.column(stats)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          max_labelled: int = 12_000) -> list[Rule]:
    """Learn the rules from at most ``max_labelled`` labelled rows, those of the least key hashes.

    The bound keeps fitting the same at every size of the corpus. Only the sampled texts are
    measured; their keys, bounded by ``max_labelled``, are broadcast.
    """
    order = F.xxhash64(F.col("_k").cast("string"), F.lit("rules"))
    sample = (
        labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isNotNull())
        .orderBy(order, "_k", "_y").limit(max_labelled)
    )
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(F.broadcast(sample), "_k")
    rows = with_statistics(texts, "_text", "_s").select("_k", "_y", *[ratio(r, "_s").alias(r) for r in RATIOS])
    # a key may repeat in the documents; its rows are then examples of their own, within the same bound
    frame = rows.orderBy(order, *rows.columns).limit(max_labelled).toPandas()
    if frame.empty:
        return []
    return learn_rules({r: frame[r].to_numpy(float) for r in RATIOS}, frame["_y"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule], text: str = "text", into: str = "stats", failed: str = "base_failed", kept: str = "kept",
           min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with the struct ``into`` and booleans ``failed`` (the base test) and ``kept`` (base test and rules)."""
    n, again = F.col(f"{into}.n_words"), F.col(f"{into}.n_repeat_words")
    rows = with_statistics(docs, text, into).withColumn(failed, (n < min_words) | (again * 100 > n * max_repeat_percent))
    return rows.withColumn(kept, F.when(F.col(failed), False).otherwise(rules_column(rules, into)))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base test nor a learned rule rejects, columns as given."""
    into, failed, kept = (free_name(docs.columns, x) for x in ("stats", "base_failed", "kept"))
    rows = judged(docs, learn(docs, labels), into=into, failed=failed, kept=kept)
    return rows.where(F.col(kept)).select(*docs.columns)
