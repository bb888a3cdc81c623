"""License scan by diagonal voting over word k-grams.

A word is a maximal run of ASCII digits, letters and anything beyond ASCII, with A-Z folded. Every
rolling k-gram of every text is one row with its hash, and Spark joins these rows to the k-gram
positions of the templates. A hit at word ``p`` of a text and word ``t`` of a template votes for
the diagonal ``p - t``; one unbroken copy of a template votes on one diagonal only. An inserted or
lost word moves the rest of a copy to a diagonal nearby, so the votes of diagonals at most
``SHIFT`` apart are merged. A span is verified before it counts: each hit by a second hash of its
words that is independent of the first, and the whole by the share of the template's words that
its hits cover and by its length.

Phrases count where all of their words stand in a row: every k-gram on one diagonal. Notices
count where ``share`` of their words is covered within merged diagonals.

Texts travel no further than the scan: the shuffle holds hits and one row per text. The templates
are a fixed list, so their table is broadcast. A very long text is cut into blocks of words.

Edge cases: null and empty texts have no words, no places, empty labels and score 0. Repeated rows
and null ids are scanned one by one. A text of fewer words than ``k`` has no k-gram. Columns other
than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyscope.llm import textscan as ts

#: Words of a k-gram.
PHRASE_K, NOTICE_K = 2, 4
#: Diagonals this far apart belong to one copy.
SHIFT = 8
#: k-grams of a block; a block is what one Arrow batch holds.
BLOCK = 1 << 17

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Template:
    """Words that stand for a license; ``share`` of them must be covered (1: a phrase, all in a row)."""

    label: str
    text: str
    share: float = 1.0
    base: bool = False

    @property
    def k(self) -> int:
        return PHRASE_K if self.share == 1 else NOTICE_K

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: The phrases of the base labels.
PHRASES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)

#: Opening words of well-known notices.
NOTICES = (
    Template("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.6),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.6),
    Template("cc-by", "licensed under cc by"),
    Template("cc-by-nc", "licensed under cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.6),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.6),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.6),
)


def _word_codes(s: ts.Scan) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word: a polynomial one, and one of length, first and last eight bytes."""
    n = s.ends - s.starts
    padded = np.zeros(len(s.data) + 8, np.uint8)
    padded[: len(s.data)] = s.data
    eight = np.ndarray((len(s.data) + 1,), "<u8", padded, 0, (1,))
    # the bytes of a shorter word only
    held = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)[np.minimum(n, 8)]
    head, tail = eight[s.starts] & held, eight[np.maximum(s.ends - 8, s.starts)] & held
    return s.hashes(s.starts, s.ends), ts.mix(ts.mix(head) + ts.mix(tail + np.uint64(1)) * np.uint64(5) + n.astype(np.uint64))


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (of the last ``k - 1`` words: of what follows them in the row)."""
    out = ts.mix(codes + np.uint64(k))
    for j in range(1, k):
        out[: len(out) - j] = ts.pair(out[: len(out) - j], codes[j:])
    return out


def _hashed(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, word index, hash and check hash of each k-gram."""
    s = ts.scan(texts, lower=True, within=WORD_BYTES)
    first = s.first
    here, check = _word_codes(s)
    place = np.arange(len(here)) - np.repeat(first[:-1], np.diff(first))
    whole = place + k <= np.repeat(np.diff(first), np.diff(first))
    return ts.owners(first)[whole], place[whole], _grams(here, k)[whole], _grams(check, k)[whole]


def template_grams(spark, templates: Sequence[Template]) -> DataFrame:
    """``(h, check, template, t)`` of every k-gram of the templates."""
    rows = []
    for i, template in enumerate(templates):
        _, place, h, check = _hashed(pa.array([template.text]), template.k)
        rows += zip(h.view(np.int64).tolist(), check.view(np.int64).tolist(), [i] * len(h), place.tolist())
    return spark.createDataFrame(rows, "h long, check long, template int, t int")


def text_grams(docs: DataFrame, ks: Sequence[int], text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per k-gram ``(row, p, h, check)``, and per text a row without hash that has its id and number of words.

    ``row`` numbers the texts by task, so repeated ids stay apart.
    """
    schema = StructType([
        StructField("row", LongType()), StructField("p", IntegerType()), StructField("h", LongType()), StructField("check", LongType()),
        StructField(key, docs.schema[key].dataType), StructField("n_words", LongType()),
    ])
    arrow = {f: pa.from_numpy_dtype(t) for f, t in (("row", np.int64), ("p", np.int32), ("h", np.int64), ("check", np.int64), ("n_words", np.int64))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 40
        for batch in ts.slices(batches, text, 1 << 20):
            n, ids, texts = batch.num_rows, batch.column(key), batch.column(text)
            s = ts.scan(texts, lower=True, within=WORD_BYTES)
            none = {c: pa.nulls(n, arrow[c]) for c in ("p", "h", "check")}
            cols = [pa.array(start + np.arange(n)), *none.values(), ids, pa.array(np.diff(s.first).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)
            first = s.first
            here, check = _word_codes(s)
            of_text, counts = ts.owners(first), np.diff(first)
            place = np.arange(len(here)) - np.repeat(first[:-1], counts)
            left = np.repeat(counts, counts) - place
            for k in ks:
                grams, checks = _grams(here, k), _grams(check, k)
                at = np.flatnonzero(left >= k)
                for lo in range(0, len(at), BLOCK):
                    some = at[lo : lo + BLOCK]
                    m = len(some)
                    cols = [
                        pa.array(start + of_text[some]), pa.array(place[some].astype(np.int32)), pa.array(grams[some].view(np.int64)),
                        pa.array(checks[some].view(np.int64)), pa.nulls(m, ids.type), pa.nulls(m, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, schema.names)
            start += n

    return docs.select(key, text).mapInArrow(run, schema)


def scanned(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_words, spans, score)`` of every row.

    ``spans``: verified ``(label, base, first, last, covered)``, by first word; ``last`` is behind the
    span's last word and ``covered`` the share of the template's words. ``score`` is the best share that any
    template reaches, verified or not.
    """
    spark = docs.sparkSession
    ks = sorted({t.k for t in templates})
    grams = text_grams(docs, ks, text, key)
    known = F.broadcast(template_grams(spark, templates).withColumnRenamed("check", "_check"))
    hits = grams.join(known, "h", "left").where(F.col("h").isNull() | (F.col("check") == F.col("_check")))

    def fixed(value) -> Column:
        """What a template has, by its number."""
        return F.element_at(F.array(*[F.lit(value(t)) for t in templates]), F.col("template") + 1)

    length, share, k = (fixed(f).cast(kind) for f, kind in ((lambda t: len(t.words), "int"), (lambda t: float(t.share), "double"), (lambda t: t.k, "int")))
    # all that follows is dealt by text; rows without a template carry the text's id and size
    dealt = hits.select("row", key, "n_words", "template", "t", (F.col("p") - F.col("t")).alias("diagonal")).repartition("row")
    votes = dealt.groupBy("row", "template", "diagonal").agg(
        F.collect_set("t").alias("ts"), F.min("t").alias("low"), F.max("t").alias("high"), F.max(key).alias(key), F.max("n_words").alias("n_words")
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, SHIFT)
    loose = share < 1
    merged = F.when(loose, F.array_distinct(F.flatten(F.collect_list("ts").over(near)))).otherwise(F.col("ts"))
    first, last = F.col("diagonal") + F.col("low"), F.col("diagonal") + F.col("high")
    votes = votes.select(
        "row", key, "n_words", "template", merged.alias("ts"),
        F.when(loose, F.min(first).over(near)).otherwise(first).alias("first"),
        (F.when(loose, F.max(last).over(near)).otherwise(last) + k).alias("last"),
    )
    words = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + k - 1))))
    covered = F.when(F.col("template").isNull(), F.lit(0.0)).otherwise(F.size(words) / length)
    votes = votes.withColumn("covered", covered)
    verified = (F.col("covered") >= share) & (F.col("last") - F.col("first") <= 2 * length)
    span = F.struct(
        F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"),
        fixed(lambda t: t.label).alias("label"), fixed(lambda t: t.base).alias("base"), "covered",
    )
    found = votes.groupBy("row").agg(
        F.max(key).alias(key), F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(verified, span))).alias("spans"), F.max("covered").alias("score"),
    )
    return found.select(key, "n_words", "spans", "score")


def labels_of(spans: Column) -> Column:
    """Distinct labels in order, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def _sql(templates: Sequence[Template] = (*PHRASES, *NOTICES)) -> str:
    """The scan in SQL, for tables without repeated ids."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    grams = ", ".join(f"({i}, {t.k}, {n}, {quoted(' '.join(t.words[n : n + t.k]))})" for i, t in enumerate(templates) for n in range(len(t.words) - t.k + 1))
    known = ", ".join(f"({i}, {quoted(t.label)}, {t.k}, {len(t.words)}, {float(t.share)}::DOUBLE, {str(t.base).lower()})" for i, t in enumerate(templates))
    every = " UNION ALL ".join(
        f"SELECT doc_id, p, {k} AS k, {" || ' ' || ".join(f'lead(w, {j}) OVER o' if j else 'w' for j in range(k))} AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)"
        for k in sorted({t.k for t in templates})
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM x), g AS ({every}),
    tg(tpl, k, t, gram) AS (VALUES {grams}), tk(tpl, label, k, n, share, base) AS (VALUES {known}),
    h AS (SELECT DISTINCT doc_id, tpl, t, p - t AS diagonal FROM g JOIN tg USING (k, gram)),
    v AS (SELECT doc_id, tpl, diagonal, list(t) AS ts, diagonal + min(t) AS lo, diagonal + max(t) AS hi FROM h GROUP BY doc_id, tpl, diagonal),
    m AS (SELECT a.doc_id, a.tpl, a.diagonal, min(b.lo) AS first, max(b.hi) + any_value(tk.k) AS last, flatten(list(b.ts)) AS ts
          FROM v a JOIN tk USING (tpl) JOIN v b ON b.doc_id = a.doc_id AND b.tpl = a.tpl AND b.diagonal BETWEEN a.diagonal AND a.diagonal + CASE WHEN tk.share < 1 THEN {SHIFT} ELSE 0 END GROUP BY a.doc_id, a.tpl, a.diagonal),
    c AS (SELECT m.*, label, base, share, n, len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + k))))) / CAST(n AS DOUBLE) AS covered FROM m JOIN tk USING (tpl)),
    s AS (SELECT *, covered >= share AND last - first <= 2 * n AS ok FROM c),
    f AS (SELECT doc_id, count(*) FILTER (ok AND base) AS n_base, min(first) FILTER (ok AND base) AS first_word, max(first) FILTER (ok AND base) AS last_word,
                 list_sort(list_distinct(list(label) FILTER (ok AND base))) AS bl, list_sort(list_distinct(list(label) FILTER (ok))) AS al, max(covered) AS score FROM s GROUP BY doc_id)
    SELECT x.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM x LEFT JOIN f USING (doc_id)
    """


SQL = _sql()
