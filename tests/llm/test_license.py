"""License scan against a plain word-by-word version, and planted notices."""

import random
import re

import pytest

from tallyscope.llm import license_scan as ls
from tallyscope.llm.queries import QUERIES
from tests.llm import plain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(plain.lowered(text))


def plain_places(words, phrase):
    want = phrase.split()
    return [i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]


def plain_row(text):
    words = words_of(text)
    places = {t.label: plain_places(words, t.text) for t in ls.PHRASES}
    starts = [p for at in places.values() for p in at]
    labels = ",".join(sorted(k for k, at in places.items() if at))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels


def plain_covered(words, template):
    """Best share of the template's words that k-grams on diagonals within the shift cover."""
    want, k, by = template.words, template.k, {}
    for t in range(len(want) - k + 1):
        for p in range(len(words) - k + 1):
            if words[p : p + k] == want[t : t + k]:
                by.setdefault(p - t, set()).add(t)
    best = 0
    for d in by:
        near = [e for e in by if d <= e <= d + (ls.SHIFT if template.share < 1 else 0)]
        best = max(best, len({t + j for e in near for t in by[e] for j in range(k)}))
    return best / len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_version(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_license_scan"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert sum(r.n_base for r in rows) > 0
    templates = (*ls.PHRASES, *ls.NOTICES)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_row(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if sf == "sf0.001":
            words = words_of(texts[r.doc_id])
            assert r.score == pytest.approx(max(plain_covered(words, t) for t in templates))


def test_texts_of_phrase_words(spark, monkeypatch):
    """Phrases that overlap, repeat, stand at borders, or fall short by a word; blocks of few grams."""
    monkeypatch.setattr(ls, "BLOCK", 5)
    rng = random.Random(4)
    pool = ["mit", "MIT", "license", "License.", "apache", "general", "public", "é", "licenseé", "x1", "\x00", "[", "0"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scanned(df).collect()}
    for i, t in enumerate(texts):
        n, n_base, first, last, labels = plain_row(t)
        base = [s for s in got[i].spans if s.base]
        starts = [s.first for s in base]
        assert (got[i].n_words, len(base), min(starts, default=None), max(starts, default=None)) == (n, n_base, first, last)
        assert ",".join(sorted({s.label for s in base})) == labels


def test_edited_notices_are_found_and_pieces_are_not(spark):
    rng = random.Random(8)
    filler = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    rows, want = [], {}
    for template in [t for t in ls.NOTICES if t.share < 1]:
        for kind in ("whole", "edited", "piece"):
            words = list(template.words)
            if kind == "edited":  # one word lost, one put in, one replaced
                third = len(words) // 3
                words[2 * third] = "other"
                words.insert(third, "new")
                del words[1]
            if kind == "piece":
                words = words[: len(words) // 3]
            key = len(rows)
            rows.append((key, " ".join([*filler(40), *words, *filler(40)]).title()))
            want[key] = template.label if kind != "piece" else None
    # the same words in another order are no notice
    shuffled = list(ls.NOTICES[1].words)
    rng.shuffle(shuffled)
    rows.append((900, " ".join(shuffled)))
    want[900] = None
    # a repeated opening around one whole copy
    rows.append((901, "permission is hereby granted " * 50 + ls.NOTICES[6].text + " permission is hereby granted" * 50))
    want[901] = ls.NOTICES[6].label
    got = {r.doc_id: r for r in ls.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, label in want.items():
        # notices may name a license in words of a phrase, too
        found = {s.label for s in got[key].spans if s.label in {t.label for t in ls.NOTICES if t.share < 1}}
        assert found == ({label} if label else set()), (key, label)
        if label:
            at = [s for s in got[key].spans if s.label == label]
            text = words_of(rows[[k for k, _ in rows].index(key)][1])
            assert any(text[s.first : s.last][-2:] == next(t for t in ls.NOTICES if t.label == label).words[-2:] for s in at)


def test_word_codes_tell_words_apart(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    words = list({"".join(rng.choices("abé01", k=rng.randrange(1, 14))) for _ in range(3000)})
    s = ls.ts.scan(pa.array([" ".join(words)]), lower=True, within=ls.WORD_BYTES)
    for codes in ls._word_codes(s):
        assert len(np.unique(codes)) == len(words)


def test_edges(spark, odd_docs):
    out = ls.scanned(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[2]) == 2 and by[2][0] == by[2][1]
    for key in (3, 4, 5):
        assert (by[key][0].n_words, by[key][0].spans, by[key][0].score) == (0, [], 0.0)
    assert by[6][0].n_words == 90_000 and by[None][0].n_words > 0
    assert ls.scanned(odd_docs.limit(0)).count() == 0
    named = odd_docs.selectExpr("string(doc_id) AS name", "text AS body")
    assert ls.scanned(named, text="body", key="name").columns == ["name", "n_words", "spans", "score"]
