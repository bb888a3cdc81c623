"""Quality rules, n-gram scores, line quality, language identification."""

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyscope.llm import language_id, line_quality, ngram_model, quality_rules, textscan
from tallyscope.llm.queries import QUERIES
from tests.llm import plain


def held(key, folds):
    return zlib.crc32(str(key).encode()) % folds == 0


def test_words_and_lines():
    texts = ["a b\n\nc", None, "", "x\x1cy z\n", "\n", "é è"]
    s = textscan.scan(pa.array(texts))
    words = [bytes(s.data[a:b]).decode() for a, b in zip(s.starts, s.ends)]
    assert words == ["a", "b", "c", "x\x1cy", "z", "é è"]
    row, a, b = textscan.lines(s)
    lines = [[bytes(s.data[i:j]).decode() for r, i, j in zip(row, a, b) if r == k] for k in range(len(texts))]
    assert lines == [(t or "").split("\n") for t in texts]


def test_hashes_tell_words_apart():
    words = [f"w{i}" for i in range(3000)] + ["ab", "ba", "aab", "aba", "a", "aa", "aaa"]
    s = textscan.scan(pa.array([" ".join(words), " ".join(reversed(words))]))
    h = s.hashes(s.starts, s.ends)
    assert len(set(h.tolist())) == len(words)
    assert h[: len(words)].tolist() == h[len(words) :][::-1].tolist()


def test_quality_statistics(spark, sf_dir, texts):
    rows = QUERIES["op1_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain.statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_rules_keep_good_and_reject_bad(spark):
    """At sf 0.01, where enough labels exist: at most one in fifty of either kind is judged wrong."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op1_quality_rules"](spark, sf_dir).where("NOT base_failed").join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.02


def test_learned_rules_are_the_expression():
    rng = np.random.default_rng(5)
    x = {r: rng.random(3000) for r in quality_rules.RATIOS}
    bad = ((x["symbol_share"] > 0.7) & (x["upper_share"] > 0.5)) | (x["repeat_share"] > 0.9)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.zeros(len(bad), bool)
    for rule in rules:
        hit |= quality_rules._covers(rule, x, len(bad))
    assert (hit == bad).mean() > 0.98
    assert quality_rules.learn_rules(x, np.zeros(3000, bool)) == []


def test_quality_edges(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (None, 0), (9, None), (4, 0)], "doc_id long, quality int")
    assert quality_rules.learn(odd_docs, labels.limit(0)) == []
    kept = quality_rules.kept_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == [1, 2, 2, None]  # the long text repeats itself, the others are too short
    empty = odd_docs.limit(0)
    assert quality_rules.kept_documents(empty, labels).count() == 0
    judged = quality_rules.judged(odd_docs, []).where("doc_id = 3").first()
    assert judged["stats"]["n_words"] == 0 and judged["base_failed"] and not judged["kept"]


def test_ngram_scores(spark, sf_dir, texts):
    rows = QUERIES["op3_ngram_scores"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    model = plain.KneserNey([t for k, t in texts.items() if not held(k, 10)])
    for r in rows:
        x = model.tokens(texts[r.doc_id])
        assert r.held_out == held(r.doc_id, 10)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(1 for w in x if model.count[w]), model.total)
        assert r.base_score == pytest.approx(model.base(texts[r.doc_id]), rel=1e-9)
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-6)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_ngram_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "b c c d", "a", None, ""]
    model = ngram_model.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    words = ["a", "b", "c", "d", "never"]
    s = textscan.scan(pa.array([" ".join(words)]))
    every = np.append(s.hashes(s.starts, s.ends), ngram_model.END)
    for before in [*every[:5], ngram_model.START]:
        logs, _ = model.score(every, np.full(len(every), before))
        assert (10**logs).sum() == pytest.approx(1.0)


def test_ngram_edges(spark, odd_docs):
    model = ngram_model.train(odd_docs)
    other = plain.KneserNey([r.text for r in odd_docs.select("text").collect()])
    rows = ngram_model.score(odd_docs, model)
    assert rows.columns == [c for c in odd_docs.columns if c not in ("text", "score")] + ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r.doc_id: r for r in rows.collect()}
    assert got[3].n_tokens == got[4].n_tokens == 1
    assert got[6].score == pytest.approx(other.score(odd_docs.where("doc_id = 6").first().text), rel=1e-6)
    assert ngram_model.score(odd_docs.limit(0), model).count() == 0
    none = ngram_model.train(odd_docs.limit(0))
    assert {(r.score, r.n_known, r.train_tokens) for r in ngram_model.score(odd_docs, none).collect()} == {(0.0, 0, 0)}


def test_hot_words_spread_over_shards():
    hot = np.array([5], np.uint64)
    before = np.full(1000, 5, np.uint64)
    now = textscan.mix(np.arange(1000))
    assert len({int(k) >> 60 for k in ngram_model.pair_keys(before, now, 4, hot)}) == 16
    assert len({int(k) >> 60 for k in ngram_model.pair_keys(before, now, 4, hot[:0])}) == 1


def test_counts_beyond_32_bits(tmp_path):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 50, np.uint64, endpoint=False))
    fields = [np.arange(50) * (10**9 if k else 7) for k in range(3)]
    fields[1][13] = 2**32 - 1
    uri = ngram_model._write(str(tmp_path), "words-0", keys, fields)
    files = ngram_model.HashFiles(0, 3, {0: (uri, 50)}, False)
    asked = np.concatenate([keys[::-1], keys[:5], np.array([12345], np.uint64)])
    want = np.stack([np.concatenate([f[::-1], f[:5], [0]]) for f in fields])
    assert (files.find(asked) == want).all()


def test_labels_of_any_number_type(spark):
    rows = [(i, ("A clean line of text, and one more.\n" if i % 2 else "x $$ ## 0 0\n") * 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for kind in ("long", "double", "boolean"):
        labels = docs.selectExpr("doc_id", f"CAST(doc_id % 2 AS {kind}) AS quality")
        scores = {r.doc_id: r.score for r in line_quality.scored(docs, line_quality.learn(docs, labels)).collect()}
        assert min(v for k, v in scores.items() if k % 2) > max(v for k, v in scores.items() if not k % 2)


def test_line_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op8_line_crf_quality"](spark, sf_dir)
    assert rows.count() == 1000 and rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = rows.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.93


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 4, 8])
    odds, table = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = line_quality.marginals(odds, line_quality.Chains(first), table, pairs=True)
    want, want_pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        n, total = b - a, 0.0
        sums, moved = np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = math.exp(sum(odds[a + k] * y[k] for k in range(n)) + sum(table[u, v] for u, v in zip(y, y[1:])))
            total += p
            sums += p * np.array(y)
            for u, v in zip(y, y[1:]):
                moved[u, v] += p
        if n:
            want[a:b] = sums / total
            want_pairs += moved / total
    assert good == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_line_quality_edges(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 0), (9, None), (6, 0)], "doc_id long, quality int")
    model = line_quality.learn(odd_docs, labels)
    rows = {r.doc_id: r.score for r in line_quality.scored(odd_docs, model).collect()}
    assert all(0 <= s <= 1 for s in rows.values())
    assert rows[3] == rows[4] == rows[5] == pytest.approx(model.prior)
    assert rows[1] > rows[6]
    assert line_quality.scored(odd_docs.limit(0), model).count() == 0
    assert line_quality.learn(odd_docs, labels.limit(0)).prior == 0.5


def test_segmentations_sum():
    pieces = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba"]
    lattice = language_id.Lattice(pieces)
    p = np.vstack([np.linspace(0.05, 0.3, 7)[:, None] * [[1.0, 0.5]], [[1e-7, 1e-7]]])

    def paths(text):
        if not text:
            return np.ones(2)
        total = sum((p[pieces.index(text[:j])] * paths(text[j:]) for j in range(1, len(text) + 1) if text[:j] in pieces), np.zeros(2))
        return total if text[0] in pieces else total + p[-1] * paths(text[1:])

    words = ["▁ab", "▁abba", "▁bbb", "▁axb", "▁" + "ab" * 9]
    got = language_id.word_logs(words, lattice, p)
    assert got == pytest.approx(np.log([paths(w) for w in words]))
    # expected counts: the counted letters of the pieces make up the words
    weights = np.ones((len(words), 2))
    sums = language_id.expected(["▁ab", "▁abba"], weights[:2], lattice, p)
    assert (sums * [[len(x)] for x in pieces]).sum(axis=0) == pytest.approx([8.0, 8.0])


def test_language_held_out(spark, sf_dir, docs):
    rows = QUERIES["op10_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, odd_docs):
    pieces = language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.learn(odd_docs, pieces, rounds=1)
    assert model.languages == ["en", "fr"]  # the text in German has no word
    rows = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert {rows[k].lang_pred for k in (3, 4, 5)} == {"und"} and rows[3].score == 0
    assert rows[7].lang_pred == "fr" and rows[6].lang_pred == "en"
    assert language_id.predict(odd_docs.limit(0), model).count() == 0
    none = language_id.learn(odd_docs.where("lang IS NULL"), pieces)
    assert {r.lang_pred for r in language_id.predict(odd_docs, none).collect()} == {"und"}
