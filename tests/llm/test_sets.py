"""Mixing, packing, archives, secrets, top-k, near-duplicates, and the pipeline of them."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyscope.llm import mixing, packing, secret_scan, simhash, topk, warc
from tallyscope.llm.queries import ORACLES, QUERIES
from tests.compare import compare, oracle_connection
from tests.llm import plain

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    sf_dir = f"/root/testdata/{sf}"
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], oracle_connection(sf_dir)) == []


@pytest.mark.parametrize("sizes", [[5, 5, 5, 5], [1, 1000, 3, 0, 7], [0, 0], [10], [100, 1, 1, 1, 1, 1, 1]])
def test_water_filling(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    left, budget, want = {f"s{i}": (n, (3, 1, 2)[i % 3]) for i, n in enumerate(sizes)}, 1.5 * sum(sizes), {}
    while left:  # plain rounds: stop whoever is above, share the rest anew
        unit = budget / sum(w for _, w in left.values())
        over = [s for s, (n, w) in left.items() if unit * w >= 2 * n]
        if not over:
            want |= {s: unit * w for s, (_, w) in left.items()}
            break
        for s in over:
            want[s] = 2.0 * left.pop(s)[0]
            budget -= want[s]
    assert got == pytest.approx(want)


def test_mixing_edges(spark, odd_docs):
    mix = mixing.mixed(odd_docs)
    assert mix.columns == odd_docs.columns
    times = Counter(r.doc_id for r in mix.select("doc_id").collect())
    assert times == Counter(r.doc_id for r in mixing.mixed(odd_docs).select("doc_id").collect())
    assert max(n for k, n in times.items() if k != 2) <= 2  # id 2 stands in two rows
    null_source = mixing.mix_rates(odd_docs.select("doc_id", "text", "source")).where("source IS NULL").select("mix.target").first()
    assert null_source.target > 0
    assert mixing.mixed(odd_docs.limit(0)).count() == 0


def plan_places(counts, capacity):
    """Every piece's sequence and offset from the runs."""
    out = defaultdict(list)
    for length, _, count, each, sequence, offset in packing.plan(counts, capacity):
        for k in range(count):
            out[sequence + k // each].append((offset + k % each * length, length))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = 60
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, capacity + 1, 40), rng.integers(1, 30, 40))}
    places = plan_places(counts, capacity)
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in rows) <= 2
    assert Counter(n for rows in places.values() for _, n in rows) == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    big = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert len(places) <= 1.25 * max(math.ceil(total / capacity), big) + 1


def test_packing_round_trip(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(TOKENIZER)
    rows = QUERIES["op4_best_fit_packing"](spark, sf_dir).collect()
    found, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for key, text in texts.items():
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(found[key]) == want
    for places in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)])]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= math.ceil(total / 4096) * 1.02 + 1


def test_packing_words_alone_equal_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    samples = ["Hello, world's don't!! it'S x_y 3.14 ½ ²a ǅ ΣΑΣ ΑΣ. É é. á,b", "A B C​D \x1c x\x85y", "<|endoftext|> a<|endoftext|>b ...", "naïve—text “quoted” …", "İI ẞ ﬁ 한글。"]
    encode = packing.WordEncoder(TOKENIZER)
    for s in samples:
        got = np.frombuffer(b"".join(encode.encode(w) for w in s.encode().split()), "<u4").tolist()
        assert got == whole.encode(s, add_special_tokens=False).ids


def test_packing_edges(spark, odd_docs):
    rows = packing.pack(odd_docs, TOKENIZER).collect()
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert [r.ids for r in of[3]] == [[1]] and [r.ids for r in of[4]] == [[1]]
    assert len(of[2]) == 2 and len(of[6]) == math.ceil(sum(r.length for r in of[6]) / 4096) > 1
    assert packing.pack(odd_docs.limit(0), TOKENIZER).count() == 0


def test_packing_stage_writes_the_ids(spark, sf_dir):
    df = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    for r in corpus_pipeline.packing_stage(spark, df, sf_dir).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for p in pages:
        body = (p.html or "").encode()
        first[body] = min(first.get(body, p.page_id), p.page_id)
    want = set()
    for p in pages:
        body = (p.html or "").encode()
        lead = first[body] == p.page_id
        want.add((p.page_id, len(body), warc.base32_sha1(body), "response" if lead else "revisit", None if lead else first[body]))
    rows = QUERIES["op5_warc"](spark, sf_dir).collect()
    assert len(rows) == len(pages) and {tuple(r) for r in rows} == want


@pytest.mark.parametrize("compress,level", [(False, 6), (True, 0), (True, 6)])
def test_archives_reject_magic_in_payloads(spark, monkeypatch, compress, level):
    monkeypatch.setattr(warc, "RANGE_BYTES", 700)
    inner = warc.record("response", 99, "u", b"x", warc.base32_sha1(b"x"), None)
    member = zlib.compressobj(6, wbits=31)
    packed = member.compress(inner) + member.flush()
    bodies = [b"abc\r\n\r\n" + inner * 2 + b"tail", packed * 3 + b"z", b"", None, b"q" * 3000 + b"\r\n\r\n" + inner, b"abc", b"WARC/1.1\r\n"]
    pages = [(i, "http://x\r\nContent-Length: 5" if i else None, bodies[i % 7]) for i in range(21)] + [(None, "n", b"no id"), (3, "again", b"abc")]
    df = spark.createDataFrame(pages, "page_id long, url string, html binary").selectExpr("*", "1 AS first", "2 AS body")
    files = warc.write(df, compress=compress, level=level)
    found = warc.links(files)
    got = warc.read(files).collect()
    if level != 6 or not compress:
        assert found.count() > len(pages)  # there are false candidates
    assert Counter(r.page_id for r in got) == Counter(p[0] for p in pages)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.page_id].append(r)
    for page_id, _, body in pages:
        body = body or b""
        hits = [r for r in by_id[page_id] if r.payload_digest == warc.base32_sha1(body) and r.payload_bytes == len(body)]
        assert hits and all(r.payload is None or bytes(r.payload) == body for r in hits)
        assert (hits[0].record_type == "response") == (hits[0].refers_to is None)


@pytest.mark.parametrize("compress", [False, True])
def test_headers_of_any_length(spark, compress):
    """A url beyond the bytes read at first loses no record; text that only looks like a header ends the search."""
    urls = ["http://a", "http://b/" + "x" * 70_000, "http://c", "http://d/" + "y" * 400_000, "http://e"]
    pages = [(i, u, "WARC/1.1\r\n" + "no header " * 9000 if i == 2 else f"body {i}") for i, u in enumerate(urls)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read(warc.write(df, compress=compress)).collect()}
    assert got == {i: (u, b) for i, u, b in pages}


def test_archives_cut_short_and_empty(spark, tmp_path):
    rec = warc.record("response", 1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    (tmp_path / "a.warc").write_bytes(rec + rec[:-9])
    (tmp_path / "b.warc").write_bytes(b"nothing" + rec)
    files = warc.list_files(spark, str(tmp_path))
    assert [bytes(r.payload) for r in warc.read(files).collect()] == [b"payload"]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(none)).count() == 0


def test_secrets_base(spark, sf_dir, texts):
    rows = QUERIES["op6_secret_scan"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain.base_secrets(texts[r.doc_id])
        kinds = Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == plain.sha256(plain.joined(want))
        assert set(filter(None, plain.joined(want).split(","))) <= set(r.spans.split(","))


def test_secret_offsets_are_code_points():
    text = 'é😀 PASSWORD:"é" Token\' = abcdef ſecret=aaaaaaa api_KEY=x/+=.-_y AKIA AKIA' + "A1" * 9 + " " + "0a" * 12 + "g " + "f" * 23
    [(_, _, base, _)] = secret_scan.found_in(pa.array([text]))
    assert base == plain.base_secrets(text)


def test_automata_tell_formats_apart():
    rng = np.random.default_rng(3)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(300)]
    words = ["".join(rng.choice(["th", "er", "on", "an", "re"], rng.integers(8, 12))) for _ in range(600)]
    key, rest = secret_scan.infer([secret_scan.shape(k) for k in keys[:200]]), secret_scan.infer([secret_scan.shape(w) for w in words[:400]])
    assert len(key.edges) == 41 and [k for k, e in enumerate(key.ends) if e > -1] == [40]  # one state for each length, the last ends
    assert key.log2(secret_scan.shape(keys[250])) > key.log2(secret_scan.shape(keys[250][:39])) + 6
    gain = lambda s: key.log2(secret_scan.shape(s)) - rest.log2(secret_scan.shape(s))
    assert min(map(gain, keys[200:])) > 20 > 0 > max(map(gain, words[400:]))


def test_secrets_inferred_and_redacted(spark, odd_docs):
    rng = np.random.default_rng(4)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    words = lambda: " ".join("".join(rng.choice(["th", "er", "on", "an"], 9)) for _ in range(8))
    short = lambda: key()[:22]  # shorter than the base pattern of hexadecimal runs
    hidden = short()
    rows = [(i, f"{words()} token = {short()} {words()}") for i in range(150)] + [(900, f"here is {hidden} only"), (901, None), (902, words())]
    rows += [(903, f"not {key()[:9]} nor {key()[:17]} here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    formats = secret_scan.learn(df)
    got = {r.doc_id: r.secrets for r in secret_scan.with_spans(df, formats).collect()}
    assert [tuple(s) for s in got[900]] == [("inferred", 8, 30)] and got[901] == [] and got[902] == [] and got[903] == []
    clean = {r.doc_id: r.text for r in secret_scan.redacted(df, formats).collect()}
    assert clean[900] == "here is [SECRET] only" and clean[901] is None and "token" not in clean[0]

    out = secret_scan.redacted(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    row = out.where("doc_id = 8").first()
    assert row.text == "[SECRET]' [SECRET] token: abc" and row.n_chars == len(row.text)
    assert secret_scan.redacted(odd_docs.limit(0)).count() == 0


def test_short_secrets_and_parts_beside_base_spans(spark):
    rng = np.random.default_rng(5)
    pick = lambda signs, n: "".join(rng.choice(list(signs), n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(x + y + z for x, y, z in zip(pick(mixed[:26], n), pick(mixed[26:52], n), pick("0123456789", n)))
    words = lambda: " ".join(pick("aeinorst", rng.integers(3, 12)) for _ in range(30))
    rows = [(i, f"{words()} token = {key(4)} {words()}") for i in range(200)] + [(400 + i, f"{words()} token = {key(13)} {words()}") for i in range(200)]
    short, access, long = key(4), "AKIA" + pick("ABCDEFGHIJ0123456789", 16), key(13)
    rows += [(900, f"pwd: {short} {words()}"), (901, f"{access}/{long} {words()}"), (902, words())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    formats = secret_scan.learn(df)
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in secret_scan.with_spans(df, formats).collect()}
    assert got[900] == [("inferred", 5, 5 + len(short))]
    assert got[901] == [("access", 0, 20), ("inferred", 21, 21 + len(long))]
    assert got[902] == []
    clean = {r.doc_id: r.text for r in secret_scan.redacted(df, formats).collect()}
    assert short not in clean[900] and long not in clean[901]


PLAIN = (
    "v1.2.3-rc4 utf-8 3.14159265358979 550e8400-e29b-41d4-a716-446655440000 2024-01-31 10.0.0.255 x86_64-linux-gnu foo_bar_baz "
    "index.html ISO-8859-1 1,234.56 a+b=c and/or well-known-problem README.md 4111111111111111 +49-170-1234567 C3PO E=mc2 snake_case_name"
)


@pytest.mark.parametrize("name, make", [
    ("fixed", lambda pick: pick(40)),
    ("prefixed", lambda pick: "ghp_" + pick(36)),
    ("lengths", lambda pick: pick(20 + sum(map(ord, pick(3))) % 13)),
    ("dashed", lambda pick: "-".join(pick(8) for _ in range(4))),
])
def test_recall_and_false_alarms(spark, name, make):
    """Keys of the labelled format are found without a name; versions, numbers, ids and words are left alone."""
    rng = np.random.default_rng(11)
    pick = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    words = lambda: " ".join("".join(rng.choice(["th", "er", "on", "an", "re"], rng.integers(1, 5))) for _ in range(20))
    rows = [(i, f"{words()} password: {make(pick)} {words()}.") for i in range(300)]
    planted = {1000 + i: make(pick) for i in range(200)}
    rows += [(k, f"{words()} see {v}{'.' if k % 2 else ''} {words()}") for k, v in planted.items()]
    rows += [(2000 + i, f"{words()}. {t} {words()}") for i, t in enumerate(PLAIN.split() * 3)]
    rows += [(3000 + i, words()) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    formats = secret_scan.learn(df)
    found = {r.doc_id: [tuple(s) for s in r.secrets if s.kind == "inferred"] for r in secret_scan.with_spans(df, formats).collect()}
    text = dict(rows)
    hits = sum([text[k][a:b] for _, a, b in found[k]] == [v] for k, v in planted.items())
    assert hits >= 0.9 * len(planted), hits
    assert [text[k] for k in found if k >= 2000 and found[k]] == []
    assert not any(found[k] for k in range(300))


def test_no_false_alarms_with_formats_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    formats = secret_scan.learn(docs)
    shapes = [secret_scan.shape(x).encode() for x in PLAIN.replace(",", " ").split()]
    assert not any(formats.is_secret(x) for x in shapes if len(x) >= secret_scan.LEAST_RUN)
    rng = np.random.default_rng(12)
    keys = [secret_scan.shape("".join(rng.choice(list("0123456789abcdef"), 40))).encode() for _ in range(200)]
    found = sum(map(formats.is_secret, keys))
    assert found >= 180, found  # what the tables' credentials look like
    assert not any(formats.is_secret(k[:n]) for k in keys for n in (8, 12, 20, 39))


def test_thresholds_cover_all_candidates(spark):
    """One candidate in 200 has a key's format, as few in a sample may: the threshold lies above them."""
    rng = np.random.default_rng(6)
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    word = lambda: "".join(rng.choice(list("ghijklm"), rng.integers(16, 20)))
    rows = [(i, f"{' '.join(word() for _ in range(20))} {key(20) if i % 10 == 0 else word()} token = {key(40)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    formats = secret_scan.learn(df, each=20)
    assert all(s.kind != "inferred" for r in secret_scan.with_spans(df, formats).collect() for s in r.secrets)
    shapes = spark.createDataFrame([("g" * 9, 600), ("0a" * 10, 1)], "value string, n long")
    worst = max(formats.scores("0a" * 10).values())
    low, high = (secret_scan._quantiles(shapes, formats, x) for x in (0.9, 0.9999))
    assert max(low.values()) == 0 and max(high.values()) == pytest.approx(worst, abs=1 / secret_scan.STEPS)
    one = secret_scan.background(shapes).log2("0a" * 10)
    assert one == pytest.approx(secret_scan.background(shapes.repartition(2)).log2("0a" * 10)) and one < secret_scan.background(shapes).log2("g" * 9)


def brute_top(rows, queries, k):
    width = max((len(v) for _, v in rows), default=0)
    ids = np.array([i for i, _ in rows])
    x = np.array([[math.floor(1024 * float(c)) for c in v] + [0] * (width - len(v)) for _, v in rows], np.int64)
    out = set()
    for q in queries:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out |= {(q, r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(order)}
    return out


def test_top_k(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["op7_exact_top_k"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == brute_top(rows, [i for i, _ in rows if i % 100 == 0], 10)


def _below(plan, name):
    """The parts of a plan's text below each node of a name."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if name in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_top_k_broadcasts_neither_packs_nor_blocks(spark, sf_dir, monkeypatch):
    plans, stored = [], topk.stored

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(topk, "stored", seen)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    assert topk.top_k(vectors, F.col("vec_id") % 100 == 0).count()
    sent = [x for p in plans for x in _below(p, "BroadcastExchange")]
    assert sent and not any("collect_list" in x or re.search(r"\bids#|\bxs#|\bq#", x) for x in sent)


def test_top_k_clustered_ties_and_edges(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, [float(c) for c in centres[i % 6] + rng.normal(size=8) * 0.05]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(700)]  # a hot vector
    odd = [(2000, None), (2001, [float("nan")] * 8), (2002, [float("inf")] + [0.0] * 7), (2003, [None] * 8), (None, [1.0] * 8), (2100, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = topk.top_k(df.selectExpr("*", "1 AS score", "2 AS ring"), F.col("vec_id") % 100 == 0, 10).collect()
    assert {tuple(r) for r in got} == brute_top([*rows, (2100, [])], [*range(0, 900, 100), *range(1000, 1700, 100), 2100], 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = topk.top_k(df.where("vec_id < 4"), F.col("vec_id") == 0, 10).collect()
    assert len(few) == 3


def test_top_k_of_large_components(spark):
    """Beyond 2**53 scores stay exact; beyond 2**63 they are an error, not a number."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 4)]) for i in range(200)]
    rows += [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(200, 260)]
    rows += [(260, [1e12, 0.0, 0.0, 0.0]), (261, [-1e30, 0.0, 0.0, 0.0])]
    want = {}
    whole = {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    for q in (0, 100, 200):
        scores = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        order = sorted(scores, key=lambda i: (-scores[i], i))[:10]
        want[q] = [(i, scores[i]) for i in order]
    fits = all(s < 2**63 for v in want.values() for _, s in v)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert not fits
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(df, F.col("vec_id") == 260).collect()
    small = df.where("vec_id < 260")
    got = topk.top_k(small, F.col("vec_id") % 100 == 0).collect()
    want = set()
    for q in (0, 100, 200):
        scores = {i: sum(a * b for a, b in zip(whole[q], whole[i])) for i in whole if i != q and i < 260}
        order = sorted(scores, key=lambda i: (-scores[i], i))[:10]
        want |= {(q, r + 1, i, scores[i]) for r, i in enumerate(order)}
    assert max(s for *_, s in want) > 2**53
    assert {tuple(r) for r in got} == want


def test_products_are_exact():
    rng = np.random.default_rng(4)
    for power in (10, 30, 40, 70):
        q, x = (np.floor(rng.normal(size=(n, 3)) * 2.0**power) for n in (5, 7))
        exact = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in x.tolist()] for r in q.tolist()]
        if max(map(max, exact)) >= 2**63:
            with pytest.raises(OverflowError):
                topk.products(q, x)
        else:
            assert topk.products(q, x).tolist() == [[max(v, -(2**63)) for v in r] for r in exact]


def test_top_k_of_empty_vectors(spark):
    df = spark.createDataFrame([(i, []) for i in range(5)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_index_of_other_sizes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    few = topk.usable(rows, "vec_id", "embedding")
    found = topk.search(topk.Index(few, pivots=3, rings=5), few.where("id % 100 = 0"), 4).collect()
    plain_rows = [(r.vec_id, r.embedding) for r in rows.collect()]
    assert {tuple(r) for r in found} == brute_top(plain_rows, [i for i, _ in plain_rows if i % 100 == 0], 4)


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-500, 500, (400, 5)).astype(float), rng.integers(-500, 500, (30, 5)).astype(float)
    pivots = topk.choose_pivots(x, 7)
    near, away = topk.nearest(x, pivots)
    norm = np.linalg.norm(x, axis=1)
    low, high, most = (np.array([f(v[near == k]) for k in range(7)]) for f, v in ((np.min, away), (np.max, away), (np.max, norm)))
    bound = topk.bounds(q, pivots, np.arange(7), low, high, most)
    assert (q @ x.T <= bound[:, near]).all()


def test_near_duplicates(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {k: plain.fingerprint(t) for k, t in texts.items()}
    lead = plain.components(prints)
    rows = QUERIES["op9_simhash_near_dedup"](spark, sf_dir).collect()
    assert {tuple(r) for r in rows} == {(k, f"{p:016x}", lead[k]) for k, p in prints.items()} and len(rows) == len(texts)


def test_links_connect_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(12):
            s ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            values.add(s)
    values |= {0, 2**64 - 1, 7, 2**63}
    want = plain.components({v: v for v in values})
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    links = simhash.fingerprint_links(df)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    groups, plain_groups = defaultdict(set), defaultdict(set)
    for v in values:
        groups[roots.get(signed(v), signed(v))].add(v)
        plain_groups[want[v]].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain_groups.values()))
    assert links.count() <= 40 * 14 * 14  # near copies do not give all their pairs


def test_links_of_tiles_in_many_shares(spark, monkeypatch):
    """Small blocks put one tile into a square of shares; no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(21)
    base = int(rng.integers(1 << 62))
    values = {base}
    while len(values) < 400:  # swaps of bits within a part keep the tile
        v = sorted(values)[int(rng.integers(len(values)))]
        i, j = (int(x) for x in rng.choice(16, 2, replace=False))
        if (v >> i & 1) != (v >> j & 1):
            v ^= 1 << i | 1 << j
        values.add(v)
    values |= {v ^ 1 << 40 for v in sorted(values)[:50]} | {int(x) for x in rng.integers(0, 1 << 62, 100)}
    want = plain.components({v: v for v in values})
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert {v: roots.get(v, v) for v in values} == want


def test_components_of_a_long_path(spark):
    n = 300
    order = np.random.default_rng(9).permutation(n).tolist()
    path = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {tuple(r) for r in simhash.components(path).collect()} == {(i, 0) for i in range(n)}
    assert simhash.components(path.limit(0)).count() == 0


def test_near_duplicate_edges(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    lead = {r.doc_id: r.component_id for r in rows}
    assert lead[2] == 1 and lead[4] == lead[5] == lead[3] == 3
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == [1, 3, 6, 7, 8, 9, None]
    assert simhash.one_of_each(odd_docs.limit(0)).count() == 0


def test_pipeline(spark, sf_dir, docs):
    """Each stage against a plain version of it, over what its predecessor kept."""
    from tallyscope.llm.storage import stored

    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, rows, sf_dir), "test-stage")
        if name != "best-fit packing":
            assert after.columns == docs.columns
        before, now = rows.collect(), after.collect()
        if name == "quality rules":
            kept = {r.doc_id for r in QUERIES["op1_quality_rules"](spark, sf_dir).where("kept").collect()}
            assert sorted(r.doc_id for r in now) == sorted(kept)
        elif name == "simhash near-dedup":
            lead = plain.components({r.doc_id: plain.fingerprint(r.text) for r in before})
            assert sorted(r.doc_id for r in now) == sorted(k for k, v in lead.items() if k == v)
        elif name == "secret scans":
            assert sorted(r.doc_id for r in now) == sorted(r.doc_id for r in before)
            assert all(plain.base_secrets(r.text) == [] for r in now)
        elif name == "mixing sources":
            times = Counter(r.doc_id for r in now)
            size = {r.doc_id: len(plain.WORD.findall(r.text)) for r in before}
            assert max(times.values()) <= 2
            assert sum(size[k] * n for k, n in times.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.2)
        else:
            assert sum(r.piece == 0 for r in now) == len(before)
        rows = after


def test_stages_take_odd_documents(spark, odd_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf_dir)
        out.collect()
        assert stage(spark, odd_docs.limit(0), sf_dir).count() == 0
