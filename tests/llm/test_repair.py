"""Conversation repair against plain strings and against all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyscope.llm import audits as au
from tallyscope.llm import repair
from tallyscope.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256().hexdigest()


def plain_damage(rows):
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def plain_repair(rows):
    """One conversation's damaged rows: the best edit string of every state, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts, faults = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        last = text.rstrip(BLANKS)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # state: what the kept initials end with; each held as (cost, audit, lines)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def put_in(live):
        for _ in range(4):
            for state, (cost, audit, lines) in list(live.items()):
                for to in after[state]:
                    if to != "s":
                        new = (cost + 5, audit + "I", [*lines, names[to] + ":"])
                        if to not in live or new[:2] < live[to][:2]:
                            live[to] = new
        return live

    live = put_in({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in live.items():
            ways = [(state, cost + 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                stay = cost + 5 * (fault == "truncated")
                ways += [(to, stay, "K", [f"{role}:{text}"]) for to in after[state] if to == role[:1]]
                ways += [(to, stay + 1, "R", [f"{names[to]}:{text}"]) for to in after[state] if to != "s"]
            for to, c, edit, more in ways:
                if to not in new or (c, audit + edit) < new[to][:2]:
                    new[to] = (c, audit + edit, [*lines, *more])
        live = put_in(new)
    cost, audit, lines = min((live[s] for s in ("", "a") if s in live), key=lambda x: x[:2])
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_all(rows):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in plain_damage(rows):
        by[conv].append((turn, role, text))
    return {k: plain_repair(v) for k, v in by.items()}


def results(df):
    out = {tuple(r)[0]: tuple(r)[1:] for r in df.collect()}
    assert len(out) == df.count()
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_version(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op12_conversation_repair"](spark, sf_dir)) == plain_all(rows)


def random_rows(rng, conversations, longest, odd=True):
    rows = []
    for c in range(conversations):
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None] if odd else ["user", "assistant", "system"])
            text = rng.choice(["Yes.", "No", "why?", " ", None, "", "ok. \n", "a.b", "Ünï!", f"t{rng.randrange(50)}."])
            rows.append((c if c != 3 else None, rng.choice([None, *range(-3, 40)]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_random_conversations(spark):
    rows = random_rows(random.Random(1), 300, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    assert results(repair.repair(repair.damaged(df))) == plain_all(rows)


@pytest.mark.parametrize("chunk", [1, 2, 7])
def test_chunks_give_the_same(spark, chunk, monkeypatch):
    """Conversations longer than a chunk are strung together from solved pieces."""
    monkeypatch.setattr(repair, "BLOCK", 40)
    rows = random_rows(random.Random(chunk), 40, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    assert results(repair.repair(repair.damaged(df), chunk)) == plain_all(rows)


def test_a_conversation_of_a_third_of_all_rows(spark):
    rng = random.Random(6)
    rows = [(0, t, rng.choice(["user", "user", "assistant"]), rng.choice(["Yes.", "No."]) + f" {t}.") for t in range(3000)]
    rows += [(1 + t // 4, t % 4, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert results(repair.repair(repair.damaged(df), 256)) == plain_all(rows)


def every_audit(steps):
    """All edit strings of at most three more rows, with cost; the pattern is checked on the result."""
    best = None
    for extra in range(4):
        for edits in itertools.product("DKRI", repeat=len(steps) + extra):
            if edits.count("I") != extra:
                continue
            rows, options, cost = iter(steps), [""], 0
            for e in edits:
                if e == "I":
                    cost += 5
                    options = [o + x for o in options for x in "ua"]
                    continue
                initial, fault = next(rows)
                if e == "D":
                    cost += 2
                    continue
                if fault in (repair.BLANK, repair.DUPLICATE):
                    cost = None
                    break
                cost += (e == "R") + 5 * (fault == repair.TRUNCATED)
                options = [o + x for o in options for x in (initial if e == "K" else "ua")]
            if cost is not None and any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                best = min(best or (99, ""), (cost, "".join(edits)))
    return best


def test_against_all_edit_sequences():
    for n in range(4):
        for steps in itertools.product([(i, f) for i in "suax" for f in (repair.SOUND, repair.BLANK, repair.TRUNCATED)], repeat=n):
            if n == 3 and hash(steps) % 7:
                continue
            audits = au.Audits()
            cost, node = repair.best(audits, repair.solve(audits, repair.first_live(audits), steps))
            assert (cost, audits.text(node)) == every_audit(steps), steps


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.text("ab", min_size=1, max_size=4)), max_size=60), st.data())
def test_linked_nodes_compare_like_strings(steps, data):
    audits, texts = au.Audits(), [""]
    for parent, piece in steps:
        parent %= len(texts)
        assert audits.add(parent, piece) == len(texts)
        texts.append(texts[parent] + piece)
    for _ in range(20):
        a, b = (data.draw(st.integers(0, len(texts) - 1)) for _ in range(2))
        same = next((i for i, (x, y) in enumerate(zip(texts[a], texts[b])) if x != y), min(len(texts[a]), len(texts[b])))
        assert audits.common(a, b) == same
        assert audits.less(a, b) == (texts[a] < texts[b])
        assert audits.text(a) == texts[a]


def test_colliding_hashes_do_not_decide(monkeypatch):
    """With a hash of two values nearly every prefix collides; comparisons stay right."""
    monkeypatch.setattr(au, "PRIME", 2)
    rng, audits, texts = random.Random(3), au.Audits(), [""]
    for _ in range(80):
        parent, piece = rng.randrange(len(texts)), rng.choice(["a", "b", "c"])
        audits.add(parent, piece)
        texts.append(texts[parent] + piece)
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert audits.less(a, b) == (texts[a] < texts[b])


def test_edges(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, lost, "user", "Gone."), (None, None, None, None), (6, 1, "user", "word " * 200_000 + "."), (6, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS gone", "1 AS cost", "'y' AS audit", "2 AS _chunk")
    got = results(repair.repair(repair.damaged(df)))
    assert got == plain_all(rows)
    assert got[5] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    # without damage, rows as they are
    plain = spark.createDataFrame([(1, 2, "assistant", "B."), (1, 1, "user", "A.")], SCHEMA)
    assert results(repair.repair(plain))[1] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:A.\nassistant:B.").hexdigest())
