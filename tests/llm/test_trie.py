"""Prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyscope.llm import prefix_trie as pt
from tallyscope.llm.queries import QUERIES
from tests.llm import plain

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def plain_nodes(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        words = len(plain.WORD.findall(path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    out = set()
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(sequences[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(who), len(path), parent, len(who), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def results(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_version(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op11_prefix_trie"](spark, sf_dir)) == plain_nodes(plain_rebuilt(rows))


def branching_rows(rng, n, longest):
    """Conversations that branch off one another anywhere, copies and prefixes of others among them."""
    made, rows = [[]], []
    for c in range(n):
        turns = list(rng.choice(made))[: rng.randrange(longest)]
        for _ in range(rng.choice([0, 0, 1, 2, rng.randrange(longest)])):
            turns.append((rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "d e f", "", "é g"])))
        made.append(turns)
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    return rows


def query(rows, spark, width=pt.WIDTH):
    return pt.nodes(*pt.rebuilt(pt.turns(spark.createDataFrame(rows, SCHEMA))), width)


@pytest.mark.parametrize("width, shard, share", [(128, 1 << 15, 4096), (128, 7, 3), (3, 1 << 15, 2), (4, 5, 2), (1, 11, 1)])
def test_borders_of_shards_and_levels(spark, monkeypatch, width, shard, share):
    monkeypatch.setattr(pt, "SHARD_ROWS", shard)
    monkeypatch.setattr(pt, "SHARE", share)
    monkeypatch.setattr(pt, "BLOCK", 10)
    rows = branching_rows(random.Random(width + shard), 120, 14)
    assert results(query(rows, spark, width)) == plain_nodes(plain_rebuilt(rows))


def test_a_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD_ROWS", 50)
    rng = random.Random(5)
    long = [(0, t, "user", f"word {t}") for t in range(500)]
    copies = [(c, t, "user", f"word {t}") for c in range(20, 500, 20) for t in range(7)]
    twin = [(100_020, t, "user", f"word {t}" if t != 300 else "other") for t in range(400)]
    others = [(1000 + t // 3, t % 3, "user", str(rng.randrange(9))) for t in range(300)]
    rows = [*long, *copies, *twin, *others]
    assert results(query(rows, spark, 16)) == plain_nodes(plain_rebuilt(rows))


def test_edges(spark):
    assert query([], spark).count() == 0
    # a conversation that loses all its turns to an absent lender is a member of the root
    losing = next(c for c in range(1, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [
        (losing, 0, "user", "only"), (2001, None, None, None), (2001, None, "user", "x " * 100_000), (2001, 3, "user", "same"),
        (2001, 3, "user", "same"), (None, 1, "user", "no id"), (40, 0, "user", "a"), (41, 0, "user", "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS n", "2 AS size", "3 AS level")
    got = results(pt.nodes(*pt.rebuilt(pt.turns(df))))
    # rows of one turn are ordered by hash here, so only their number can be compared
    want = plain_nodes(plain_rebuilt([r for r in rows if r[0] != 2001]))
    assert {g for g in got if g[0] != 2001 and g[1] > 0} == {w for w in want if w[1] > 0}
    assert [g[3] for g in got if g[1] == 0] == [4]
    only = results(query([(losing, 0, "user", "only")], spark))
    assert only == {(losing, 0, None, 1, 0, 1, 0, hashlib.sha256(str(losing).encode()).hexdigest())}
