"""Prefix trie of conversations from sorted matrices of turn ids.

Rows of a matrix are the different conversations, columns their turns, short rows padded. Sorted
by ``numpy.lexsort``, rows that begin alike stand together; the columns in which a row differs from
the one above, OR-accumulated from the left, mark where the nodes of every depth start, and
``reduceat`` aggregates each depth. What a node needs of its subtree is a sum over its rows, where
each row stands for the nodes that the row above does not have.

The rows are cut by range into shards, one matrix each. A node at the border of a shard goes on in
the next: both emit their part, the parts meet by the node's path, and the whole goes back to the
shards that hold it. A row knows its likeness to the last row of the shard before it.

Conversations longer than ``width`` turns continue in a matrix of the next level, under the path so
far as a root of its own. What hangs below a root is summed up by pointer jumping over the levels,
so a conversation of any length takes a few rounds. Equal conversations are one row with a count
before anything is sorted; the ids that end at a node are sorted over all tasks and stream through
its hash in blocks.

Turns are told apart by two 64-bit hashes of role and text; texts leave the scan as hash and number
of words only.

Edge cases: a null role or text is empty. Null turns come first; rows of one turn are ordered by
their hash. Rows without a conversation id name no conversation and are left out. Repeated rows are
turns like any other. Further columns are not read. A conversation without turns is a member of the
root. Without conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyscope.llm.mixing import word_count
from tallyscope.llm.registry import crc32_sql
from tallyscope.llm.storage import stored
from tallyscope.operators.ordered import scan

#: Turns of a matrix; what is longer goes on in the next level.
WIDTH = 128
#: Rows of a shard.
SHARD_ROWS = 1 << 15
#: Rows of one key that meet in a join, and segments of one conversation in a window.
SHARE = 4096
#: Bytes of ids that travel as one block.
BLOCK = 1 << 18

EMPTY = hashlib.sha256().hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, x, y, words, n)``: the turns in order from 1, their two hashes, words, and the conversation's size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("x"),
        F.xxhash64(F.lit(1), text, role).alias("y"), word_count(text).alias("words"),
    )
    # texts are read once, however often the scan looks at its rows
    narrow = stored(narrow, "trie-turns")
    return stored(scan(narrow, ["conv_id"], [F.col("turn"), F.col("x"), F.col("y")], number="pos", total="n").drop("turn"), "trie-turns")


def rebuilt(turned: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation with a head lent by the first of its ``group``: ``(conv_id, place, x, y, words, size)`` and the empty ones' ids.

    The head is the lender's first crc32(id) mod ``most`` turns, all if it has fewer; it stands in place of
    as many own turns as were asked for.
    """
    lender = F.col("conv_id") - F.col("conv_id") % group
    asked = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    ids = turned.where("pos = 1").select("conv_id", "n", lender.alias("_lender"), asked.alias("_asked"))
    lent = turned.where((F.col("conv_id") == lender) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("_lender")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "x", "y", "words"))).alias("_head")
    )
    ids = ids.join(lent, "_lender", "left").withColumn("_head", F.slice(F.coalesce("_head", F.array()), 1, F.col("_asked")))
    ids = ids.withColumn("_got", F.size("_head")).withColumn("size", (F.col("_got") + F.greatest(F.col("n") - F.col("_asked"), F.lit(0))).cast("long"))
    ids = stored(ids, "trie-ids")
    heads = ids.select("conv_id", "size", F.explode("_head").alias("t")).select("conv_id", (F.col("t.pos") - 1).alias("place"), "t.x", "t.y", "t.words", "size")
    # one row per share of a conversation, so that a long one's turns are dealt out in shares
    shares = ids.select("conv_id", "size", "_asked", "_got", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SHARE))).alias("_share"))
    own = turned.withColumn("_share", F.floor((F.col("pos") - 1) / SHARE)).join(shares, ["conv_id", "_share"]).where(F.col("pos") > F.col("_asked"))
    own = own.select("conv_id", (F.col("pos") - F.col("_asked") - 1 + F.col("_got")).alias("place"), "x", "y", "words", "size")
    return heads.unionByName(own), ids.where("size = 0").select("conv_id")


def _segments(rows: DataFrame, empty: DataFrame, width: int) -> DataFrame:
    """Up to ``width`` turns a row: level, hashes of the path before and after, words behind, whether the conversation ends."""
    place_hash = F.xxhash64("place", "x", "y"), F.xxhash64(F.lit(1), "y", "x", "place")
    segments = rows.withColumn("level", F.floor(F.col("place") / width)).groupBy("conv_id", "level").agg(
        F.sort_array(F.collect_list(F.struct("place", "x", "y", "words"))).alias("items"), F.sum("words").alias("words"),
        F.bit_xor(place_hash[0]).alias("hx"), F.bit_xor(place_hash[1]).alias("hy"), F.max("size").alias("size"),
    )
    zero = F.lit(0).cast("long")
    segments = stored(segments, "trie-segments")
    short = segments.where(F.col("size") <= width).select(
        "conv_id", "level", zero.alias("px"), zero.alias("py"), F.col("hx").alias("ex"), F.col("hy").alias("ey"), "items", zero.alias("tail"), F.lit(True).alias("ended")
    )
    none = empty.select(
        "conv_id", zero.alias("level"), zero.alias("px"), zero.alias("py"), zero.alias("ex"), zero.alias("ey"),
        F.lit([]).cast(segments.schema["items"].dataType).alias("items"), zero.alias("tail"), F.lit(True).alias("ended"),
    )
    # running hashes and sums in two steps, so that no window holds all of a long conversation
    long = segments.where(F.col("size") > width).withColumn("_share", F.floor(F.col("level") / SHARE))
    inside, across = Window.partitionBy("conv_id", "_share").orderBy("level"), Window.partitionBy("conv_id").orderBy("_share")
    to_here, earlier, later = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    shares = long.groupBy("conv_id", "_share").agg(F.bit_xor("hx").alias("hx"), F.bit_xor("hy").alias("hy"), F.sum("words").alias("words"))
    shares = shares.select(
        "conv_id", "_share", *[F.coalesce(F.bit_xor(c).over(across.rowsBetween(*earlier)), zero).alias(f"_{c}") for c in ("hx", "hy")],
        F.coalesce(F.sum("words").over(across.rowsBetween(*later)), zero).alias("_tail"),
    )
    long = long.select(
        "*", F.bit_xor("hx").over(inside.rowsBetween(*to_here)).alias("ix"), F.bit_xor("hy").over(inside.rowsBetween(*to_here)).alias("iy"),
        F.coalesce(F.sum("words").over(inside.rowsBetween(*later)), zero).alias("it"),
    ).join(shares, ["conv_id", "_share"])
    ex, ey = F.col("ix").bitwiseXOR(F.col("_hx")), F.col("iy").bitwiseXOR(F.col("_hy"))
    long = long.select(
        "conv_id", "level", ex.bitwiseXOR(F.col("hx")).alias("px"), ey.bitwiseXOR(F.col("hy")).alias("py"), ex.alias("ex"), ey.alias("ey"), "items",
        (F.col("it") + F.col("_tail")).alias("tail"), (F.col("size") <= (F.col("level") + 1) * width).alias("ended"),
    )
    return stored(short.unionByName(none).unionByName(long), "trie-paths")


def _emitted(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _ends(paths: DataFrame) -> DataFrame:
    """``(ex, ey, ends)``: SHA-256 of the ids whose conversation ends at a path, in order.

    Ids are sorted over (path, id) by range, so those of one path spread; each task joins its run of
    a path into blocks, and only the blocks meet, as a stream.
    """
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType.fromDDL("ex long, ey long, part long, ids string")
    arrow = to_arrow_schema(schema)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        part, now, held, size = TaskContext.get().partitionId() << 40, None, [], 0
        for batch in batches:
            for x, y, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) != now or size >= BLOCK:
                    if held:
                        yield *now, part, ",".join(held)
                        part += 1
                    now, held, size = (x, y), [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield *now, part, ",".join(held)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        now, digest = None, None
        for batch in batches:
            for x, y, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) != now:
                    if digest is not None:
                        yield *now, digest.hexdigest()
                    now, digest = (x, y), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
        if digest is not None:
            yield *now, digest.hexdigest()

    ended = paths.where("ended").select("ex", "ey", "conv_id").repartitionByRange(parts, "ex", "ey", "conv_id").sortWithinPartitions("ex", "ey", "conv_id")
    joined = ended.mapInArrow(lambda batches: _emitted(blocks(batches), arrow, 1000), schema)
    final = StructType.fromDDL("ex long, ey long, ends string")
    final_arrow = to_arrow_schema(final)
    dealt = joined.repartition("ex", "ey").sortWithinPartitions("ex", "ey", "part")
    return dealt.mapInArrow(lambda batches: _emitted(hashed(batches), final_arrow), final)


_SHARD = (
    "shard int, level array<long>, px array<long>, py array<long>, ex array<long>, ey array<long>, weight array<long>, least array<long>, "
    "tail array<long>, ended array<boolean>, ends array<string>, width array<int>, codes array<int>, words array<long>, "
    "first struct<level:long,px:long,py:long,x:array<long>,y:array<long>>, last struct<level:long,px:long,py:long,x:array<long>,y:array<long>>"
)


def _shards(classes: DataFrame) -> DataFrame:
    """Each range of different rows as one sorted matrix, packed into one row."""
    schema = StructType.fromDDL(_SHARD)
    arrow = to_arrow_schema(schema)
    parts = max(-(-classes.count() // SHARD_ROWS), 1)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        num = {c: table.column(c).to_numpy() for c in ("level", "px", "py", "ex", "ey", "weight", "least", "tail")}
        items = table.column("items").chunk(0)
        width = np.diff(items.offsets.to_numpy()).astype(np.int32)
        flat = items.flatten()
        x, y, words = (flat.field(k).to_numpy() for k in (1, 2, 3))
        # codes in the order of the hashes, so that this order is the order of the ranges
        order = np.lexsort((y, x))
        new = np.ones(len(x), bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
        codes = np.zeros(len(x), np.int32)
        codes[order] = np.cumsum(new)
        matrix = _padded(codes, width)
        rows = np.lexsort((*matrix.T[::-1], num["py"], num["px"], num["level"]))
        begin = np.append(0, np.cumsum(width))
        take = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)

        def end(r: int) -> dict:
            at = slice(begin[r], begin[r + 1])
            return {**{c: int(num[c][r]) for c in ("level", "px", "py")}, "x": x[at].tolist(), "y": y[at].tolist()}

        one = lambda v: pa.array([v])
        cols = {c: one(v[rows]) for c, v in num.items()}
        cols |= {c: pa.array([table.column(c).take(pa.array(rows)).to_pylist()], t) for c, t in (("ended", pa.list_(pa.bool_())), ("ends", pa.list_(pa.string())))}
        cols |= {"width": one(width[rows]), "codes": one(codes[take]), "words": one(words[take]), "shard": pa.array([TaskContext.get().partitionId()], pa.int32())}
        cols |= {"first": pa.array([end(rows[0])], arrow.field("first").type), "last": pa.array([end(rows[-1])], arrow.field("last").type)}
        yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    dealt = classes.repartitionByRange(parts, "level", "px", "py", "items")
    return stored(dealt.mapInArrow(packed, schema), "trie-shards")


def _padded(flat: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Rows of their own widths as one matrix, zeros behind."""
    out = np.zeros((len(width), int(width.max(initial=0))), flat.dtype)
    out[np.arange(out.shape[1]) < width[:, None]] = flat
    return out


def _with_previous(shards: DataFrame) -> DataFrame:
    """Each shard with the last row of the one before, if any; the window sees one row a shard."""
    before = shards.select("shard", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("shard")).alias("previous"))
    return shards.join(before, "shard")


class _Matrix:
    """A shard's rows, and where the nodes of each depth start."""

    def __init__(self, row: dict, most: int) -> None:
        a = lambda c: np.asarray(row[c])
        self.shard, self.most = row["shard"], most
        self.level, self.px, self.py, self.ex, self.ey = (a(c).astype(np.int64) for c in ("level", "px", "py", "ex", "ey"))
        self.weight, self.least, self.tail = (a(c).astype(np.int64) for c in ("weight", "least", "tail"))
        self.ended, self.ends, self.width = a("ended").astype(bool), row["ends"], a("width").astype(np.int64)
        self.first, self.last, m = row["first"], row["last"], len(self.width)
        codes, words = (_padded(a(c).astype(np.int64), self.width) for c in ("codes", "words"))
        #: words of the first columns
        self.upto = np.concatenate([np.zeros((m, 1), np.int64), np.cumsum(words, axis=1)], axis=1)
        self.all = self.upto[np.arange(m), self.width]
        root = np.ones((m, 1), bool)
        root[1:, 0] = (self.level[1:] != self.level[:-1]) | (self.px[1:] != self.px[:-1]) | (self.py[1:] != self.py[:-1])
        change = np.ones_like(codes, bool)
        change[1:] = codes[1:] != codes[:-1]
        #: whether a row differs from the one above somewhere in the first columns
        self.start = np.logical_or.accumulate(np.concatenate([root, change], axis=1), axis=1)
        before = row["previous"]
        above = np.append(0, self.width[:-1])
        if before and all(before[c] == self.first[c] for c in ("level", "px", "py")):
            same = 0
            for here, there in zip(zip(self.first["x"], self.first["y"]), zip(before["x"], before["y"])):
                if here != there:
                    break
                same += 1
            self.start[0] = np.arange(self.start.shape[1]) > same
            above[0] = len(before["x"])
        #: columns shared with the row above; -1: not even the root
        self.shared = (~self.start).sum(axis=1) - 1
        #: the row above is a shorter conversation, and so no leaf
        self.longer = (self.shared == above).astype(np.int64)
        self.goes_on = (self.width == most) & ~self.ended
        self.leaf = np.ones(m, np.int64)
        self.below_words = np.zeros(m, np.int64)
        self.below_children = np.zeros(m, np.int64)

    def nodes(self, j: int) -> dict | None:
        """Aggregates of the nodes after ``j`` columns, of the rows here."""
        at = np.flatnonzero(self.width >= j)
        if not len(at):
            return None
        own = self.start[at, j]
        cut = own.copy()
        cut[0] = True
        st = np.flatnonzero(cut)
        head = self.upto[at, j - 1] if j else np.zeros(len(at), np.int64)
        shared = np.maximum(self.shared[at], 0)
        new = self.all[at] - np.where(own, head, self.upto[at, shared]) + self.below_words[at]
        leaves = self.leaf[at] - np.where(own, 0, self.longer[at])
        children = ((self.shared[at] <= j) & (self.width[at] > j)).astype(np.int64) + np.where(self.width[at] == j, self.below_children[at], 0)
        every = self.weight[at] * (self.all[at] - head) + self.tail[at]
        total = lambda v: np.add.reduceat(v, st)
        return {
            "rows": at[st], "own": own[st], "at": at, "groups": np.cumsum(cut) - 1,
            "least": np.minimum.reduceat(self.least[at], st), "n": total(self.weight[at]), "leaves": total(leaves),
            "children": total(children), "saved": total(every) - total(new), "new": total(new),
            "first": at[0] == 0 and not own[0], "last": at[-1] == len(self.width) - 1,
        }

    def path(self, side: str, j: int) -> bytes:
        """Name of the node after ``j`` columns of the first or last row."""
        end = self.first if side == "first" else self.last
        told = np.array([end["level"], end["px"], end["py"], j, *end["x"][:j], *end["y"][:j]], np.int64)
        return hashlib.blake2b(told.tobytes(), digest_size=16).digest()


SUMS = ("n", "leaves", "children", "saved", "new")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                value = column[i]
                plain = isinstance(value, pa.ListScalar) and value.is_valid and not pa.types.is_nested(value.type.value_type)
                row[name] = value.values.to_numpy(zero_copy_only=False) if plain and not pa.types.is_string(value.type.value_type) else value.as_py()
            yield row


def _mapped(shards: DataFrame, ddl: str, made: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted((out for row in _rows(batches) for out in made(row)), arrow)

    return shards.mapInArrow(run, schema)


def _below(shards: DataFrame, width: int) -> DataFrame:
    """The shards with what hangs below their unended full rows, and the least id of their roots above the first level."""

    def roots(row: dict) -> Iterator[tuple]:
        matrix = _Matrix(row, width)
        matrix.leaf = np.where(matrix.goes_on, 0, matrix.leaf)
        found = matrix.nodes(0)
        for g, r in enumerate(found["rows"].tolist()):
            if matrix.level[r]:
                yield int(matrix.shard), r, *(int(v[r]) for v in (matrix.level, matrix.px, matrix.py)), *(int(found[c][g]) for c in ("leaves", "new", "children"))

    def links(row: dict) -> Iterator[tuple]:
        matrix = _Matrix(row, width)
        for r in np.flatnonzero(matrix.goes_on).tolist():
            above = (int(v[r]) for v in (matrix.level, matrix.px, matrix.py)) if matrix.level[r] else (None, None, None)
            yield int(matrix.shard), r, *(int(v[r]) for v in (matrix.least, matrix.level + 1, matrix.ex, matrix.ey)), *above

    key = ["level", "px", "py"]
    heads = stored(_mapped(shards, "shard int, at int, level long, px long, py long, leaves long, words long, children long", roots), "trie-heads")
    found = heads.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("leaves", "words", "children")])
    joints = stored(_mapped(shards, "shard int, at int, least long, level long, px long, py long, jl long, jx long, jy long", links), "trie-joints")
    tree = stored(found.join(joints.select(*key, "jl", "jx", "jy"), key), "trie-roots")
    while not tree.where(F.col("jl").isNotNull()).isEmpty():
        # every root hands its sum to the root it points to, and points twice as far
        given = tree.where(F.col("jl").isNotNull()).groupBy(F.col("jl").alias("level"), F.col("jx").alias("px"), F.col("jy").alias("py")).agg(
            F.sum("leaves").alias("_leaves"), F.sum("words").alias("_words")
        )
        ahead = tree.select(*[F.col(a).alias(b) for a, b in zip((*key, "jl", "jx", "jy"), ("jl", "jx", "jy", "kl", "kx", "ky"))])
        tree = tree.join(given, key, "left").join(ahead, ["jl", "jx", "jy"], "left").select(
            *key, (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("words") + F.coalesce("_words", F.lit(0))).alias("words"),
            "children", F.col("kl").alias("jl"), F.col("kx").alias("jx"), F.col("ky").alias("jy"),
        )
        tree = stored(tree, "trie-roots")
    below = joints.select("shard", "at", *key).join(tree.select(*key, "leaves", "words", "children"), key)
    below = below.groupBy("shard").agg(F.collect_list(F.struct("at", "leaves", "words", "children")).alias("below"))
    # who ends right at a root has no row in its level
    named = heads.select("shard", "at", *key).join(joints.select(*key, "least"), key)
    named = named.groupBy("shard").agg(F.collect_list(F.struct("at", "least")).alias("heads"))
    return shards.join(below, "shard", "left").join(named, "shard", "left")


def _hung(matrix: _Matrix, row: dict) -> _Matrix:
    for b in row.get("below") or ():
        matrix.leaf[b["at"]], matrix.below_words[b["at"]], matrix.below_children[b["at"]] = b["leaves"], b["words"], b["children"]
    return matrix


def nodes(rows: DataFrame, empty: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of every node.

    ``rows``: ``(conv_id, place, x, y, words, size)`` with places from 0; ``empty``: ``conv_id`` of conversations without rows.
    """
    paths = _segments(rows, empty, width)
    classes = paths.groupBy("level", "px", "py", "ex", "ey").agg(
        F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("least"), F.sum("tail").alias("tail"), F.first("items").alias("items"),
        F.max((~F.col("ended")).cast("int")).alias("more"),
    )
    # a path that goes on may end for others: it has ends, too
    classes = classes.join(_ends(paths), ["ex", "ey"], "left").withColumn("ended", F.col("more") == 0).drop("more")
    shards = stored(_with_previous(_shards(stored(classes, "trie-classes"))), "trie-shards")
    if not paths.where("level > 0").isEmpty():
        shards = stored(_below(shards, width), "trie-shards")

    def edges(row: dict) -> Iterator[tuple]:
        matrix = _hung(_Matrix(row, width), row)
        for j in range(matrix.upto.shape[1]):
            found = matrix.nodes(j)
            if found is None:
                break
            values = lambda g: (int(found["least"][g]), *(int(found[c][g]) for c in SUMS))  # noqa: E731, B023
            end = len(found["rows"]) - 1
            if found["first"]:
                yield matrix.path("first", j), matrix.shard, "first", j, *values(0)
            if found["last"] and not (found["first"] and end == 0):
                yield matrix.path("last", j), matrix.shard, "last", j, *values(end)

    parts = stored(_mapped(shards, "path binary, shard int, side string, j int, least long, " + ", ".join(f"{c} long" for c in SUMS), edges), "trie-edges")
    whole = parts.groupBy("path").agg(F.min("least").alias("least"), *[F.sum(c).alias(c) for c in SUMS])
    told = parts.select("path", "shard", "side", "j").join(whole, "path").groupBy("shard").agg(
        F.collect_list(F.struct("side", "j", "least", *SUMS)).alias("edges")
    )

    def final(row: dict) -> Iterator[tuple]:
        matrix = _hung(_Matrix(row, width), row)
        known = {(e["side"], e["j"]): e for e in row["edges"] or ()}
        parent = np.zeros(len(matrix.width), np.int64)
        for j in range(matrix.upto.shape[1]):
            found = matrix.nodes(j)
            if found is None:
                break
            for g, e in ((0, known.get(("first", j))), (-1, known.get(("last", j)))):
                if e is not None:
                    for c in ("least", *SUMS):
                        found[c][g] = e[c]
            if j == 0:
                for head in row.get("heads") or ():
                    found["least"][found["groups"][head["at"]]] = head["least"]
            depth = matrix.level[found["rows"]] * width + j
            # a root of a level above is the last node of the level before it
            mine = found["own"] & ((j > 0) | (matrix.level[found["rows"]] == 0))
            for g in np.flatnonzero(mine).tolist():
                r = int(found["rows"][g])
                ends = matrix.ends[r] if matrix.width[r] == j else None
                yield (
                    int(found["least"][g]), int(depth[g]), int(parent[r]) if depth[g] else None, *(int(found[c][g]) for c in ("n", "children", "leaves", "saved")),
                    EMPTY if ends is None else ends,
                )
            parent[found["at"]] = found["least"][found["groups"]]

    ddl = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    return _mapped(shards.join(told, "shard", "left"), ddl, final)


#: The query's rows in SQL, for tables without two rows of one turn.
SQL = rf"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT h.conv_id, 0 AS src, pos, role, txt FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 WHERE pos <= h
      UNION ALL SELECT conv_id, 1, pos, role, txt FROM o JOIN h USING (conv_id) WHERE pos > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY src, pos) AS d, md5(length(role) || ':' || role || txt) AS m, CAST(len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM b),
k AS (SELECT conv_id, d, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, w FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM h),
n AS (SELECT d, path, min(conv_id) AS c, count(*) AS n, any_value(w) AS w FROM k GROUP BY d, path),
p AS (SELECT n.*, q.c AS parent, k.path AS up FROM n LEFT JOIN k ON k.conv_id = n.c AND k.d = n.d - 1 LEFT JOIN n q ON q.d = k.d AND q.path = k.path),
ch AS (SELECT d - 1 AS d, up AS path, count(*) AS children FROM p WHERE d > 0 GROUP BY ALL),
f AS (SELECT p.*, coalesce(children, 0) AS children FROM p LEFT JOIN ch USING (d, path)),
s AS (SELECT k.d, k.path, sum((f.n - 1) * f.w) AS saved, count(*) FILTER (f.children = 0) AS leaves FROM f JOIN k ON k.conv_id = f.c AND k.d <= f.d GROUP BY ALL),
z AS (SELECT conv_id, max(d) AS d, max_by(path, d) AS path FROM k GROUP BY conv_id),
e AS (SELECT d, path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM z GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM f JOIN s USING (d, path) LEFT JOIN e USING (d, path)
"""
