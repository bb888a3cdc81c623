"""Ordered computations (rank, running sum and max, previous row) without one-task groups.

``Window.partitionBy(group).orderBy(...)`` puts a whole group into one task. Here a large
group is cut into buckets by its order key. The cuts come from counts: a histogram of the
group's key says which stretches hold about ``target`` rows, so a row's bucket is an expression
of its own values, and every reader of the plan finds the same one. Rows are shuffled once, by
(group, bucket), and each bucket works alone. What the earlier buckets of a group add (rows,
sums, maxima, last values) is known from the histogram and comes as a broadcast table with a row
for each bucket; there are a few buckets for each shuffle partition.

A stretch that stays heavy because values crowd there is cut again in finer steps; one that holds
a single value is cut by the next order key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.session import reliable

#: A group of no more rows is one bucket.
LEAST_ROWS = 1 << 14
#: Steps of the histogram for each bucket that is wanted.
STEPS = 32
_LEVEL_BITS = 20
_LEVELS = 3
_FAR = 1e12


@dataclass(frozen=True)
class Down:
    """A descending order key."""

    column: Column


def down(column: Column) -> Down:
    return Down(column)


def _sorted(key: Column | Down) -> Column:
    return key.column.desc() if isinstance(key, Down) else key.asc()


class _Key:
    """An order key as a number that never falls along it, and what must be known of a cell to cut it there."""

    def __init__(self, df: DataFrame, key: Column | Down) -> None:
        self.raw, self.falling = (key.column, True) if isinstance(key, Down) else (key, False)
        self.kind = df.select(self.raw.alias("k")).schema["k"].dataType
        self.text = isinstance(self.kind, T.StringType)

    def _number(self, column: Column, skip: Column | None = None) -> Column:
        if self.text:
            # the first bytes behind what all have in common; strings sort by bytes
            rest = F.encode(F.substring(column, skip + 1, F.lit(6)), "UTF-8")
            value = F.conv(F.rpad(F.hex(F.substring(rest, 1, 6)), 12, "0"), 16, 10).cast("double")
        elif isinstance(self.kind, T.TimestampType):
            value = F.unix_micros(column).cast("double")
        elif isinstance(self.kind, T.DateType):
            value = F.unix_date(column).cast("double")
        elif isinstance(self.kind, T.BooleanType):
            value = column.cast("int").cast("double")
        elif isinstance(self.kind, T.NumericType):
            value = column.cast("double")
        else:
            value = F.lit(0.0)
        return -value if self.falling else value

    def extremes(self) -> list[Column]:
        """Aggregates of a cell: the key's range as numbers, and whether it is known that all rows have one value."""
        x = self._number(self.raw, F.lit(0))
        tied = (F.count(self.raw) == 0) | ((F.count(self.raw) == F.count(F.lit(1))) & F.min(self.raw).eqNullSafe(F.max(self.raw)))
        x = F.when(F.abs(x) < float("inf"), x)
        known = F.lit(False) if self.text or not isinstance(self.kind, T.AtomicType) else tied
        return [F.min(x).alias("_low"), F.max(x).alias("_high"), known.alias("_tied"), F.lit(0).alias("_skip")]

    def closer(self) -> list[Column]:
        """The same of a text key, behind what all texts have in common; dearer, as texts are compared."""
        least, most = F.min(self.raw), F.max(self.raw)
        tied = (F.count(self.raw) == 0) | ((F.count(self.raw) == F.count(F.lit(1))) & (least == most))
        return [least.alias("_least"), most.alias("_most"), tied.alias("_tied")]

    def numbered(self, cells: DataFrame) -> DataFrame:
        """What ``closer`` found, as numbers."""
        least, most = F.col("_least"), F.col("_most")
        alike = F.filter(F.sequence(F.lit(0), F.least(F.length(least), F.length(most))), lambda i: F.left(least, i) == F.left(most, i))
        cells = cells.withColumn("_skip", F.coalesce(F.size(alike) - 1, F.lit(0)))
        low, high = self._number(least, F.col("_skip")), self._number(most, F.col("_skip"))
        low, high = (high, low) if self.falling else (low, high)
        return cells.withColumn("_low", low).withColumn("_high", high).drop("_least", "_most")

    def number(self, skip: Column) -> Column:
        return self._number(self.raw, skip)


def _with_step(rows: DataFrame) -> DataFrame:
    """``_step`` of ``_x`` from 1 to ``_steps`` between ``_low`` and ``_high``; 0 and one more for nulls, NaN and the infinite.

    The mean of equal steps, steps of equal ratio from either end, and steps of equal ratio from
    zero, so that values that crowd anywhere still spread. Every part rises with the value, so the mean does.
    """
    x, low, high, u = (F.col(c) for c in ("_x", "_low", "_high", "_u"))
    folds = lambda v: F.signum(v) * F.log1p(F.abs(v))
    # columns of their own, so that nothing is computed twice
    rows = rows.withColumn("_u", F.when(F.abs(x) < float("inf"), (x - low) / (high - low)))
    rows = rows.withColumn("_f", folds(low)).withColumn("_g", folds(high) - F.col("_f"))
    near = (F.log1p(u * _FAR) - F.log1p((1 - u) * _FAR)) / F.log1p(F.lit(_FAR))
    from_zero = F.when(F.col("_g") > 0, (folds(x) - F.col("_f")) / F.col("_g")).otherwise(0.0)
    rows = rows.withColumn("_share", (u + near + 1 + from_zero) / 4)
    inside = F.least(F.greatest(F.floor(F.col("_share") * F.col("_steps")), F.lit(0)), F.col("_steps") - 1) + 1
    first, last = F.lit(0).cast("bigint"), F.col("_steps") + 1
    outside = F.when(x.isNull(), F.when(F.col("_falling"), last).otherwise(first)).when(F.isnan(x), F.when(F.col("_falling"), first).otherwise(last))
    step = F.when(F.col("_share").isNotNull(), inside).otherwise(outside.when(x < 0, first).otherwise(last))
    return rows.withColumn("_step", F.when(F.col("_steps").isNotNull(), step)).drop("_u", "_f", "_g", "_share", "_x", "_falling", "_low", "_high", "_steps")


def _same(pairs: Sequence[tuple[str, str]]) -> Column:
    on = F.lit(True)
    for a, b in pairs:
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _joined(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a table of bounded size on null-safe keys; its other columns are added."""
    named = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    return rows.join(F.broadcast(named), _same([(k, f"_k_{k}") for k in keys]), "left").drop(*[f"_k_{k}" for k in keys])


class Buckets:
    """A table with ``_bucket`` on its rows, and what is known of the buckets of groups that have several."""

    def __init__(
        self, df: DataFrame, group: Sequence[str], order: Sequence[Column | Down], carried: Sequence[Column] = (), merged: Sequence[Column] = (),
    ) -> None:
        """``carried`` aggregates are taken of each histogram step, ``merged`` puts those of several steps together."""
        self.group, self.carried, self.merged = list(group), list(carried), list(merged)
        self.keys = [_Key(df, k) for k in order]
        self.table = None
        self.rows = df.withColumn("_bucket", F.lit(0).cast("bigint"))
        stats = reliable(self._stats(self.rows, self.keys[0].extremes()))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows_in_all = stats.agg(F.sum("_n")).first()[0] or 0
        self.target = max(self.rows_in_all // (2 * parts), LEAST_ROWS)
        cells = self._ready(stats.where(F.col("_n") > self.target))
        done: list[DataFrame] = []
        while cells is not None:
            table, heavy = self._cut(cells, len(done))
            done.append(table)
            if len(done) == _LEVELS or heavy.isEmpty():
                break
            cells = self._ready(reliable(self._stats(self._matching(self.rows, heavy, "left_semi"), self.keys[0].extremes())))
        if not done:
            return
        # a cell that was cut again is known by its parts
        table = done[0]
        for finer in done[1:]:
            cut_again = finer.select(*self.group, F.col("_cell").alias("_bucket")).distinct()
            table = self._matching(table, cut_again, "left_anti").unionByName(finer)
        self.table = table.drop("_cell")

    def _stats(self, rows: DataFrame, aggregates: list[Column]) -> DataFrame:
        return rows.groupBy(*self.group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *aggregates)

    def _ready(self, cells: DataFrame) -> DataFrame | None:
        """``(group, _bucket, _n, _key, _low, _high, _skip)`` of the cells that can be cut: by the first key in which rows differ."""
        found = None
        columns = [*self.group, "_bucket", "_n", "_key", "_low", "_high", "_skip"]
        for i, k in enumerate(self.keys):
            if i:
                cells = reliable(self._stats(self._matching(self.rows, cells, "left_semi"), k.extremes()))
            ready = cells.where(F.col("_high") > F.col("_low"))
            rest = cells.where(~F.coalesce(F.col("_high") > F.col("_low"), F.lit(False)))
            if rest.isEmpty():
                rest = None
            elif k.text:
                rest = k.numbered(reliable(self._stats(self._matching(self.rows, rest, "left_semi"), k.closer())))
                ready = ready.select(*rest.columns).unionByName(rest.where(F.col("_high") > F.col("_low")))
            ready = ready.withColumn("_key", F.lit(i)).select(*columns)
            found = ready if found is None else found.unionByName(ready)
            # the next key orders only what is equal in this one
            cells = rest.where("_tied") if rest is not None else None
            if cells is None or cells.isEmpty():
                break
        return None if found is None or found.isEmpty() else found

    def _matching(self, rows: DataFrame, cells: DataFrame, how: str) -> DataFrame:
        keys = [*self.group, "_bucket"]
        named = cells.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        return rows.join(F.broadcast(named), _same([(k, f"_k_{k}") for k in keys]), how)

    def _cut(self, cells: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Cut the rows of the cells; the new buckets, and those that are still heavy."""
        keys = [*self.group, "_bucket"]
        steps = F.least(F.greatest(F.ceil(F.col("_n") / self.target) * STEPS, F.lit(64)), F.lit((1 << _LEVEL_BITS) - 2)).cast("bigint")
        rows = _joined(self.rows, cells.withColumn("_steps", steps).drop("_n"), keys)
        x, falling = F.lit(None).cast("double"), F.lit(False)
        for i in [r["_key"] for r in cells.select("_key").distinct().collect()]:
            here = F.col("_key") == i
            x, falling = F.when(here, self.keys[i].number(F.col("_skip"))).otherwise(x), F.when(here, F.lit(self.keys[i].falling)).otherwise(falling)
        # a filter on what follows would be pushed below it, and repeat all of it
        inside = rows.where(F.col("_steps").isNotNull())
        inside, rows = (_with_step(r.withColumn("_x", x).withColumn("_falling", falling)).drop("_key", "_skip") for r in (inside, rows))
        counted = inside.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"), *self.carried)
        line = Window.partitionBy(*keys).orderBy("_step")
        upto = F.sum("_n").over(line)
        counted = counted.withColumn("_heavy", F.col("_n") > 2 * self.target).withColumn("_turn", F.floor((upto - 1) / self.target))
        begins = F.col("_heavy") | F.lag("_heavy", 1, True).over(line) | (F.col("_turn") != F.lag("_turn").over(line))
        counted = counted.withColumn("_part", F.sum(begins.cast("bigint")).over(line))
        size = 1 << (_LEVEL_BITS * (_LEVELS - 1 - level))
        named = reliable(counted.withColumn("_new", F.col("_bucket") + F.col("_part") * size))
        rows = _joined(rows, named.select(*keys, "_step", "_new"), [*keys, "_step"])
        self.rows = rows.withColumn("_bucket", F.coalesce("_new", "_bucket")).drop("_step", "_new")
        table = named.groupBy(*self.group, F.col("_bucket").alias("_cell"), F.col("_new").alias("_bucket")).agg(
            F.sum("_n").alias("_n"), *self.merged, F.max("_heavy").alias("_heavy")
        )
        return table.drop("_heavy"), table.where("_heavy").select(*self.group, "_bucket")


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | Down],
    *,
    number: str | None = None,
    total: str | None = None,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Add ordered columns per group; ``order`` must be total within a group. ``down(column)`` orders falling.

    number    row number from 1
    total     rows of the group
    sums      {new column: column} running sum up to the row
    maxes     {new column: column} running maximum up to the row
    previous  {new column: column} value of the row before; all keys must rise
    """
    group, sums, maxes, previous = list(group), sums or {}, maxes or {}, previous or {}
    if previous and any(isinstance(k, Down) for k in order):
        raise ValueError("the previous value needs rising order keys")
    latest = F.struct(*[k.alias(f"o{i}") for i, k in enumerate(order)]) if previous else None
    carried = [
        *[F.sum(col).alias(f"_s_{new}") for new, col in sums.items()], *[F.max(col).alias(f"_m_{new}") for new, col in maxes.items()],
        *[F.max_by(F.struct(F.col(col).alias("v")), latest).alias(f"_p_{new}") for new, col in previous.items()],
    ]
    merged = [
        *[F.sum(f"_s_{new}").alias(f"_s_{new}") for new in sums], *[F.max(f"_m_{new}").alias(f"_m_{new}") for new in maxes],
        *[F.max_by(f"_p_{new}", "_step").alias(f"_p_{new}") for new in previous],
    ]
    buckets = Buckets(df, group, order, carried, merged)
    keys = [*group, "_bucket"]
    local = Window.partitionBy(*keys).orderBy(*[_sorted(k) for k in order])
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = buckets.rows
    if number or previous:
        rows = rows.withColumn("_rn", F.row_number().over(local).cast("bigint"))
    for new, col in sums.items():
        rows = rows.withColumn(new, F.sum(col).over(upto))
    for new, col in maxes.items():
        rows = rows.withColumn(new, F.max(col).over(upto))
    for new, col in previous.items():
        rows = rows.withColumn(new, F.lag(col).over(local))
    if total:
        rows = rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    out = rows
    if buckets.table is not None:
        in_order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_bucket")
        before = in_order.rowsBetween(Window.unboundedPreceding, -1)
        offsets = buckets.table.select(
            *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
            F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
            *[F.sum(f"_s_{new}").over(before).alias(f"_s_{new}") for new in sums],
            *[F.max(f"_m_{new}").over(before).alias(f"_m_{new}") for new in maxes],
            *[F.lag(f"_p_{new}").over(in_order).alias(f"_p_{new}") for new in previous],
        )
        out = _joined(rows, offsets, keys)
        for new in sums:
            earlier = F.col(f"_s_{new}")
            out = out.withColumn(new, F.when(earlier.isNull(), F.col(new)).otherwise(F.coalesce(F.col(new), earlier * 0) + earlier))
        for new in maxes:
            out = out.withColumn(new, F.greatest(F.col(new), F.col(f"_m_{new}")))
        for new in previous:
            first_later = (F.col("_rn") == 1) & F.col(f"_p_{new}").isNotNull()
            out = out.withColumn(new, F.when(first_later, F.col(f"_p_{new}")["v"]).otherwise(F.col(new)))
    has = buckets.table is not None
    if number:
        out = out.withColumn(number, F.col("_rn") + F.coalesce("_off", F.lit(0)) if has else F.col("_rn"))
    if total:
        out = out.withColumn(total, F.coalesce("_total", "_size") if has else F.col("_size"))
    extra = [c for c in (number, total) if c]
    return out.select(*df.columns, *sums, *maxes, *previous, *extra)


def ranked_between(df: DataFrame, order: Sequence[Column | Down], first: int, last: int, number: str = "row", total: str = "total") -> DataFrame:
    """The rows numbered ``first + 1`` to ``last`` in order, with number and total.

    The histogram tells which buckets hold these ranks; only their rows are shuffled and sorted.
    """
    buckets = Buckets(df, [], order)
    rows, every = buckets.rows, F.lit(buckets.rows_in_all).cast("bigint")
    offset = F.lit(0).cast("bigint")
    if buckets.table is not None:
        before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        table = buckets.table.select("_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
        wanted = reliable(table.where((F.col("_off") < last) & (F.col("_off") + F.col("_n") > first)).select("_bucket", "_off"))
        rows, offset = rows.join(F.broadcast(wanted), "_bucket"), F.col("_off")
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[_sorted(k) for k in order])) + offset
    out = rows.withColumn(number, at.cast("bigint")).where((F.col(number) > first) & (F.col(number) <= last))
    return out.withColumn(total, every).select(*df.columns, number, total)


def ntile(number: Column, total: Column, tiles: int) -> Column:
    """NTILE from a row number and the group size: earlier tiles take the remainder."""
    base, extra = F.floor(total / tiles), total % tiles
    head = extra * (base + 1)
    return (
        F.when(number <= head, F.floor((number - 1) / (base + 1)) + 1)
        .otherwise(extra + F.floor((number - 1 - head) / F.greatest(base, F.lit(1))) + 1)
        .cast("bigint")
    )


def trailing_count(df: DataFrame, keys: Sequence[str], micros: str, seconds: int, out: str = "recent") -> DataFrame:
    """Rows of the same key in the last ``seconds`` up to each row (the row included).

    Time is cut into chunks of twelve windows. A row within one window of the next
    chunk's start is copied there as context, so a busy key spreads over its chunks.
    """
    span = seconds * 1_000_000
    chunk = span * 12
    own = F.floor(F.col(micros) / chunk)
    reach = F.floor((F.col(micros) + span) / chunk)
    copies = df.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.array_distinct(F.array(F.col("_own"), reach)))
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(micros).rangeBetween(-(span - 1), 0)
    return (
        copies.withColumn(out, F.count(F.lit(1)).over(w))
        .where(F.col("_own") == F.col("_chunk"))
        .drop("_own", "_chunk")
    )


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark keeps only ``n`` rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= n)
