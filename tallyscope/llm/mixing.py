"""Mixing sources to target weights with DataFrame expressions only.

Sizes are summed per source, targets follow from the weights by water filling, and
target / source size is the rate at which each of its documents is repeated: floor(rate)
copies, and one more with probability equal to the fraction, decided by a hash of seed and
document id. Reruns and other layouts give the same mix.

Edge cases: a null source is a source of its own, ranked last. A null text has size 0. A
source without words has target 0 and rate 0. Repeated rows have the same id and so the
same number of copies. Null ids share one hash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.storage import free_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
MOST = 2.0
SHARE = 1.5


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size)`` with the source's ``weight``, ``target`` and ``rate``.

    Weights go to the sources by code point, null last, and repeat. The sources share
    ``share`` of all sizes; a target stops at ``most`` times its source's size and the excess
    goes to the others by weight. Sources stop in the order of size / weight, so one pass over
    them in that order finds which ones do. The windows hold one row per source, no documents.
    """
    # UTF-8 bytes, and so Spark's strings, sort by code point
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long"))
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        rows.withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_done", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(after))
    )
    # share of one unit of weight if all sources before this one have stopped
    unit = (F.col("_all") * share - F.col("_done") * most) / F.col("_open")
    stops = F.col("source_size") * most <= unit * F.col("weight")
    rows = rows.withColumn("_unit", unit).withColumn("_stops", stops)
    level = F.min(F.when(~F.col("_stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "_unit"))).over(every)
    rows = rows.withColumn("_level", level["_unit"])
    target = F.when(F.col("_stops") | F.col("_level").isNull(), F.col("source_size") * most).otherwise(
        F.least(F.col("_level") * F.col("weight"), F.col("source_size") * most)
    )
    rows = rows.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) from an MD5 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def mix_rates(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix",
              **options) -> DataFrame:
    """``docs`` with struct ``mix``: size, source_size, target, copies.

    One pass counts words and sums them on the map side, so a source of any size meets as a
    few partial sums. The join back is on the source alone; the table of sources has one row
    each and Spark broadcasts it or splits the hot side, whatever its size allows.
    """
    name, size = free_name(docs.columns, "mix"), word_count(F.col(text))
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    found = targets(sizes, **options)
    names = [free_name(docs.columns, f"_m_{x}") for x in ("source", "source_size", "target", "rate")]
    found = found.select(*[F.col(a).alias(b) for a, b in zip(("source", "source_size", "target", "rate"), names)])
    src, source_size, target, rate = (F.col(x) for x in names)
    counted = free_name(docs.columns, "_m_size")  # before the join, so that a text nobody asks for stays out of it
    rows = docs.withColumn(counted, size).join(found, F.col(source).eqNullSafe(src))
    whole = F.floor(rate)
    copies = whole + F.when(chance(F.col(key), seed) < rate - whole, 1).otherwise(0)
    mix = F.struct(F.col(counted).alias("size"), source_size.alias("source_size"), target.alias("target"), copies.cast("long").alias("copies"))
    return rows.withColumn(name, mix).select(*docs.columns, name)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its source's rate says, columns as given."""
    name = free_name(docs.columns, "mix")
    rows = mix_rates(docs, **options).where(F.col(name)["copies"] > 0)
    copy = free_name(docs.columns, "_copy")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int")))).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
      FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, encode(source))),
u AS (SELECT *, (CAST(total AS DOUBLE) * 1.5 - CAST(done AS DOUBLE) * 2.0) / CAST(open AS DOUBLE) AS unit FROM r),
l AS (SELECT *, source_size * 2.0::DOUBLE <= unit * weight AS stops FROM u),
t AS (SELECT *, (SELECT unit FROM l WHERE NOT stops ORDER BY source_size / weight, source IS NULL, encode(source) LIMIT 1) AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN stops OR level IS NULL THEN source_size * 2.0::DOUBLE ELSE least(level * weight, source_size * 2.0::DOUBLE) END AS target FROM t),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source
"""
