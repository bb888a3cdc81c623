"""Feature tables for the detectors, and joins that put group statistics on rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.scores import date_parts
from tallyscope.operators.ordered import scan
from tallyscope.operators.quantiles import exact_percentiles, join_stats
from tallyscope.operators.stats import BAND_CUTS, percentile_band, z_scores
from tallyscope.session import reliable

TRANSACTION_FEATURES = [
    "amount", "log_amount", "amount_zscore", "day_of_week", "hour", "month", "vendor_frequency",
    "amount_frequency", "running_balance", "deviation", "velocity", "band",
]


def account_map(df: DataFrame, account: str, amount: str) -> DataFrame:
    """Per-account count and mean on every row, by aggregate and join (a hot account stays split)."""
    stats = df.groupBy(account).agg(
        F.count(F.lit(1)).alias("account_transaction_count"), F.avg(F.col(amount).cast("double")).alias("account_avg_amount")
    )
    return df.join(stats, account)


def frequency(df: DataFrame, column: str, out: str = "vendor_frequency") -> DataFrame:
    """Share of the table's rows with the same value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    shares = counts.crossJoin(F.broadcast(total)).select(column, (F.col("_n") / F.col("_all")).alias(out))
    return df.join(shares, column)


def _similar(df: DataFrame, keys: Sequence[str], amount: str, share: float) -> tuple[DataFrame, DataFrame, Callable[[Column], Column], Column]:
    """``(keys, _a, similar)``, the counted amounts, ``_a`` of a decimal amount, and the amount of an ``_a``."""
    keys = list(keys)
    money = F.col(amount).cast("decimal(20,2)")
    counts = reliable(df.groupBy(*keys, money.alias("_a")).agg(F.count(F.lit(1)).alias("_c")))
    ratio = Decimal(str(share)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
    most = counts.agg(F.max(F.abs("_a"))).first()[0] or 0
    if most * (1 + abs(ratio)) < Decimal(1 << 62).scaleb(-6):
        # cents, and positions in millionths: the same numbers, sorted and joined at less cost than decimals
        placed, exact = (lambda a: (a * 100).cast("bigint")), (F.col("_a").cast("decimal(20,0)") / 100).cast("decimal(20,2)")
        low, own, high = (F.col("_a") * F.lit(int((1 + s * ratio) * 10_000)).cast("bigint") for s in (-1, 0, 1))
    else:
        placed, exact = (lambda a: a), F.col("_a")
        tol = (F.col("_a") * F.lit(share).cast("decimal(6,4)")).cast("decimal(26,6)")
        own = F.col("_a").cast("decimal(26,6)")
        low, high = (own - tol).cast("decimal(26,6)"), (own + tol).cast("decimal(26,6)")
    counts = counts.withColumn("_a", placed(F.col("_a")))
    # kind orders equal positions: lower probe, the amount itself, upper probe
    marks = F.array(
        F.struct(low.alias("x"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("add")),
        F.struct(own.alias("x"), F.lit(1).alias("kind"), F.col("_c").alias("add")),
        F.struct(high.alias("x"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("add")),
    )
    points = counts.select(*keys, "_a", F.explode(marks).alias("m")).select(*keys, "_a", "m.*")
    order = [F.col("x"), F.col("kind"), F.col("_a")]
    probes = scan(points, keys, order, sums={"_upto": "add"}).where(F.col("kind") != 1)
    both = probes.groupBy("_a", *keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("_upto"))).alias("_lo"), F.max(F.when(F.col("kind") == 2, F.col("_upto"))).alias("_hi")
    )
    matches = F.when(F.col("_a") < 0, F.lit(0).cast("bigint")).otherwise(F.col("_hi") - F.col("_lo"))
    return both.select(*keys, "_a", matches.alias("similar")), counts, placed, exact


def similar_amounts(df: DataFrame, keys: Sequence[str], amount: str, share: float = 0.01) -> DataFrame:
    """Rows of the group whose amount is within +-1 % of each distinct amount.

    No pair is formed. Every distinct amount gives a point and two probes, at its lower and
    upper bound; one ordered running count answers all probes. Tolerances are decimals, so
    bounds are exact. A negative amount has a negative tolerance and matches nothing.
    """
    near, _, _, exact = _similar(df, keys, amount, share)
    return near.select(*keys, exact.alias("amount"), "similar")


def amount_frequency(df: DataFrame, keys: Sequence[str], amount: str, out: str = "amount_frequency") -> DataFrame:
    """Share of the group's rows with a similar amount, on every row."""
    keys = list(keys)
    near, counts, placed, _ = _similar(df, keys, amount, 0.01)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    rows = join_stats(df.withColumn("_a", placed(F.col(amount).cast("decimal(20,2)"))), totals, keys)
    # the amount first, by which rows sort without reading further keys
    shown = [*keys, *[c for c in df.columns if c not in keys]]
    return rows.join(near, ["_a", *keys]).withColumn(out, F.col("similar") / F.col("_n")).select(*shown, out)


def running_balance(df: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: str) -> DataFrame:
    """Running decimal balance in order, per account or over the whole table."""
    rows = df.withColumn("_money", F.col(amount).cast("decimal(20,2)"))
    return scan(rows, keys, order, sums={"running_balance": "_money"}).drop("_money")


def gap_seconds(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[Column], out: str = "time_since_last") -> DataFrame:
    """Seconds since the previous row in time order; null on the first."""
    rows = df.withColumn("_us", F.unix_micros(ts))
    done = scan(rows, keys, order, previous={"_before": "_us"})
    return done.withColumn(out, (F.col("_us") - F.col("_before")) / F.lit(1e6)).drop("_us", "_before")


def codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): the values in sorted order from 0.

    Distinct values are ranked by the range-cut scan, so a column may have any cardinality.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return scan(values, [], [F.col(column)], number="_i").select(column, (F.col("_i") - 1).cast("int").alias("_code"))


def with_codes(df: DataFrame, code_table: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Code column from a code table; null and unseen values get -1."""
    out = out or f"{column}_code"
    return df.join(code_table, column, "left").withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_code")


def category_codes(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Code of each value in sorted order; null gets -1."""
    return with_codes(df, codes(df, column), column, out)


def vendor_rates(df: DataFrame, vendor: str, ts: str) -> DataFrame:
    """(vendor, rows, rows per active day) from one combined pass over (vendor, day)."""
    days = df.groupBy(vendor, F.to_date(ts).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return days.groupBy(vendor).agg(
        F.sum("_n").alias("vendor_count"), (F.sum("_n") / F.count(F.lit(1))).alias("velocity")
    )


def transaction_features(df: DataFrame, id: str, vendor: str, amount: str, ts: str, reference: bool = False) -> DataFrame:
    """The twelve transaction features, not yet scaled, keyed by ``id``.

    Every statistic is taken from the four input columns and joined once. ``reference``
    gives the published constant 1 as velocity.
    """
    x = F.col(amount).cast("double")
    base = df.select(F.col(id).alias("id"), F.col(vendor).alias("vendor"), x.alias("amount"), F.col(ts).alias("ts"))
    money = F.col("amount").cast("decimal(20,2)")
    near = similar_amounts(base, [], "amount").withColumnRenamed("amount", "_a")
    scalars = base.agg(
        F.avg("amount").alias("_mean"), F.stddev_samp("amount").alias("_std"), F.count(F.lit(1)).alias("_n")
    ).crossJoin(F.broadcast(exact_percentiles(base, [], "amount", BAND_CUTS).drop("n")))
    # the running balance is the costly order; its output carries the rows on
    rows = running_balance(base, [], [F.col("id")], "amount")
    rows = rows.join(vendor_rates(base, "vendor", "ts"), "vendor").withColumn("_a", money).join(near, "_a")
    rows = rows.crossJoin(F.broadcast(scalars))
    parts = date_parts(F.col("ts"))
    value = {
        "amount": F.col("amount"),
        "log_amount": F.log1p(F.abs("amount")),
        "amount_zscore": F.when(F.col("_std") > 0, (F.col("amount") - F.col("_mean")) / F.col("_std")).otherwise(0.0),
        "day_of_week": parts["day_of_week"],
        "hour": parts["hour"],
        "month": parts["month"],
        "vendor_frequency": F.col("vendor_count") / F.col("_n"),
        "amount_frequency": F.col("similar") / F.col("_n"),
        "running_balance": F.col("running_balance"),
        "deviation": F.coalesce(F.try_divide(F.abs(F.col("amount") - F.col("_mean")), F.col("_mean")), F.lit(0.0)),
        "velocity": F.lit(1.0) if reference else F.col("velocity"),
        "band": percentile_band(F.col("amount")),
    }
    return rows.select("id", *[value[c].cast("double").alias(c) for c in TRANSACTION_FEATURES])


def model_features(df: DataFrame, id: str, account: str, amount: str, ts: str, categories: Sequence[str]) -> DataFrame:
    """Log, square, date parts, account count and mean, global gap, category codes; nulls become 0."""
    base = df.select(
        F.col(id).alias("id"), F.col(account).alias("account"), F.col(amount).cast("double").alias("amount"), F.col(ts).alias("ts"), *categories
    )
    stats = base.groupBy("account").agg(
        F.count(F.lit(1)).alias("account_transaction_count"), F.avg("amount").alias("account_avg_amount")
    )
    rows = gap_seconds(base, [], "ts", [F.col("ts"), F.col("id")]).join(stats, "account")
    rows = rows.withColumn("log_amount", F.log1p("amount")).withColumn("amount_squared", F.col("amount") * F.col("amount"))
    for name, part in date_parts(F.col("ts")).items():
        rows = rows.withColumn(name, part)
    names = ["amount", "log_amount", "amount_squared", "hour", "day_of_week", "month", "is_weekend", "is_business_hours",
             "account_transaction_count", "account_avg_amount", "time_since_last"]
    for c in categories:
        rows = with_codes(rows, codes(base, c), c)
        names.append(f"{c}_code")
    return rows.select("id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def fraud_features(df: DataFrame, id: str, amount: str, ts: str, categories: Sequence[str]) -> DataFrame:
    """Log, z-score, hour, weekday, weekend flag, category codes."""
    base = df.select(F.col(id).alias("id"), F.col(amount).cast("double").alias("amount"), F.col(ts).alias("ts"), *categories)
    rows = z_scores(base, [], "amount", out="amount_zscore").withColumn("log_amount", F.log1p("amount"))
    parts = date_parts(F.col("ts"))
    names = ["amount", "log_amount", "amount_zscore", "hour", "day_of_week", "is_weekend"]
    for name in names[3:]:
        rows = rows.withColumn(name, parts[name])
    for c in categories:
        rows = with_codes(rows, codes(base, c), c)
        names.append(f"{c}_code")
    return rows.select("id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def ordered_split(df: DataFrame, label: str, order: Sequence[Column], train: float = 0.8) -> DataFrame:
    """Rows with a label, marked ``train`` or ``test`` by position in order (no shuffle of meaning)."""
    rows = scan(df.where(F.col(label).isNotNull()), [], order, number="_i", total="_n")
    cut = F.floor(F.col("_n") * train)
    return rows.withColumn("part", F.when(F.col("_i") <= cut, "train").otherwise("test")).drop("_i", "_n")


def hashed_sample(df: DataFrame, key: str, k: int = 1000, fifth: bool = True, seed: int = 42) -> DataFrame:
    """min(k, n / 5) rows by smallest seeded key digest: the same rows on every run.

    The k smallest are taken first; the n / 5 bound then trims that short list.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))))
    few = hashed.orderBy("_h", key).limit(k)
    if not fifth:
        return few.drop("_h")
    n = df.agg(F.floor(F.count(F.lit(1)) / 5).alias("_bound"))
    w = Window.partitionBy(F.lit(0)).orderBy("_h", key)  # k rows at most
    ranked = few.withColumn("_i", F.row_number().over(w)).crossJoin(F.broadcast(n))
    return ranked.where(F.col("_i") <= F.col("_bound")).drop("_h", "_i", "_bound")


def explain(features: DataFrame, training: DataFrame, id: str, columns: Sequence[str], bound: float = 2.0) -> DataFrame:
    """Features of each row with |z| above ``bound`` against the training statistics."""
    stats = training.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    rows = features.crossJoin(F.broadcast(stats))
    items = F.array(
        *[
            F.when(
                F.col(f"_s_{c}") > 0,
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col(c).alias("value"),
                    F.col(f"_m_{c}").alias("mean"),
                    (F.abs(F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias("z_score"),
                ),
            )
            for c in columns
        ]
    )
    far = F.filter(items, lambda s: s.isNotNull() & (s["z_score"] > bound))
    return rows.select(id, F.explode(far).alias("f")).select(id, "f.*")


def importance(scored: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    """|mean(flagged) - mean(rest)| / std per feature, normalised to sum 1."""
    f = F.col(flag) == 1
    row = scored.agg(
        *[
            F.coalesce(
                F.try_divide(
                    F.abs(F.avg(F.when(f, F.col(c).cast("double"))) - F.avg(F.when(~f, F.col(c).cast("double")))),
                    F.stddev_pop(F.col(c).cast("double")),
                ),
                F.lit(0.0),
            ).alias(c)
            for c in columns
        ]
    )
    long = row.unpivot([], list(columns), "feature", "raw")
    total = row.select(sum((F.col(c) for c in columns), F.lit(0.0)).alias("_t"))
    return long.crossJoin(F.broadcast(total)).select(
        "feature", F.coalesce(F.try_divide("raw", "_t"), F.lit(0.0)).alias("importance")
    )


def risk_drivers(importances: DataFrame, bound: float = 0.1) -> DataFrame:
    """Features of at least ``bound`` importance, largest first."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")  # one row per feature
    return importances.where(F.col("importance") >= bound).withColumn("rank", F.row_number().over(w).cast("bigint"))
