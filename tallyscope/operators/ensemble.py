"""Detector registry and ensembles, PCA, and the named analysis bundle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import digit_law, forest, neighbours, outliers, stats
from tallyscope.operators.quantiles import exact_percentiles
from tallyscope.session import reliable

Detector = Callable[[DataFrame, str, Sequence[str]], DataFrame]


def _forest(df: DataFrame, id: str, features: Sequence[str]) -> DataFrame:
    return forest.score(df, forest.fit(df, id, features), features, out="iforest_score")


DETECTORS: dict[str, tuple[Detector, str]] = {
    "iforest": (_forest, "iforest_score"),
    "lof": (neighbours.lof_score, "lof_score"),
    "ocsvm": (lambda df, id, f: neighbours.one_class_score(df, f), "svm_score"),
    "knn": (neighbours.knn_score, "knn_score"),
}


def detect(df: DataFrame, id: str, features: Sequence[str], methods: Sequence[str] = ("iforest", "lof", "ocsvm", "knn")) -> DataFrame:
    """Scores of the named detectors on standardised features, then the ensemble.

    Features keep nine decimals, so that points equally far from another stay so however means were
    summed. The two neighbour detectors share one graph when both are asked for.
    """
    rows = stats.scaled(df.select(id, *features), features, "standard")
    rows = reliable(rows.select(id, *[F.round(c, 9).alias(c) for c in features]))
    graph = neighbours.knn_graph(rows, id, features, 20) if {"lof", "knn"} <= set(methods) else None
    columns = []
    for name in methods:
        run, column = DETECTORS[name]
        if graph and name == "lof":
            rows = neighbours.lof_of(rows, features, graph, column)
        elif graph and name == "knn":
            rows = neighbours.knn_of(rows, features, graph, 5, column)
        else:
            rows = run(rows, id, features)
        columns.append(column)
    return ensemble(reliable(rows), columns)


def combine(df: DataFrame, scores: Sequence[str], method: str = "average", vote_at: float = 0.7, out: str = "ensemble_score") -> DataFrame:
    """Min-max every score over the table, then average, maximum or share of votes."""
    aggs = []
    for c in scores:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    rows = df.crossJoin(F.broadcast(df.agg(*aggs)))

    def unit(c):
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return F.when(width > 0, (F.col(c) - F.col(f"_lo_{c}")) / width).otherwise(0.0)

    units = [unit(c) for c in scores]
    if method == "average":
        value = sum(units, F.lit(0.0)) / len(units)
    elif method == "max":
        value = F.greatest(*units) if len(units) > 1 else units[0]
    elif method == "voting":
        value = sum(((u > vote_at).cast("int") for u in units), F.lit(0)) / len(units)
    else:
        raise ValueError(f"unknown ensemble method {method}")
    return rows.withColumn(out, value).select(*df.columns, out)


def ensemble(df: DataFrame, scores: Sequence[str], percentile: float = 0.9, contamination: float = 0.1) -> DataFrame:
    """Mean of min-max scores, flag above the 90th percentile, share of detectors that agree."""
    rows = combine(df, scores)
    cuts = None
    for c, p in [("ensemble_score", percentile), *[(s, 1 - contamination) for s in scores]]:
        one = exact_percentiles(rows, [], c, {f"_cut_{c}": p}).drop("n")
        cuts = one if cuts is None else cuts.crossJoin(F.broadcast(one))
    out = rows.crossJoin(F.broadcast(cuts))
    votes = sum(((F.col(s) > F.col(f"_cut_{s}")).cast("int") for s in scores), F.lit(0)) / len(scores)
    return (
        out.withColumn("is_anomaly", (F.col("ensemble_score") > F.col("_cut_ensemble_score")).cast("int"))
        .withColumn("agreement", votes)
        .select(*df.columns, "ensemble_score", "is_anomaly", "agreement")
    )


def principal_components(df: DataFrame, id: str, features: Sequence[str], k: int | None = None) -> DataFrame:
    """min(10, d) principal components of the centred features as columns pc1..pck."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    k = k or min(10, len(features))
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in features])
    centred = df.crossJoin(F.broadcast(means)).select(
        id, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_m_{c}")).alias(c) for c in features]
    )
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(centred)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vectors)
    arr = vector_to_array("_pc")
    return model.transform(vectors).select(id, *[arr[i].alias(f"pc{i + 1}") for i in range(k)])


def _long(df: DataFrame, keys: Sequence[str], analysis: str) -> DataFrame:
    names = [c for c, t in df.dtypes if c not in keys and (t in ("double", "bigint", "int", "boolean") or t.startswith("decimal"))]
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(list(keys), names, "metric", "value").withColumn("analysis", F.lit(analysis))


BUNDLE: dict[str, Callable[[DataFrame, Sequence[str], str], DataFrame]] = {
    "benford": lambda df, keys, value: digit_law.significant_test(df, keys, value, levels=3),
    "descriptive": stats.describe,
    "outliers": lambda df, keys, value: outliers.outlier_summary(outliers.iqr_flags(df, keys, value), keys, "lower_bound", "upper_bound"),
    "distribution": lambda df, keys, value: stats.jarque_bera(df, keys, value),
}


def analyze(df: DataFrame, keys: Sequence[str], value: str, kind: str = "comprehensive") -> DataFrame:
    """Named analysis, or all of them, as (keys, metric, value, analysis) rows.

    The input is cut to the needed columns and written once, then read by every part.
    """
    names = list(BUNDLE) if kind == "comprehensive" else [kind]
    rows = df.select(*keys, value)
    rows = reliable(rows) if len(names) > 1 else rows
    out = None
    for name in names:
        part = _long(BUNDLE[name](rows, list(keys), value), list(keys), name)
        out = part if out is None else out.unionByName(part)
    return out
