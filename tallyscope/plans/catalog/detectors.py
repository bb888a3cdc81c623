"""Features, detectors, models, file round trips and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope import config
from tallyscope.constants import CONTAMINATION
from tallyscope.operators import digit_law as dl
from tallyscope.operators import ensemble as en
from tallyscope.operators import features as fe
from tallyscope.operators import forest as fo
from tallyscope.operators import neighbours as ne
from tallyscope.operators import presets as pr
from tallyscope.operators import stats
from tallyscope.operators import word_law as wl
from tallyscope.operators.quantiles import exact_percentiles
from tallyscope.plans import views as v
from tallyscope.plans.catalog.forest_sql import FLAG_SQL, forest_sql
from tallyscope.plans.catalog.laws import D1, FIRST, NONZERO, STOP, THREE, TOKENS, _digit_table_sql, _significant_sql
from tallyscope.plans.catalog.ledgers import r
from tallyscope.plans.catalog.measures import rounded
from tallyscope.plans.catalog.risks import SCORES_SQL, method_scores
from tallyscope.plans.registry import ORACLES, query
from tallyscope.session import reliable, scratch_path
from tallyscope.sources import files, models, tables

SIMPLE = ["amount", "hour", "k"]


def simple_features(spark, d):
    a = v.activity(spark, d)
    return a.select("id", "amount", F.hour("ts").cast("double").alias("hour"), F.col("k").cast("double").alias("k"))


@query(
    "p9_ordered_split",
    """
    WITH t AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, toxic, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM t
    """,
)
def p9(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return fe.ordered_split(rows, "toxic", [F.col("doc_id")])


FEATURE_SQL = """
    s AS (SELECT avg(amount) AS m, stddev_samp(amount) AS sd, count(*) AS n, quantile_cont(amount, 0.25) AS c25, quantile_cont(amount, 0.5) AS c50, quantile_cont(amount, 0.75) AS c75,
                 quantile_cont(amount, 0.9) AS c90, quantile_cont(amount, 0.95) AS c95, max(amount) AS c100 FROM activity),
    a AS (SELECT CAST(amount AS DECIMAL(20,2)) AS x, count(*) AS c FROM activity GROUP BY 1),
    nb AS (SELECT p.x, sum(q.c) AS near FROM a p JOIN a q ON q.x BETWEEN p.x - p.x * 0.01::DECIMAL(6,4) AND p.x + p.x * 0.01::DECIMAL(6,4) GROUP BY 1),
    dv AS (SELECT account_id, sum(c) / CAST(count(*) AS DOUBLE) AS velocity FROM (SELECT account_id, CAST(ts AS DATE) AS day, count(*) AS c FROM activity GROUP BY ALL) GROUP BY 1),
    f AS (SELECT id, amount, ln(1 + abs(amount)) AS log_amount, (amount - m) / sd AS amount_zscore, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CAST(hour(ts) AS DOUBLE) AS "hour", CAST(month(ts) AS DOUBLE) AS "month",
                 count(*) OVER (PARTITION BY account_id) / CAST(n AS DOUBLE) AS vendor_frequency, near / CAST(n AS DOUBLE) AS amount_frequency,
                 CAST(sum(CAST(amount AS DECIMAL(20,2))) OVER (ORDER BY id) AS DOUBLE) AS running_balance, abs(amount - m) / m AS deviation, velocity,
                 CAST(CASE WHEN amount <= c25 THEN 0 WHEN amount <= c50 THEN 1 WHEN amount <= c75 THEN 2 WHEN amount <= c90 THEN 3 WHEN amount <= c95 THEN 4 ELSE 5 END AS DOUBLE) AS band
          FROM activity JOIN nb ON nb.x = CAST(amount AS DECIMAL(20,2)) JOIN dv USING (account_id), s)
"""
FEATURE_COLUMNS = ", ".join(f'round("{c}", 6) AS "{c}"' for c in fe.TRANSACTION_FEATURES)


def _features(spark, d):
    return fe.transaction_features(v.activity(spark, d), "id", "account_id", "amount", "ts")


@query("o8_transaction_features", f"WITH {FEATURE_SQL} SELECT id, {FEATURE_COLUMNS} FROM f", ["activity"])
def o8(spark, d):
    return rounded(_features(spark, d))


@query(
    "o9_model_features",
    """
    WITH c AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM activity))
    SELECT id, amount, round(ln(1 + amount), 6) AS log_amount, round(amount * amount, 4) AS amount_squared, CAST(hour(ts) AS DOUBLE) AS "hour", CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CAST(month(ts) AS DOUBLE) AS "month",
           CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0 END AS is_weekend, CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0::DOUBLE ELSE 0 END AS is_business_hours,
           CAST(count(*) OVER (PARTITION BY account_id) AS DOUBLE) AS account_transaction_count, round(avg(amount) OVER (PARTITION BY account_id), 9) AS account_avg_amount,
           round(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, id)) / 1e6, 0), 6) AS time_since_last, CAST(code AS DOUBLE) AS category_code FROM activity JOIN c USING (category)
    """,
    ["activity"],
)
def o9(spark, d):
    out = fe.model_features(v.activity(spark, d), "id", "account_id", "amount", "ts", ["category"])
    return rounded(out, amount_squared=4, account_avg_amount=9)


@query(
    "o10_fraud_features",
    """
    WITH s AS (SELECT avg(amount) AS m, stddev_samp(amount) AS sd FROM activity), c AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM activity))
    SELECT id, amount, round(ln(1 + amount), 6) AS log_amount, round((amount - m) / sd, 6) AS amount_zscore, CAST(hour(ts) AS DOUBLE) AS "hour", CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week,
           CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0 END AS is_weekend, CAST(code AS DOUBLE) AS category_code FROM activity JOIN c USING (category), s
    """,
    ["activity"],
)
def o10(spark, d):
    return rounded(fe.fraud_features(v.activity(spark, d), "id", "amount", "ts", ["category"]))


# three features of an event, as they are and standardised
RAW_POINTS = "pts AS (SELECT id, [amount, CAST(hour(ts) AS DOUBLE), CAST(k AS DOUBLE)] AS xs FROM activity)"
SCALED_POINTS = """
    sst AS (SELECT avg(amount) AS am, stddev_pop(amount) AS asd, avg(hour(ts)) AS hm, stddev_pop(hour(ts)) AS hsd, avg(k) AS km, stddev_pop(k) AS ksd FROM activity),
    spt AS (SELECT id, (amount - am) / asd AS x, (hour(ts) - hm) / hsd AS y, (k - km) / ksd AS z, min(id) OVER (PARTITION BY amount, hour(ts), k) AS vid FROM activity, sst),
    pts AS (SELECT id, [x, y, z] AS xs FROM spt)
"""
KEPT_POINTS = SCALED_POINTS.replace("(amount - am) / asd", "round((amount - am) / asd, 9)").replace("(hour(ts) - hm) / hsd", "round((hour(ts) - hm) / hsd, 9)").replace("(k - km) / ksd", "round((k - km) / ksd, 9)")
ALL_POINTS = f"{FEATURE_SQL}, pts AS (SELECT id, [{', '.join(f'round({c}, 6)' for c in (chr(34) + f + chr(34) for f in fe.TRANSACTION_FEATURES))}] AS xs FROM f)"


@query(
    "o11_isolation_forest",
    f"WITH {ALL_POINTS}, {forest_sql(len(fe.TRANSACTION_FEATURES))}, {FLAG_SQL} SELECT id, round(score, 6) AS score, is_anomaly, round(decision, 6) AS decision, round(risk_score, 6) AS risk_score FROM flg",
    ["activity"],
)
def o11(spark, d):
    rows = reliable(rounded(_features(spark, d)))
    scored = reliable(fo.score(rows, fo.fit(rows, "id", fe.TRANSACTION_FEATURES), fe.TRANSACTION_FEATURES))
    return rounded(fo.flag(scored, 0.1).select("id", "score", "is_anomaly", "decision", "risk_score"))


# distinct vectors named by their smallest id; every row's k nearest other rows by (distance, vector)
RAW_NEAR = "p AS (SELECT id, amount AS x, CAST(hour(ts) AS DOUBLE) AS y, CAST(k AS DOUBLE) AS z, min(id) OVER (PARTITION BY amount, hour(ts), k) AS vid FROM activity)"


def _near_sql(k, points=RAW_NEAR):
    return f"""
    {points},
    nn AS (SELECT a.id, a.vid, min({{'own': (a.vid <> b.vid)::INT, 'd': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 'v': b.vid}}, {k}) AS l
           FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id, a.vid)
    """


@query("o12_knn_distance", f"WITH {_near_sql(5)} SELECT id, round(l[5].d, 6) AS knn_score FROM nn", ["activity"])
def o12(spark, d):
    return rounded(ne.knn_score(simple_features(spark, d), "id", SIMPLE).select("id", "knn_score"))


@query(
    "o13_local_outlier_factor",
    f"""WITH {_near_sql(20)}, far AS (SELECT vid, any_value(l[20].d) AS f FROM nn GROUP BY 1), e AS (SELECT id, vid, unnest(l) AS o FROM nn),
    dens AS (SELECT id, e.vid, 1 / (avg(greatest(o.d, f)) + 1e-10) AS lrd FROM e JOIN far ON far.vid = o.v GROUP BY 1, 2), dv AS (SELECT vid, any_value(lrd) AS lrd FROM dens GROUP BY 1)
    SELECT e.id, round(avg(dv.lrd) / any_value(dens.lrd), 5) AS lof_score FROM e JOIN dv ON dv.vid = e.o.v JOIN dens ON dens.id = e.id GROUP BY e.id""",
    ["activity"],
)
def o13(spark, d):
    return rounded(ne.lof_score(simple_features(spark, d), "id", SIMPLE).select("id", "lof_score"), 5)


def _one_class_sql():
    weights, phases, scale = ne.fourier_features(3)
    phi = [f"cos({p!r} + x * {w[0]!r} + y * {w[1]!r} + z * {w[2]!r}) * {scale!r}" for w, p in zip(weights.tolist(), phases.tolist())]
    cols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(phi))
    means = ", ".join(f"avg(f{i}) AS m{i}" for i in range(len(phi)))
    dot = " + ".join(f"f{i} * m{i}" for i in range(len(phi)))
    return f"""WITH s AS (SELECT avg(amount) AS am, stddev_pop(amount) AS asd, avg(hour(ts)) AS hm, stddev_pop(hour(ts)) AS hsd, avg(k) AS km, stddev_pop(k) AS ksd FROM activity),
    p AS (SELECT id, (amount - am) / asd AS x, (hour(ts) - hm) / hsd AS y, (k - km) / ksd AS z FROM activity, s), f AS (SELECT id, {cols} FROM p), m AS (SELECT {means} FROM f)
    SELECT id, round(1 - ({dot}), 6) AS svm_score FROM f, m"""


@query("o14_one_class_boundary", _one_class_sql(), ["activity"])
def o14(spark, d):
    from tallyscope.operators.stats import scaled

    return rounded(ne.one_class_score(scaled(simple_features(spark, d), SIMPLE), SIMPLE).select("id", "svm_score"))


def _ensemble_sql(scores):
    """``ensemble.ensemble`` on a CTE ``det (id, scores)``."""
    unit = " + ".join(f"CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0 END" for c in scores)
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, quantile_cont({c}, 0.9) AS cut_{c}" for c in scores)
    votes = " + ".join(f"({c} > cut_{c})::INT" for c in scores)
    shown = ", ".join(f"round({c}, 5) AS {c}" for c in scores)
    return f"""eds AS (SELECT {ends} FROM det), ens AS (SELECT det.*, ({unit}) / {len(scores)} AS e, ({votes}) / {len(scores)}.0::DOUBLE AS agreement FROM det, eds)
    SELECT id, {shown}, round(e, 5) AS ensemble_score, (e > (SELECT quantile_cont(e, 0.9) FROM ens))::INT AS is_anomaly, round(agreement, 5) AS agreement FROM ens"""


def _svm_sql():
    """``svm (id, svm_score)`` from ``spt``."""
    weights, phases, scale = ne.fourier_features(3)
    phi = [f"cos({p!r} + x * {w[0]!r} + y * {w[1]!r} + z * {w[2]!r}) * {scale!r}" for w, p in zip(weights.tolist(), phases.tolist())]
    dot = " + ".join(f"f{i} * m{i}" for i in range(len(phi)))
    return f"""svf AS (SELECT id, {', '.join(f'{e} AS f{i}' for i, e in enumerate(phi))} FROM spt), svm0 AS (SELECT {', '.join(f'avg(f{i}) AS m{i}' for i in range(len(phi)))} FROM svf),
    svm AS (SELECT id, 1 - ({dot}) AS svm_score FROM svf, svm0)"""


@query(
    "o15_detector_ensemble",
    f"""WITH {KEPT_POINTS}, {forest_sql(3)}, {_svm_sql()}, {_near_sql(20, "p AS (SELECT id, x, y, z, vid FROM spt)")},
    far AS (SELECT vid, any_value(l[20].d) AS f FROM nn GROUP BY 1), e AS (SELECT id, vid, unnest(l) AS o FROM nn),
    dens AS (SELECT id, e.vid, 1 / (avg(greatest(o.d, f)) + 1e-10) AS lrd FROM e JOIN far ON far.vid = o.v GROUP BY 1, 2), dv AS (SELECT vid, any_value(lrd) AS lrd FROM dens GROUP BY 1),
    lof AS (SELECT e.id, avg(dv.lrd) / any_value(dens.lrd) AS lof_score FROM e JOIN dv ON dv.vid = e.o.v JOIN dens ON dens.id = e.id GROUP BY e.id),
    det AS (SELECT iso.id, score AS iforest_score, lof_score, svm_score, nn.l[5].d AS knn_score FROM iso JOIN lof USING (id) JOIN svm USING (id) JOIN nn USING (id)),
    {_ensemble_sql(["iforest_score", "lof_score", "svm_score", "knn_score"])}""",
    ["activity"],
)
def o15(spark, d):
    out = en.detect(simple_features(spark, d), "id", SIMPLE)
    return rounded(out.drop(*SIMPLE), 5)


UNIT_SQL = """
    b AS (SELECT min(amount) AS a0, max(amount) AS a1, min(hour(ts)) AS h0, max(hour(ts)) AS h1, min(k) AS k0, max(k) AS k1 FROM activity),
    n AS (SELECT id, (amount - a0) / (a1 - a0) AS a, (hour(ts) - h0) / CAST(h1 - h0 AS DOUBLE) AS h, (k - k0) / CAST(k1 - k0 AS DOUBLE) AS k FROM activity, b)
"""


@query(
    "o16_ensemble_rules",
    f"""WITH {UNIT_SQL} SELECT id, round((a + h + k) / 3, 6) AS average, round(greatest(a, h, k), 6) AS maximum, round(((a > 0.7)::INT + (h > 0.7)::INT + (k > 0.7)::INT) / 3.0::DOUBLE, 6) AS voting FROM n""",
    ["activity"],
)
def o16(spark, d):
    rows = simple_features(spark, d)
    for method, name in (("average", "average"), ("max", "maximum"), ("voting", "voting")):
        rows = en.combine(rows, SIMPLE, method, out=name)
    return rounded(rows.select("id", "average", "maximum", "voting"))


@query("o17_principal_components")
def o17(spark, d):
    e = v.table(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])
    return en.principal_components(rows, "vec_id", [f"e{i}" for i in range(width)])


# the eigenvalues of a symmetric 3 x 3 matrix in closed form; a component is a cross product of rows of C - value * I
COMPONENTS = """
    p0 AS (SELECT id, amount / 10 AS x, hour(ts) / 10.0::DOUBLE AS y, k / 50.0::DOUBLE + amount / 40 AS z FROM activity),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p0), p AS (SELECT id, x - mx AS x, y - my AS y, z - mz AS z FROM p0, m),
    c AS (SELECT avg(x * x) AS a, avg(y * y) AS b, avg(z * z) AS g, avg(x * y) AS d, avg(x * z) AS e, avg(y * z) AS f FROM p),
    q AS (SELECT *, (a + b + g) / 3 AS q FROM c),
    r AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (g - q) * (g - q) + 2 * (d * d + e * e + f * f)) / 6) AS s FROM q),
    t AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (g - q) - f * f) - d * (d * (g - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * s * s * s)))) / 3 AS phi FROM r),
    l AS (SELECT *, q + 2 * s * cos(phi) AS l1, q + 2 * s * cos(phi + 2 * pi() / 3) AS l3 FROM t),
    w AS (SELECT *, unnest([{'i': 1, 'v': l1}, {'i': 2, 'v': 3 * q - l1 - l3}, {'i': 3, 'v': l3}]) AS o FROM l),
    u AS (SELECT o.i AS i, o.v AS v, [d * f - e * (b - o.v), e * d - (a - o.v) * f, (a - o.v) * (b - o.v) - d * d] AS n1,
                 [d * (g - o.v) - e * f, e * e - (a - o.v) * (g - o.v), (a - o.v) * f - d * e] AS n2, [(b - o.v) * (g - o.v) - f * f, f * e - d * (g - o.v), d * f - (b - o.v) * e] AS n3 FROM w),
    n AS (SELECT *, n1[1] * n1[1] + n1[2] * n1[2] + n1[3] * n1[3] AS s1, n2[1] * n2[1] + n2[2] * n2[2] + n2[3] * n2[3] AS s2, n3[1] * n3[1] + n3[2] * n3[2] + n3[3] * n3[3] AS s3 FROM u),
    k AS (SELECT i, v, CASE WHEN s1 >= s2 AND s1 >= s3 THEN n1 WHEN s2 >= s3 THEN n2 ELSE n3 END AS n, greatest(s1, s2, s3) AS s FROM n),
    j AS (SELECT id, i, v, pow(x * n[1] + y * n[2] + z * n[3], 2) / s AS sq FROM p, k)
"""


@query(
    "o17_component_squares",
    f"""WITH {COMPONENTS} SELECT id, round(max(sq) FILTER (i = 1), 5) AS square1, round(max(sq) FILTER (i = 2), 5) AS square2, round(max(sq) FILTER (i = 3), 5) AS square3,
    round(max(v) FILTER (i = 1), 6) AS variance1, round(max(v) FILTER (i = 2), 6) AS variance2, round(max(v) FILTER (i = 3), 6) AS variance3 FROM j GROUP BY id""",
    ["activity"],
)
def o17_squares(spark, d):
    """Signs of components are free, so their squares and mean squares are compared."""
    a = v.activity(spark, d)
    rows = a.select("id", (F.col("amount") / 10).alias("x"), (F.hour("ts") / 10.0).alias("y"), (F.col("k") / 50.0 + F.col("amount") / 40).alias("z"))
    found = reliable(en.principal_components(rows, "id", ["x", "y", "z"], 3))
    squares = [F.col(f"pc{i}") * F.col(f"pc{i}") for i in (1, 2, 3)]
    means = found.agg(*[F.avg(s).alias(f"variance{i}") for i, s in enumerate(squares, 1)])
    out = found.select("id", *[r(s, 5).alias(f"square{i}") for i, s in enumerate(squares, 1)]).crossJoin(F.broadcast(means))
    return out.select("id", "square1", "square2", "square3", *[r(f"variance{i}", 6).alias(f"variance{i}") for i in (1, 2, 3)])


@query(
    "o18_dbscan_noise",
    """
    WITH p AS (SELECT id, amount / 10 AS x, hour(ts) / 2.0::DOUBLE + k / 25.0::DOUBLE AS y FROM activity),
    e AS (SELECT p.id AS i, q.id AS j FROM p JOIN p q ON q.x BETWEEN p.x - 0.6 AND p.x + 0.6 AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.25),
    c AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 5)
    SELECT id, CASE WHEN id IN (SELECT e.i FROM e JOIN c ON c.i = e.j) THEN 0 ELSE 1 END AS is_noise FROM p
    """,
    ["activity"],
)
def o18(spark, d):
    rows = simple_features(spark, d).select("id", (F.col("amount") / 10).alias("x"), (F.col("hour") / 2.0 + F.col("k") / 25.0).alias("y"))
    return ne.dbscan_noise(rows, "id", ["x", "y"])


@query(
    "o19_confidence_severity",
    """
    WITH x AS (SELECT id, 1 - greatest(0, least(1, 0.5 + (k - 50) / 100.0::DOUBLE)) AS c FROM activity)
    SELECT id, round(c, 6) AS confidence, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c >= 0.4 THEN 'low' ELSE 'very_low' END AS severity FROM x
    """,
    ["activity"],
)
def o19(spark, d):
    value, label = fo.confidence((F.col("k") - 50) / F.lit(100.0))
    return v.activity(spark, d).select("id", r(value).alias("confidence"), label.alias("severity"))


@query(
    "o20_explanations",
    """
    WITH x AS (SELECT id, amount, CAST(hour(ts) AS DOUBLE) AS h, CAST(k AS DOUBLE) AS kk, category FROM activity),
    s AS (SELECT avg(amount) AS am, stddev_pop(amount) AS asd, avg(h) AS hm, stddev_pop(h) AS hsd, avg(kk) AS km, stddev_pop(kk) AS ksd FROM x WHERE category <> 'error')
    SELECT id, 'amount' AS feature, amount AS "value", round(am, 6) AS mean, round(abs(amount - am) / asd, 6) AS z_score FROM x, s WHERE abs(amount - am) / asd > 2
    UNION ALL SELECT id, 'hour', h, round(hm, 6), round(abs(h - hm) / hsd, 6) FROM x, s WHERE abs(h - hm) / hsd > 2
    UNION ALL SELECT id, 'k', kk, round(km, 6), round(abs(kk - km) / ksd, 6) FROM x, s WHERE abs(kk - km) / ksd > 2
    """,
    ["activity"],
)
def o20(spark, d):
    rows = v.activity(spark, d).select("id", "category", "amount", F.hour("ts").cast("double").alias("hour"), F.col("k").cast("double").alias("k"))
    return rounded(fe.explain(rows.drop("category"), rows.where(F.col("category") != "error"), "id", SIMPLE))


IMPORTANCE_SQL = """
    x AS (SELECT amount, CAST(hour(ts) AS DOUBLE) AS h, CAST(k AS DOUBLE) AS kk, amount > 50 AS f FROM activity),
    w AS (SELECT abs(avg(amount) FILTER (f) - avg(amount) FILTER (NOT f)) / stddev_pop(amount) AS a, abs(avg(h) FILTER (f) - avg(h) FILTER (NOT f)) / stddev_pop(h) AS b,
                 abs(avg(kk) FILTER (f) - avg(kk) FILTER (NOT f)) / stddev_pop(kk) AS c FROM x),
    i AS (SELECT 'amount' AS feature, a / (a + b + c) AS importance FROM w UNION ALL SELECT 'hour', b / (a + b + c) FROM w UNION ALL SELECT 'k', c / (a + b + c) FROM w)
"""


def _importance(spark, d):
    return fe.importance(simple_features(spark, d).withColumn("f", (F.col("amount") > 50).cast("int")), "f", SIMPLE)


@query("o21_feature_importance", f"WITH {IMPORTANCE_SQL} SELECT feature, round(importance, 6) AS importance FROM i", ["activity"])
def o21(spark, d):
    return rounded(_importance(spark, d))


@query(
    "t8_risk_drivers",
    f"WITH {IMPORTANCE_SQL} SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM i WHERE importance >= 0.1",
    ["activity"],
)
def t8(spark, d):
    return rounded(fe.risk_drivers(_importance(spark, d)))


@query(
    "o22_contamination_rates",
    "WITH c(mode, sensitivity, rate) AS (VALUES "
    + ", ".join(f"('{m}', '{s}', {x}::DOUBLE)" for m, t in CONTAMINATION.items() for s, x in zip(("conservative", "standard", "aggressive"), t))
    + """), rt AS (SELECT DISTINCT rate FROM c), cut AS (SELECT rate, (SELECT list_sort(list(amount)) FROM activity) AS l FROM rt),
    th AS (SELECT rate, l[floor((1 - rate) * (len(l) - 1))::INT + 1] + (l[ceil((1 - rate) * (len(l) - 1))::INT + 1] - l[floor((1 - rate) * (len(l) - 1))::INT + 1]) * ((1 - rate) * (len(l) - 1) - floor((1 - rate) * (len(l) - 1))) AS threshold FROM cut),
    n AS (SELECT rate, count(*) AS flagged FROM th JOIN activity ON amount > threshold GROUP BY 1)
    SELECT mode, sensitivity, c.rate, round(threshold, 6) AS threshold, flagged FROM c JOIN th ON th.rate = c.rate JOIN n ON n.rate = c.rate""",
    ["activity"],
)
def o22(spark, d):
    rows = [(m, s, x) for m, t in CONTAMINATION.items() for s, x in zip(("conservative", "standard", "aggressive"), t)]
    config = spark.createDataFrame(rows, "mode string, sensitivity string, rate double")
    rates = sorted({x for _, _, x in rows})
    a = v.activity(spark, d).select("amount")
    cuts = exact_percentiles(a, [], "amount", {f"t{i}": 1 - x for i, x in enumerate(rates)}).drop("n")
    counted = a.crossJoin(F.broadcast(cuts)).agg(*[F.max(f"t{i}").alias(f"t{i}") for i in range(len(rates))], *[F.count_if(F.col("amount") > F.col(f"t{i}")).alias(f"n{i}") for i in range(len(rates))])
    by_rate = counted.select(F.inline(F.array(*[F.struct(F.lit(x).alias("rate"), F.col(f"t{i}").alias("threshold"), F.col(f"n{i}").alias("flagged")) for i, x in enumerate(rates)])))
    return rounded(by_rate.join(F.broadcast(config), "rate").select("mode", "sensitivity", "rate", "threshold", "flagged"))


@query(
    "s13_model_round_trip",
    f"WITH {SCALED_POINTS}, {forest_sql(3)}, {FLAG_SQL} SELECT id, round(score, 6) AS score, is_anomaly FROM flg",
    ["activity"],
)
def s13(spark, d):
    rows = simple_features(spark, d)
    path = scratch_path(spark, "model")
    scaler = models.scaler_table(rows, SIMPLE)
    models.save_model(path, fo.fit(models.apply_scaler(rows, scaler, SIMPLE), "id", SIMPLE), scaler, SIMPLE, method="isolation_forest", contamination="0.1")
    nodes, scaler, meta = models.load_model(spark, path)
    names = meta["features"].split(",")
    scored = reliable(fo.score(models.apply_scaler(rows, scaler, names), nodes, names))
    return rounded(fo.flag(scored, float(meta["contamination"])).select("id", "score", "is_anomaly"))


# fitted on the even ids; the others have categories that the fit never saw
ENCODED = """
    enc AS (SELECT category, row_number() OVER (ORDER BY encode(category)) - 1 AS code FROM (SELECT DISTINCT category FROM activity WHERE id % 2 = 0 AND category <> 'view')),
    src AS (SELECT id, amount, CAST(hour(ts) AS DOUBLE) AS h, CASE WHEN k % 7 = 0 THEN 'unseen' WHEN k % 11 = 0 THEN NULL ELSE category END AS category FROM activity WHERE id % 2 = 1),
    pts AS (SELECT id, [amount, CAST(hour(ts) AS DOUBLE), CAST(code AS DOUBLE)] AS xs FROM activity JOIN enc USING (category) WHERE id % 2 = 0),
    oth AS (SELECT id, category, coalesce(code, -1) AS code, [amount, h, CAST(coalesce(code, -1) AS DOUBLE)] AS xs FROM src LEFT JOIN enc USING (category))
"""


@query(
    "s13_stored_encoders",
    f"WITH {ENCODED}, {forest_sql(3, read='oth')} SELECT id, category, CAST(code AS INTEGER) AS category_code, round(score, 6) AS score FROM iso JOIN oth USING (id)",
    ["activity"],
)
def s13_encoders(spark, d):
    a = v.activity(spark, d).select("id", "amount", F.hour("ts").cast("double").alias("hour"), "category", "k")
    fitted = a.where((F.col("id") % 2 == 0) & (F.col("category") != "view"))
    names, path = ["amount", "hour", "category_code"], scratch_path(spark, "encoded-model")
    encoders = models.encoder_table(fitted, ["category"])
    rows = models.apply_encoders(fitted, encoders, ["category"])
    models.save_model(path, fo.fit(rows, "id", names), models.scaler_table(rows, names), names, encoders)
    nodes, _, meta = models.load_model(spark, path)
    other = a.where(F.col("id") % 2 == 1).withColumn("category", F.when(F.col("k") % 7 == 0, "unseen").when(F.col("k") % 11 != 0, F.col("category")))
    other = models.apply_encoders(other, models.load_encoders(spark, path), ["category"])
    return rounded(fo.score(other, nodes, meta["features"].split(",")).select("id", "category", "category_code", "score"))


@query(
    "j10_predictions_by_key",
    f"""WITH {RAW_POINTS}, {forest_sql(3)}, {FLAG_SQL}, cf AS (SELECT id, 1 - greatest(0, least(1, 0.5 + decision)) AS c FROM flg WHERE is_anomaly = 1)
    SELECT id, account_id, amount, round(c, 6) AS confidence, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c >= 0.4 THEN 'low' ELSE 'very_low' END AS severity FROM cf JOIN activity USING (id)""",
    ["activity"],
)
def j10(spark, d):
    rows = simple_features(spark, d)
    scored = fo.flag(reliable(fo.score(rows, fo.fit(rows, "id", SIMPLE), SIMPLE)))
    conf, severity = fo.confidence(F.col("decision"))
    found = scored.where(F.col("is_anomaly") == 1).select("id", r(conf).alias("confidence"), severity.alias("severity"))
    return v.activity(spark, d).select("id", "account_id", "amount").join(found, "id")


@query(
    "a27_method_success",
    f"WITH {SCORES_SQL} SELECT session_id, count(*) AS completed, CAST(6 AS INTEGER) AS attempted, round(count(*) / 6.0::DOUBLE, 6) AS success_rate FROM msc GROUP BY session_id",
    ["activity"],
)
def a27(spark, d):
    return method_scores(spark, d).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("completed"), F.lit(6).alias("attempted"), r(F.count(F.lit(1)) / F.lit(6.0)).alias("success_rate")
    )


@query(
    "s6_statistical_results",
    f"""SELECT category AS audit_session_id, 'benford' AS analysis_type, CAST(8 AS INTEGER) AS degrees_of_freedom, false AS has_json, CAST(total_values AS INTEGER) AS sample_size,
    chi_square AS chi_square_statistic, p_value, significant AS anomaly_detected FROM ({_significant_sql(NONZERO, 'category', THREE)})""",
    ["activity"],
)
def s6(spark, d):
    from tallyscope.operators.digit_law import significant_test

    res = significant_test(v.activity(spark, d), ["category"], "amount").select(
        F.col("category").alias("audit_session_id"), F.lit("benford").alias("analysis_type"), F.col("total_values").cast("int").alias("sample_size"),
        F.col("chi_square").alias("chi_square_statistic"), "p_value", F.lit(8).alias("degrees_of_freedom"), F.col("significant").alias("anomaly_detected"),
        F.struct("conformity", "anomalous_digits").alias("analysis_results"),
    )
    path = scratch_path(spark, "statistics")
    tables.append(res, "statistics", path)
    back = tables.read(spark, "statistics", path)
    return back.select(
        "audit_session_id", "analysis_type", "degrees_of_freedom", (F.col("analysis_results") == "{}").alias("has_json"), "sample_size",
        r("chi_square_statistic", 4).alias("chi_square_statistic"), r("p_value").alias("p_value"), "anomaly_detected",
    )


@query("s7_csv_scan", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY lang")
def s7(spark, d):
    path = scratch_path(spark, "csv")
    rows = v.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    rows.write.option("header", "true").option("escape", '"').csv(path)
    back = files.read_csv(spark, path, rows.schema, multiline=True)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct(F.md5("text")).alias("texts"))


@query("s9_text_scan", "SELECT md5(text) AS digest, count(*) AS n FROM conversations GROUP BY 1")
def s9(spark, d):
    path = scratch_path(spark, "texts")
    # one file per task; the record separator cannot occur in a text
    rows = v.table(spark, d, "conversations").select(F.concat("text", F.lit("\u001e")).alias("value"))
    rows.write.option("lineSep", "\u001f").text(path)
    texts = files.read_text(spark, path, "*.txt")
    parts = texts.select(F.explode(F.split("text", "\u001e\u001f?")).alias("t")).where(F.col("t") != "")
    return parts.groupBy(F.md5("t").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("s10_json_scan", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def s10(spark, d):
    path = scratch_path(spark, "json")
    days = v.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "view").alias("view"), F.count_if(F.col("event_type") == "click").alias("click"), F.count_if(F.col("event_type") == "error").alias("error"),
        F.count_if(F.col("event_type") == "signup").alias("signup"), F.count_if(F.col("event_type") == "purchase").alias("purchase"),
    )
    doc = F.to_json(F.struct(F.struct(*[c for c in days.columns if c != "day"]).alias("counts")))
    days.select("day", doc.alias("value")).repartition("day").write.partitionBy("day").option("lineSep", "\n").text(path)
    texts = files.read_json_text(spark, f"{path}/*", "*.txt")
    counts = texts.select(F.explode(F.from_json(F.get_json_object("text", "$.counts"), "map<string,bigint>")).alias("event_type", "n"))
    return counts.groupBy("event_type").agg(F.sum("n").alias("n"))


@query(
    "s11_file_discovery",
    """
    SELECT DISTINCT lang, '.txt' AS extension, '' AS reason FROM documents
    UNION ALL SELECT DISTINCT lang, '.parquet', 'unsupported file format: .parquet' FROM documents
    """,
)
def s11(spark, d):
    path = scratch_path(spark, "files")
    docs = v.table(spark, d, "documents").select("lang", "text")
    docs.write.partitionBy("lang").text(f"{path}/a")
    docs.write.partitionBy("lang").parquet(f"{path}/b")
    found = files.discover(spark, path)
    return found.select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), "extension", F.coalesce("reason", F.lit("")).alias("reason")).distinct()


@query("s12_training_csv", "SELECT toxic AS is_fraud, count(*) AS n FROM labels GROUP BY toxic")
def s12(spark, d):
    path = scratch_path(spark, "training")
    rows = v.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("is_fraud"))
    rows.write.option("header", "true").csv(path)
    return files.read_csv(spark, path, rows.schema).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))


@query("s14_feedback_log", "SELECT category AS human_feedback, count(*) AS n FROM activity GROUP BY 1", ["activity"])
def s14(spark, d):
    path = scratch_path(spark, "feedback")
    rows = v.activity(spark, d).select(F.col("id").alias("transaction_id"), (F.col("k") > 95).alias("predicted_anomaly"), (F.col("k") / F.lit(100.0)).alias("confidence"), F.col("category").alias("human_feedback"))
    files.append_feedback(rows, path)
    back = spark.read.schema("transaction_id long, predicted_anomaly boolean, confidence double, human_feedback string, timestamp timestamp").json(path)
    return back.groupBy("human_feedback").agg(F.count(F.lit(1)).alias("n"))


@query("s15_json_export", "SELECT severity, count(*) AS n FROM findings GROUP BY severity", ["findings"])
def s15(spark, d):
    path = scratch_path(spark, "export")
    rows = v.findings(spark, d).select("finding_id", "severity", "title")
    files.export_json(rows, path)
    return spark.read.schema(rows.schema).json(path).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d2_detector_registry",
    f"WITH {KEPT_POINTS}, {forest_sql(3)}, {_svm_sql()}, det AS (SELECT iso.id, score AS iforest_score, svm_score FROM iso JOIN svm USING (id)), {_ensemble_sql(['iforest_score', 'svm_score'])}",
    ["activity"],
)
def d2(spark, d):
    return rounded(en.detect(simple_features(spark, d), "id", SIMPLE, ["iforest", "ocsvm"]).drop(*SIMPLE), 5)


def _bundle_sql():
    """The four analyses of the bundle from their own SQL, as (category, metric, value, analysis) rows."""
    parts = {
        "benford": (_significant_sql(NONZERO, "category", THREE), "conformity"),
        "descriptive": (ORACLES["a5_descriptive"], None),
        "outliers": (ORACLES["o1_iqr_outliers"], None),
        "distribution": (ORACLES["o5_jarque_bera"], None),
    }
    out = []
    for name, (sql, text) in parts.items():
        skip = f"category, {text}" if text else "category"
        numbers = f"SELECT category, CAST(COLUMNS(* EXCLUDE ({skip})) AS DOUBLE) FROM ({sql})"
        out.append(f"SELECT category, metric, value, '{name}' AS analysis FROM (UNPIVOT ({numbers}) ON COLUMNS(* EXCLUDE (category)) INTO NAME metric VALUE value)")
    return " UNION ALL ".join(out)


@query("d4_analysis_bundle", _bundle_sql(), ["activity"])
def d4(spark, d):
    # the digits each part's own SQL keeps
    value, metric = F.col("value"), F.col("metric")
    kept = F.when(metric.isin("variance", "chi_square"), F.round(value, 4)).when(metric == "jarque_bera", F.round(value, 3)).otherwise(F.round(value, 6))
    return en.analyze(v.activity(spark, d), ["category"], "amount").withColumn("value", kept)


@query(
    "d1_configured_thresholds",
    """
    WITH m AS (SELECT account_id, sum(k) / (count(*) * 100.0::DOUBLE) AS s FROM activity GROUP BY 1), p(mode, md, hi, cr) AS (VALUES ('standard', 0.6, 0.8, 0.9), ('conservative', 0.5, 0.75, 0.85), ('aggressive', 0.65, 0.85, 0.95), ('custom', 0.6, 0.8, 0.9))
    SELECT mode, CASE WHEN s >= cr THEN 'critical' WHEN s >= hi THEN 'high' WHEN s >= md THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n FROM m, p GROUP BY ALL
    """,
    ["activity"],
)
def d1(spark, d):
    from tallyscope import config

    scores = v.activity(spark, d).groupBy("account_id").agg((F.sum("k") / (F.count(F.lit(1)) * F.lit(100.0))).alias("s"))
    rows = scores.crossJoin(F.broadcast(config.mode_dimension(spark)))
    s = F.col("s")
    level = F.when(s >= F.col("critical"), "critical").when(s >= F.col("high"), "high").when(s >= F.col("medium"), "medium").otherwise("low")
    return rows.groupBy("mode", level.alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def _preset_values(*parts):
    """VALUES of every preset: its name and the wanted ``(section, key)`` values."""
    def shown(x):
        return ("true" if x else "false") if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join([f"'{name}'", *[shown(config.preset(name)[s][k]) for s, k in parts]]) + ")" for name in config.PRESETS) + ")"


PRESET_WEIGHTS = ", ".join(f"('{name}', '{m}', {w!r})" for name in config.PRESETS for m, w in config.preset(name)["weights"].items())


@query(
    "d1_preset_weights",
    f"""WITH {SCORES_SQL}, pw(preset, family, w) AS (VALUES {PRESET_WEIGHTS}),
    x AS (SELECT preset, session_id, CAST(sum(CAST(score AS DECIMAL(18,9)) * CAST(w AS DECIMAL(9,4))) AS DOUBLE) AS s, CAST(sum(CAST(w AS DECIMAL(9,4))) AS DOUBLE) AS w
          FROM msc JOIN pw ON family = regexp_replace(method, '_[12]$', '') GROUP BY ALL)
    SELECT preset, session_id, round(least(greatest(CASE WHEN abs(w - 1) > 0.01 THEN s / w ELSE s END, 0), 1), 9) AS composite_score FROM x""",
    ["activity"],
)
def d1_weights(spark, d):
    return rounded(pr.weighted_risk(method_scores(spark, d), ["session_id"], config.preset_weights(spark)), 9)


@query(
    "d1_preset_words",
    f"""WITH w AS ({TOKENS}), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL), c2 AS (SELECT false AS rs, * FROM c UNION ALL SELECT true, * FROM c WHERE word NOT IN {STOP}),
    rk AS (SELECT *, row_number() OVER (PARTITION BY rs, lang ORDER BY n DESC, word) AS rank, n / CAST(sum(n) OVER (PARTITION BY rs, lang) AS DOUBLE) AS f FROM c2),
    p(preset, rs, top) AS {_preset_values(("zipf", "remove_stopwords"), ("zipf", "top_words"))}
    SELECT preset, lang, count(*) AS items_used, round(coalesce(corr(ln(f), ln(1.0::DOUBLE / rank)), 0), 6) AS correlation FROM rk JOIN p USING (rs) WHERE rank <= top GROUP BY preset, lang""",
)
def d1_words(spark, d):
    counts = wl.word_counts(v.table(spark, d, "documents"), ["lang"], "text")
    return rounded(pr.word_correlation(counts, ["lang"], config.preset_dimension(spark, "zipf")))


@query(
    "d1_preset_digits",
    f"""WITH {_digit_table_sql('activity', 'account_id', D1, FIRST)},
    x AS (SELECT account_id, sum(pow(n - expected * total, 2) / (expected * total)) AS chi, CAST(max(total) AS BIGINT) AS total FROM t GROUP BY 1),
    b(significance, bound) AS (VALUES (0.05, 15.507313056), (0.01, 20.09023503), (0.1, 13.361566137)), p(preset, sig, least) AS {_preset_values(("benford", "significance"), ("benford", "minimum_sample"))}
    SELECT account_id, preset, CASE WHEN total < least THEN 'insufficient' WHEN chi > bound THEN 'significant' ELSE 'conforming' END AS verdict FROM x, p JOIN b ON abs(sig - significance) < 1e-9""",
    ["activity"],
)
def d1_digits_by_preset(spark, d):
    tests = dl.engine_test(v.activity(spark, d), ["account_id"], "amount")
    return pr.digit_verdicts(tests, ["account_id"], config.preset_digits(spark)).select("account_id", "preset", "verdict")


# the amount is missing in a twelfth of the rows, the code in a sixteenth
@query(
    "d1_preset_quality",
    f"""WITH q AS (SELECT CASE WHEN k % 12 <> 0 THEN amount END AS amount, CASE WHEN id % 16 <> 0 THEN CAST(k AS DOUBLE) END AS k, CAST(id AS DOUBLE) AS id FROM activity),
    l AS (UNPIVOT (SELECT * FROM q) ON COLUMNS(*) INTO NAME c VALUE x), n AS (SELECT count(*) AS rows FROM q),
    f AS (SELECT c, count(*) AS present, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY c),
    o AS (SELECT c, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM l JOIN f USING (c) GROUP BY c),
    p(preset, least, miss, outl) AS {_preset_values(("quality", "minimum_sample"), ("quality", "maximum_missing"), ("quality", "maximum_outliers"))}
    SELECT preset, c AS "column", CASE WHEN rows < least THEN 'too_small' WHEN (rows - present) * 100.0::DOUBLE / rows > miss THEN 'missing' WHEN outliers * 100.0::DOUBLE / rows > outl THEN 'outliers' ELSE 'good' END AS verdict
    FROM f JOIN o USING (c), n, p""",
    ["activity"],
)
def d1_quality(spark, d):
    a = v.activity(spark, d)
    rows = a.select(F.when(F.col("k") % 12 != 0, F.col("amount")).alias("amount"), F.when(F.col("id") % 16 != 0, F.col("k").cast("double")).alias("k"), F.col("id").cast("double").alias("id"))
    return pr.column_verdicts(stats.column_quality(rows), config.preset_dimension(spark, "quality"))


@query(
    "d1_preset_risk",
    f"""WITH p(preset, least, md, hi, cr) AS {_preset_values(("risk", "minimum_confidence"), ("risk", "medium"), ("risk", "high"), ("risk", "critical"))}, x AS (SELECT category, k / 100.0::DOUBLE AS c FROM activity)
    SELECT preset, category, CASE WHEN c >= cr THEN 'critical' WHEN c >= hi THEN 'high' WHEN c >= md THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n FROM x JOIN p ON c >= least GROUP BY ALL""",
    ["activity"],
)
def d1_risk(spark, d):
    rows = v.activity(spark, d).select("category", (F.col("k") / F.lit(100.0)).alias("confidence"))
    return pr.confident(rows, ["category"], "confidence", config.preset_dimension(spark, "risk"))


def _forest_flags_sql():
    found = sorted({config.preset(name)["detectors"]["trees"] for name in config.PRESETS})
    parts = []
    for trees in found:
        names = ", ".join(f"'{n}'" for n in config.PRESETS if config.preset(n)["detectors"]["trees"] == trees)
        parts.append(f"SELECT id, round(score, 6) AS score, unnest([{names}]) AS preset FROM (WITH {RAW_POINTS}, {forest_sql(3, trees=trees)}, {FLAG_SQL} SELECT id, score FROM flg WHERE is_anomaly = 1)")
    return " UNION ALL ".join(parts)


@query("d1_preset_forest", _forest_flags_sql(), ["activity"])
def d1_forest(spark, d):
    settings = {name: config.preset(name)["detectors"] for name in config.PRESETS}
    return rounded(pr.forest_flags(simple_features(spark, d), "id", SIMPLE, settings))
