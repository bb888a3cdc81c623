"""Detectors: exact neighbours and noise by brute force, forest by properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import ensemble, forest, neighbours
from tallyscope.session import scratch_path
from tallyscope.sources import models


@pytest.fixture(scope="module")
def crowd():
    """A third of all rows are one point, the rest three clusters and some far rows."""
    rng = np.random.default_rng(42)
    x = np.vstack([np.tile([1.0, 1.0], (100, 1)), rng.normal(0, 1, (90, 2)), rng.normal(6, 0.3, (90, 2)), rng.uniform(-15, 15, (20, 2))])
    return np.round(x, 2)


def _df(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))


def _brute(x, k):
    first = {}
    vid = [first.setdefault(tuple(r), i) for i, r in enumerate(x)]
    out = []
    for i in range(len(x)):
        d = [(vid[i] != vid[j], float(np.sqrt(((x[i] - x[j]) ** 2).sum())), vid[j]) for j in range(len(x)) if j != i]
        out.append(sorted(d)[:k])
    return vid, out


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_knn_and_lof_equal_brute_force(spark, crowd, cell_rows):
    df, k = _df(spark, crowd), 6
    vid, near = _brute(crowd, k)
    knn = {r["id"]: r["knn_score"] for r in neighbours.knn_score(df, "id", ["x0", "x1"], k, cell_rows=cell_rows).collect()}
    assert all(knn[i] == pytest.approx(near[i][-1][1], abs=1e-9) for i in range(len(crowd)))
    far = {vid[i]: near[i][-1][1] for i in range(len(crowd))}
    lrd = {vid[i]: 1 / (np.mean([max(d, far[v]) for _, d, v in near[i]]) + 1e-10) for i in range(len(crowd))}
    lof = {r["id"]: r["lof_score"] for r in neighbours.lof_score(df, "id", ["x0", "x1"], k, cell_rows=cell_rows).collect()}
    for i in range(len(crowd)):
        assert lof[i] == pytest.approx(np.mean([lrd[v] for _, _, v in near[i]]) / lrd[vid[i]], rel=1e-6)


def test_cells_are_cut_again_until_small(spark, monkeypatch):
    """A first sample of forty points: cells are cut in two more rounds, and neighbours stay exact."""
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 40)
    rng = np.random.default_rng(8)
    x = np.round(np.vstack([rng.normal(0, 1, (1500, 2)), rng.normal(9, 0.2, (1000, 2)), rng.uniform(-20, 20, (300, 2))]), 4)
    df, cell_rows, k, rounds = _df(spark, x), 20, 4, []
    grafted = neighbours._grafted
    monkeypatch.setattr(neighbours, "_grafted", lambda *a: rounds.append(len(a[1])) or grafted(*a))
    pts = neighbours.points(df, "id", ["x0", "x1"])
    tree = neighbours._tree(pts, pts.count(), 2, cell_rows, 42)
    assert len(rounds) >= 2
    cells = neighbours._cell_of(np.unique(x, axis=0), tree)
    assert np.bincount(cells).max() <= 2 * cell_rows and sorted(c for c in tree["cell"].tolist() if c >= 0) == list(range(max(tree["cell"]) + 1))
    met = neighbours._cells_met(x[:200], np.full(200, 0.5), tree)
    for i in range(200):
        box = (np.abs(x - x[i]) <= 0.5).all(axis=1)
        assert set(neighbours._cell_of(x[box], tree).tolist()) <= set(met[i])
    got = {r["id"]: r["knn_score"] for r in neighbours.knn_score(df, "id", ["x0", "x1"], k, cell_rows=cell_rows).collect()}
    far = np.sort(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)), axis=1)[:, k]
    assert all(got[i] == pytest.approx(far[i], abs=1e-9) for i in range(len(x)))


@pytest.mark.parametrize("k", [1, 20])
def test_blocks_meet_only_a_stretch_of_a_cell(monkeypatch, k):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 3, (2000, 3)), 1)  # many equal distances
    vids, pairs, squared = rng.permutation(2000), [], neighbours._squared
    monkeypatch.setattr(neighbours, "_squared", lambda a, b: pairs.append(len(a) * len(b)) or squared(a, b))
    row, col, dist = neighbours._nearest(vids, x, vids, x, k, neighbours._reach(x, k))
    assert sum(pairs) < 0.8 * len(x) ** 2
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.array([np.lexsort((vids, d[i]))[:k] for i in range(len(x))])
    assert (row == np.repeat(np.arange(len(x)), k)).all() and (col.reshape(-1, k) == want).all()
    assert np.allclose(dist.reshape(-1, k), np.sqrt(np.take_along_axis(d, want, axis=1)))


def test_neighbours_stay_one_list_a_point(spark, crowd):
    pts, near = neighbours.knn_graph(_df(spark, crowd), "id", ["x0", "x1"], 6, cell_rows=8)
    rows = near.collect()
    assert len(rows) == pts.count() == len({r["vid"] for r in rows})
    for r in rows:
        assert list(r["upto"]) == sorted(set(r["upto"])) and r["upto"][-1] == 6


def test_single_points_and_values_that_are_no_numbers(spark):
    df = _df(spark, np.array([[1.0], [1.0], [1.0]]))
    assert [r["knn_score"] for r in neighbours.knn_score(df, "id", ["x0"], 2).collect()] == [0.0] * 3
    assert [r["lof_score"] for r in neighbours.lof_score(df.limit(1), "id", ["x0"], 2).collect()] == [0.0]
    odd = _df(spark, np.array([[0.0], [1.0], [3.0], [np.nan], [np.inf]]))
    assert {r["id"]: r["knn_score"] for r in neighbours.knn_score(odd, "id", ["x0"], 1).collect()} == {0: 1.0, 1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0}


@pytest.mark.parametrize("dims,eps", [(1, 0.3), (2, 0.5), (3, 0.8)])
def test_dbscan_equals_brute_force(spark, crowd, dims, eps):
    rng = np.random.default_rng(7)
    x = np.hstack([crowd, np.round(rng.normal(0, 0.4, (len(crowd), 1)), 2)])[:, :dims]
    got = {r["id"]: r["is_noise"] for r in neighbours.dbscan_noise(_df(spark, x), "id", [f"x{i}" for i in range(dims)], eps).collect()}
    close = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2) <= eps * eps
    core = close.sum(1) >= 5
    noise = ~(close & core[None, :]).any(1)
    assert [got[i] for i in range(len(x))] == noise.astype(int).tolist()


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (970, 3)), rng.normal(0, 1, (30, 3)) + 9])
    return _df(spark, x)


NAMES = ["x0", "x1", "x2"]


def test_forest_ranks_planted_rows_first(spark, planted):
    scored = forest.score(planted, forest.fit(planted, "id", NAMES), NAMES)
    top = [r["id"] for r in scored.orderBy(F.col("score").desc()).limit(30).collect()]
    assert len([i for i in top if i >= 970]) >= 28
    flagged = forest.flag(scored, 0.1)
    assert flagged.agg(F.sum("is_anomaly")).first()[0] == pytest.approx(100, abs=2)
    r = flagged.agg(F.min("risk_score"), F.max("risk_score")).first()
    assert (r[0], r[1]) == (0.0, 1.0)


def test_forest_is_the_same_for_any_layout(spark, planted):
    a = forest.fit(planted.repartition(1), "id", NAMES, trees=10).orderBy("tree", "node").collect()
    b = forest.fit(planted.repartition(7, "x1"), "id", NAMES, trees=10).orderBy("tree", "node").collect()
    assert a == b


def test_stored_model_scores_alike(spark, planted):
    scaler = models.scaler_table(planted, NAMES)
    scaled = models.apply_scaler(planted, scaler, NAMES)
    nodes = forest.fit(scaled, "id", NAMES, trees=20)
    path = scratch_path(spark, "model")
    models.save_model(path, nodes, scaler, NAMES, version="1")
    n2, s2, meta = models.load_model(spark, path)
    assert meta["version"] == "1" and meta["features"] == "x0,x1,x2"
    a = forest.score(scaled, nodes, NAMES).select("id", "score").orderBy("id").collect()
    b = forest.score(models.apply_scaler(planted, s2, NAMES), n2, NAMES).select("id", "score").orderBy("id").collect()
    assert a == b


def test_ensemble_flags_a_tenth_and_agrees(spark, planted):
    out = ensemble.detect(planted, "id", NAMES)
    assert out.agg(F.sum("is_anomaly")).first()[0] == pytest.approx(100, abs=2)
    assert out.where("id >= 970").agg(F.avg("is_anomaly")).first()[0] == 1.0
    assert out.where("agreement < 0 or agreement > 1").count() == 0


def test_principal_components_keep_variance(spark, planted):
    pcs = ensemble.principal_components(planted, "id", NAMES)
    a = planted.agg(*[F.var_pop(c) for c in NAMES]).first()
    b = pcs.agg(*[F.var_pop(f"pc{i}") for i in (1, 2, 3)]).first()
    assert sum(a) == pytest.approx(sum(b))
    assert b[0] >= b[1] >= b[2]


def test_dictionaries_keep_their_codes(spark):
    from tallyscope.session import scratch_path
    from tallyscope.sources import models

    fitted = spark.createDataFrame([(i, c) for i, c in enumerate(["b", "a", None, "b", "Z"])], "id long, kind string")
    encoders = models.encoder_table(fitted, ["kind"])
    assert {(r.value, r.code) for r in encoders.collect()} == {("Z", 0), ("a", 1), ("b", 2)}
    path = scratch_path(spark, "encoders")
    rows = models.apply_encoders(fitted, encoders, ["kind"])
    models.save_model(path, forest.fit(rows, "id", ["kind_code"], trees=3), models.scaler_table(rows, ["kind_code"]), ["kind_code"], encoders)
    other = spark.createDataFrame([(1, "0 sorts first"), (2, "b"), (3, None), (4, "a")], "id long, kind string")
    got = {r.id: r.kind_code for r in models.apply_encoders(other, models.load_encoders(spark, path), ["kind"]).collect()}
    assert got == {1: -1, 2: 2, 3: -1, 4: 1}
    models.encoder_table(other, ["kind"]).write.mode("overwrite").parquet(f"{path}/encoders")
    with pytest.raises(ValueError, match="fitted with dictionary"):
        models.load_encoders(spark, path)


@pytest.mark.parametrize("name", ["weights", "words", "digits", "quality", "risk", "forest"])
def test_presets_act(spark, name):
    """Each section's query has at least two presets whose rows differ."""
    import tallyscope.plans.catalog  # noqa: F401
    from tallyscope.plans.registry import QUERIES

    rows = {}
    for r in QUERIES[f"d1_preset_{name}"](spark, "/root/testdata/sf0.01").collect():
        row = r.asDict()
        rows.setdefault(row.pop("preset"), []).append(str(sorted(row.items())))
    assert len(rows) == 5 and len({str(sorted(v)) for v in rows.values()}) >= 2
