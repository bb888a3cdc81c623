"""SQL that grows and reads the same isolation forest as ``operators.forest``, level by level."""

from __future__ import annotations

TREES, SIZE, SEED = 100, 256, 42
LEVELS = 8


def _draw(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _mean_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} END"


def forest_sql(width: int, fitted: str = "pts", read: str = "pts", trees: int = TREES) -> str:
    """CTEs up to ``iso (id, score)``; ``fitted`` and ``read`` are CTEs of ``(id, xs)`` with a list of ``width`` doubles."""
    lists = lambda f: "[" + ", ".join(f"{f}(xs[{i + 1}])" for i in range(width)) + "]"
    out = [
        f"fsh AS (SELECT {2.0 * SIZE * trees}::DOUBLE / greatest(count(*), 1) AS keep, least({trees}, ceil({2.0 * SIZE * trees}::DOUBLE / greatest(count(*), 1)))::BIGINT AS offers FROM {fitted})",
        f"fof AS (SELECT id, xs, floor({_draw(f"'{SEED}:first:' || id")} * {trees})::BIGINT AS f0, unnest(range(0, offers)) AS j FROM {fitted}, fsh WHERE {_draw(f"'{SEED}:keep:' || id")} < keep)",
        f"fot AS (SELECT id, xs, (f0 + j) % {trees} AS tree FROM fof)",
        f"frk AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY md5('{SEED}:' || tree || ':' || id), id) AS r FROM fot)",
        f"fl0 AS (SELECT id, xs, tree, 1::BIGINT AS node, ceil(log2(greatest(count(*) OVER (PARTITION BY tree), 2))) AS most FROM frk WHERE r <= {SIZE})",
    ]
    for i in range(LEVELS + 1):
        out += [
            f"fa{i} AS (SELECT tree, node, count(*) AS n, any_value(most) AS most, {lists('min')} AS lo, {lists('max')} AS hi FROM fl{i} GROUP BY tree, node)",
            f"fb{i} AS (SELECT *, list_filter({list(range(1, width + 1))}, lambda f: hi[f] > lo[f]) AS op FROM fa{i})",
            f"fc{i} AS (SELECT *, CASE WHEN {i} < most AND len(op) > 0 THEN op[floor({_draw(f"'{SEED}:' || tree || ':' || node || ':feature'")} * len(op))::BIGINT + 1] ELSE 0 END AS feature FROM fb{i})",
            f"fd{i} AS (SELECT *, CASE WHEN feature > 0 THEN lo[feature] + {_draw(f"'{SEED}:' || tree || ':' || node || ':cut'")} * (hi[feature] - lo[feature]) END AS c0 FROM fc{i})",
            f"fn{i} AS (SELECT tree, node, n, feature, CASE WHEN c0 <= lo[feature] THEN hi[feature] ELSE c0 END AS cut, round(({i} + {_mean_path('n')}) * 1e9)::BIGINT AS length FROM fd{i})",
        ]
        if i < LEVELS:
            out.append(f"fl{i + 1} AS (SELECT l.id, l.xs, l.tree, 2 * l.node + CASE WHEN l.xs[t.feature] < t.cut THEN 0 ELSE 1 END AS node, l.most FROM fl{i} l JOIN fn{i} t USING (tree, node) WHERE t.feature > 0)")
    out += [
        "fnd AS (" + " UNION ALL ".join(f"SELECT * FROM fn{i}" for i in range(LEVELS + 1)) + ")",
        f"fg0 AS (SELECT id, xs, tree, 1::BIGINT AS node FROM {read}, (SELECT unnest(range(0, {trees})) AS tree))",
    ]
    for i in range(LEVELS):
        out.append(
            f"fg{i + 1} AS (SELECT g.id, g.xs, g.tree, CASE WHEN t.feature = 0 THEN g.node ELSE 2 * g.node + CASE WHEN g.xs[t.feature] < t.cut THEN 0 ELSE 1 END END AS node FROM fg{i} g JOIN fnd t USING (tree, node))"
        )
    root = f"(SELECT sum(round({_mean_path('n')} * 1e9)::BIGINT)::DOUBLE / 1e9 / count(*) FROM fn0)"
    out.append(f"iso AS (SELECT g.id, pow(2.0::DOUBLE, -(sum(t.length)::DOUBLE / 1e9 / {trees} / {root})) AS score FROM fg{LEVELS} g JOIN fnd t USING (tree, node) GROUP BY g.id)")
    return ",\n".join(out)


#: Flags of ``forest.flag`` on ``iso``.
FLAG_SQL = """
    icut AS (SELECT quantile_cont(score, 0.9) AS c, min(score) AS lo, max(score) AS hi FROM iso),
    flg AS (SELECT id, score, (score > c)::INT AS is_anomaly, c - score AS decision, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS risk_score FROM iso, icut)
"""
