"""The clustering of voices in plain SQL: every step of the iteration is a table of its own."""

from __future__ import annotations

_UNIT = """unit AS MATERIALIZED (
  SELECT vec_id % 20 AS video_id, vec_id AS index, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9)) AS u FROM embeddings)"""


def kmeans_sql(k: int, steps: int = 50) -> str:
    """Seeds farthest from all earlier ones, then ``steps`` rounds; a settled state stays as it is."""
    parts = [_UNIT, "seed0 AS MATERIALIZED (SELECT video_id, min(index) AS index FROM unit GROUP BY video_id)"]
    parts.append("near0 AS MATERIALIZED (SELECT a.video_id, a.index, list_dot_product(a.u, b.u) AS near FROM unit a JOIN seed0 s USING (video_id) JOIN unit b ON b.index = s.index)")
    for j in range(1, k):
        parts.append(f"seed{j} AS MATERIALIZED (SELECT video_id, arg_min(index, (-(1.0 - near), index)) AS index FROM near{j - 1} GROUP BY video_id)")
        parts.append(f"near{j} AS MATERIALIZED (SELECT n.video_id, n.index, greatest(near, list_dot_product(a.u, b.u)) AS near FROM near{j - 1} n JOIN unit a ON a.index = n.index JOIN seed{j} s ON s.video_id = n.video_id JOIN unit b ON b.index = s.index)")
    seeds = " UNION ALL ".join(f"SELECT s.video_id, {j} AS j, u AS c FROM seed{j} s JOIN unit ON unit.index = s.index" for j in range(k))
    parts.append(f"centre0 AS MATERIALIZED ({seeds})")
    for t in range(steps):
        parts.append(f"label{t} AS MATERIALIZED (SELECT u.video_id, u.index, any_value(u.u) AS u, arg_min(j, (-list_dot_product(u.u, c), j)) AS label FROM unit u JOIN centre{t} USING (video_id) GROUP BY u.video_id, u.index)")
        if t + 1 < steps:
            parts.append(f"""centre{t + 1} AS MATERIALIZED (
  SELECT o.video_id, o.j, CASE WHEN m.c IS NULL THEN o.c ELSE list_transform(m.c, lambda x: x / (sqrt(list_dot_product(m.c, m.c)) + 1e-9)) END AS c FROM centre{t} o LEFT JOIN (
    SELECT video_id, label, list(x ORDER BY d) AS c FROM (SELECT video_id, label, d, avg(x) AS x FROM (SELECT video_id, label, unnest(u) AS x, unnest(range(len(u))) AS d FROM label{t}) GROUP BY ALL) GROUP BY ALL
  ) m ON m.video_id = o.video_id AND m.label = o.j)""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT video_id, index, label::INT AS label, 'SPK' || label AS speaker FROM label{steps - 1}"


def linkage_sql(threshold: float, steps: int = 30) -> str:
    """Up to ``steps`` merges of the two clusters with the highest mean similarity, as long as it is high enough."""
    parts = [_UNIT, "pair AS MATERIALIZED (SELECT a.video_id, a.index AS x, b.index AS y, list_dot_product(a.u, b.u) AS s FROM unit a JOIN unit b USING (video_id))"]
    parts.append("own0 AS MATERIALIZED (SELECT video_id, index, index AS owner FROM unit)")
    for t in range(steps):
        parts.append(f"""best{t} AS MATERIALIZED (
  SELECT video_id, arg_min((i, j), (-m, i, j)) AS p, max(m) AS m FROM (
    SELECT p.video_id, a.owner AS i, b.owner AS j, avg(s) AS m FROM pair p JOIN own{t} a ON a.index = x JOIN own{t} b ON b.index = y WHERE a.owner < b.owner GROUP BY ALL) GROUP BY video_id)""")
        parts.append(f"own{t + 1} AS MATERIALIZED (SELECT o.video_id, o.index, CASE WHEN b.m >= {threshold} AND o.owner = b.p[2] THEN b.p[1] ELSE o.owner END AS owner FROM own{t} o LEFT JOIN best{t} b USING (video_id))")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT video_id, index, label::INT AS label, 'SPK' || label AS speaker FROM (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY owner) - 1 AS label FROM own{steps})"""
    )
