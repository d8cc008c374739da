"""SQL of the ordered clustering: exact cuts by dynamic programming, silhouettes, choice."""

from __future__ import annotations

from collections.abc import Sequence

from .ctes import cte


def clustering_ctes(
    name: str, values: str, ks: Sequence[int] = (2, 3, 4), min_count: int = 1, min_fraction: float = 0.0, silhouette_min: float = 0.0, near_best: float = 0.0,
    borderline_min: float | None = None, borderline_ratio: float | None = None,
) -> None:
    """Add building blocks for the rows of ``values`` (session_id, x):
    ``{name}_lab`` (session_id, k, x, cnt, label), ``{name}_cen`` (… label, n, c) and
    ``{name}_dia``, the diagnostics per (session_id, k) with the selected one marked."""
    last = max(ks)
    squares = "(b.s - a.s) * (b.s - a.s) / (b.n - a.n)"
    blocks = {
        f"{name}_pre": f"""SELECT session_id, x, cnt, row_number() OVER o AS i, sum(cnt) OVER o AS n, sum(cnt * (x - m)) OVER o AS s FROM (
            SELECT session_id, x, count(*) AS cnt, any_value(m) AS m FROM (SELECT session_id, x, avg(x) OVER (PARTITION BY session_id) AS m FROM ({values}) WHERE x IS NOT NULL) GROUP BY 1, 2)
            WINDOW o AS (PARTITION BY session_id ORDER BY x)""",
        f"{name}_d1": f"SELECT session_id, i, s * s / n AS g, CAST([] AS BIGINT[]) AS c FROM {name}_pre",
    }
    for k in range(2, last + 1):
        blocks[f"{name}_d{k}"] = f"""SELECT session_id, i, max(g) AS g, arg_max(c, (g, -cut_at)) AS c FROM (
            SELECT b.session_id, b.i, a.i AS cut_at, d.g + {squares} AS g, list_append(d.c, a.i) AS c FROM {name}_d{k - 1} d
            JOIN {name}_pre a USING (session_id, i) JOIN {name}_pre b ON b.session_id = a.session_id AND b.i > a.i) GROUP BY 1, 2"""
    best = " UNION ALL ".join(f"SELECT session_id, CAST({k} AS INT) AS k, arg_max(c, i) AS c FROM {name}_d{k} GROUP BY 1" for k in ks)
    blocks[f"{name}_lab"] = f"SELECT p.session_id, m.k, p.x, p.cnt, CAST(1 + len(list_filter(m.c, lambda q: q < p.i)) AS INT) AS label FROM {name}_pre p JOIN ({best}) m USING (session_id)"
    blocks[f"{name}_cen"] = f"SELECT session_id, k, label, sum(cnt) AS n, sum(cnt * x) / sum(cnt) AS c FROM {name}_lab GROUP BY ALL"
    blocks[f"{name}_sil"] = f"""SELECT session_id, k, sum(cnt * CASE WHEN own <= 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) / sum(cnt) AS silhouette FROM (
        SELECT session_id, k, x, any_value(cnt) AS cnt, max(CASE WHEN bl = label THEN nb END) AS own, max(CASE WHEN bl = label AND nb > 1 THEN d / (nb - 1) END) AS a, min(CASE WHEN bl <> label THEN d / nb END) AS b FROM (
          SELECT a.session_id, a.k, a.x, a.label, b.label AS bl, any_value(a.cnt) AS cnt, sum(b.cnt * abs(a.x - b.x)) AS d, sum(b.cnt) AS nb
          FROM {name}_lab a JOIN {name}_lab b USING (session_id, k) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    border = "false"
    if borderline_min is not None:
        border = f"coalesce(score >= {borderline_min} AND score < {silhouette_min} AND ratio >= {borderline_ratio}, false)"
    blocks[f"{name}_dia"] = f"""SELECT *, coalesce(k = min(CASE WHEN accepted AND score >= round(top - {near_best}, 12) THEN k END) OVER (PARTITION BY session_id), false) AS selected FROM (
        SELECT *, max(CASE WHEN accepted THEN score END) OVER (PARTITION BY session_id) AS top FROM (
         SELECT *, valid AND (strong OR border) AS accepted, CASE WHEN valid AND strong THEN 'strong' WHEN valid AND border THEN 'borderline' WHEN ratio IS NOT NULL THEN 'rejected' END AS tier FROM (
          SELECT *, coalesce(least_n >= required, false) AS valid, coalesce(score >= {silhouette_min}, false) AS strong, {border} AS border FROM (
           SELECT t.session_id, t.k, t.required, z.least_n, z.ratio, s.silhouette, round(s.silhouette, 12) AS score FROM (
             SELECT session_id, unnest([{', '.join(map(str, ks))}]) AS k, greatest({min_count}, CAST(ceil(sum(cnt) * {min_fraction}) AS INT)) AS required, sum(cnt) AS total FROM {name}_pre GROUP BY 1) t
           LEFT JOIN (SELECT session_id, k, min(n) AS least_n, min(exp(c - before)) AS ratio FROM (SELECT *, lag(c) OVER (PARTITION BY session_id, k ORDER BY label) AS before FROM {name}_cen) GROUP BY 1, 2) z USING (session_id, k)
           LEFT JOIN {name}_sil s USING (session_id, k) WHERE t.total > t.k))))"""
    cte(**blocks)
