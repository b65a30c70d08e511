"""SQL of the same plans, as common table expressions for another engine."""

from __future__ import annotations

from ..functions.keyed import POISSON, PRIME

FEATURES = ("x1", "x2")


def number(hexes: str, at: int | str = 0, digits: int = 8) -> str:
    return f"CAST('0x' || substr({hexes}, {at} + 1, {digits}) AS BIGINT)"


def polynomial(c: str, g: str) -> str:
    """The cubic of the hexadecimal digest `c` at `g`, modulo PRIME."""
    w = [f"({number(c, 8 * k)} & {PRIME})" for k in range(4)]
    return f"(((({w[0]} * {g} + {w[1]}) % {PRIME} * {g} + {w[2]}) % {PRIME}) * {g} + {w[3]}) % {PRIME}"


def numbered(rows: str, name: str, group: str, key: str, buckets: int = 64) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {number(f'md5({key})')} % {buckets}, {key}) - 1 AS i FROM {rows})"


def delta(d: int, a: str = "s", b: str = "t", features=FEATURES) -> str:
    gap = " + ".join(f"pow({a}.{f} - {b}.{f}, 2)" for f in features)
    return f"{gap} - {d} * (1.0 / {a}.n + 1.0 / {b}.n)"


def estimates(trials: str, features=FEATURES) -> str:
    avg = ", ".join(f"avg({f}) AS {f}" for f in features)
    return f"""means AS (SELECT case_id, source, is_target, count(*) AS n, {avg} FROM {trials} GROUP BY ALL),
est AS (SELECT s.case_id, s.source, {delta(len(features), features=features)} AS delta FROM means s JOIN means t ON s.case_id = t.case_id AND t.is_target WHERE NOT s.is_target)"""


def poisson(trials: str, replicates: int, seed: int, key: str, features=FEATURES) -> str:
    w = " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in POISSON)
    sums = ", ".join(f"sum(w * {f}) / sum(w) AS {f}" for f in features)
    cols = ", ".join(features)
    c = [f"CAST({number('h', 8 * k)} & {PRIME} AS BIGINT) AS c{k}" for k in range(4)]
    return f"""hs AS (SELECT case_id, source, is_target, {cols}, md5('{seed}|' || {key}) AS h FROM {trials}),
cf AS (SELECT case_id, source, is_target, {cols}, {", ".join(c)} FROM hs),
u AS (SELECT case_id, source, is_target, {cols}, g - 1 AS b, ((((c0 * g + c1) % {PRIME} * g + c2) % {PRIME} * g + c3) % {PRIME}) >> 15 AS u FROM cf, (SELECT unnest(range(1, {replicates} + 1)) AS g)),
w AS (SELECT *, {w} AS w FROM u),
dm AS (SELECT case_id, source, is_target, b, sum(w) AS n, {sums} FROM w WHERE w > 0 GROUP BY ALL),
draws AS (SELECT s.case_id, s.b, s.source, {delta(len(features), features=features)} AS delta FROM dm s JOIN dm t ON s.case_id = t.case_id AND s.b = t.b AND t.is_target WHERE NOT s.is_target)"""


def index_draws(trials: str, replicates: int, seed: int, shared: bool = True, block: int = 1, features=FEATURES) -> str:
    avg = ", ".join(f"avg(x.{f}) AS {f}" for f in features)

    def place(tag: str, source: str) -> str:
        u = polynomial(f"md5('{seed}|{tag}|' || g.case_id || '|' || {source} || '|' || b)", f"(j // {block} + 1)")
        return f"(({u}) % g.n + j % {block}) % g.n"

    t_source = "'-1'" if shared else "g.source"
    t_groups = "SELECT case_id, n FROM ses WHERE is_target" if shared else "SELECT t.case_id, s.source, t.n FROM ses t JOIN ses s ON t.case_id = s.case_id AND NOT s.is_target WHERE t.is_target"
    own = "g.case_id" if shared else "g.case_id, g.source"
    on = "s.case_id = t.case_id AND s.b = t.b" + ("" if shared else " AND s.source = t.source")
    return f"""ses AS (SELECT case_id, source, is_target, count(*) AS n FROM {trials} GROUP BY ALL),
bs AS (SELECT unnest(range({replicates})) AS b),
gs AS (SELECT g.case_id, g.source, g.n, b, unnest(range(g.n)) AS j FROM ses g, bs WHERE NOT g.is_target),
sd AS (SELECT g.case_id, g.source, g.b, g.n, {avg} FROM (SELECT g.*, {place("s", "g.source")} AS i FROM gs g) g JOIN {trials} x ON x.case_id = g.case_id AND x.source = g.source AND x.i = g.i GROUP BY ALL),
gt AS (SELECT g.*, b, unnest(range(g.n)) AS j FROM ({t_groups}) g, bs),
td AS (SELECT {own}, g.b, g.n, {avg} FROM (SELECT g.*, {place("t", t_source)} AS i FROM gt g) g JOIN {trials} x ON x.case_id = g.case_id AND x.is_target AND x.i = g.i GROUP BY ALL),
draws AS (SELECT s.case_id, s.b, s.source, {delta(len(features), features=features)} AS delta FROM sd s JOIN td t ON {on})"""


def system(case: str = "case_id", est: str = "est", draws: str = "draws") -> str:
    return f"""cs AS (SELECT {case}, source, stddev_samp(delta) AS raw_se FROM {draws} GROUP BY ALL),
c0 AS (SELECT {case}, source, delta, raw_se, greatest(raw_se, 1e-12) AS se FROM {est} JOIN cs USING ({case}, source)),
tc AS (SELECT {case}, b, max(abs(d.delta - c.delta) / se) AS t_c FROM {draws} d JOIN c0 c USING ({case}, source) GROUP BY ALL),
p0 AS (SELECT {case}, a.source AS j, z.source AS l, a.delta - z.delta AS d_hat FROM {est} a JOIN {est} z USING ({case}) WHERE a.source <> z.source),
pd AS (SELECT {case}, b, a.source AS j, z.source AS l, a.delta - z.delta AS d FROM {draws} a JOIN {draws} z USING ({case}, b) WHERE a.source <> z.source),
p1 AS (SELECT {case}, j, l, d_hat, raw_se, greatest(raw_se, 1e-12) AS se FROM p0 JOIN (SELECT {case}, j, l, stddev_samp(d) AS raw_se FROM pd GROUP BY ALL) USING ({case}, j, l)),
tdd AS (SELECT {case}, b, max(abs(d - d_hat) / se) AS t_d FROM pd JOIN p1 USING ({case}, j, l) GROUP BY ALL),
q AS (SELECT {case}, quantile_cont(t_c, 0.975) AS q_c, quantile_cont(t_d, 0.975) AS q_d, quantile_cont(greatest(t_c, t_d), 0.95) AS q_j FROM tc JOIN tdd USING ({case}, b) GROUP BY ALL),
comp AS (SELECT {case}, source, delta, raw_se, se, delta - q_c * se AS lower, delta + q_c * se AS upper, delta - q_j * se AS lower_j, delta + q_j * se AS upper_j FROM c0 JOIN q USING ({case})),
cont AS (SELECT {case}, j, l, d_hat, raw_se, se, d_hat - q_d * se AS lower, d_hat - q_j * se AS lower_j FROM p1 JOIN q USING ({case})),
gate AS (SELECT {case}, source, delta, raw_se, se, comp.lower AS lower, upper, comp.lower_j AS lower_j, upper_j, rect, pair, rect_j, pair_j, eb, rect * pair AS ref, rect_j * pair_j AS ref_j FROM (
  SELECT *, CAST(lower <= min(upper) OVER (PARTITION BY {case}) AS INTEGER) AS rect, CAST(lower_j <= min(upper_j) OVER (PARTITION BY {case}) AS INTEGER) AS rect_j,
    CAST(lower <= first_value(upper) OVER (PARTITION BY {case} ORDER BY delta, source) AS INTEGER) AS eb FROM comp) comp
  JOIN (SELECT {case}, j AS source, CAST(max(lower) <= 0 AS INTEGER) AS pair, CAST(max(lower_j) <= 0 AS INTEGER) AS pair_j FROM cont GROUP BY ALL) USING ({case}, source))"""


def stepdown(case: str = "case_id", alpha: float = 0.05) -> str:
    """Every active set tested by its own, without running maxima."""
    return f"""rk AS (SELECT {case}, source, delta, row_number() OVER (PARTITION BY {case} ORDER BY delta, source DESC) AS r FROM est),
ms AS (SELECT {case}, r AS m FROM rk WHERE r > 1),
act AS (SELECT {case}, m, source, delta FROM ms JOIN rk USING ({case}) WHERE r <= m),
crit AS (SELECT {case}, m, quantile_cont(t, {1 - alpha}) AS critical FROM (
  SELECT {case}, m, b, max((d - d_hat) / se) AS t FROM pd JOIN p1 USING ({case}, j, l) JOIN act a USING ({case}) WHERE a.source = j AND EXISTS (SELECT 1 FROM act z WHERE z.{case} = a.{case} AND z.m = a.m AND z.source = l) GROUP BY ALL) GROUP BY ALL),
obs AS (SELECT {case}, m, max(d_hat / se) AS observed FROM (SELECT {case}, m, source AS j FROM act) JOIN (SELECT {case}, m, arg_min(source, (delta, source)) AS l FROM act GROUP BY ALL) USING ({case}, m) JOIN p1 USING ({case}, j, l) GROUP BY ALL),
kept AS (SELECT {case}, max(CASE WHEN observed <= critical THEN m END) AS kept FROM crit JOIN obs USING ({case}, m) GROUP BY ALL),
mcs AS (SELECT {case}, source, CAST(r <= coalesce(kept, 1) AS INTEGER) AS mcs FROM rk LEFT JOIN kept USING ({case}))"""


def simple(radius: float, case: str = "case_id") -> str:
    return f"""simp AS (SELECT {case}, source, CAST(row_number() OVER o <= 1 AS INTEGER) AS top1, CAST(row_number() OVER o <= 3 AS INTEGER) AS top3,
  CAST(delta <= min(delta) OVER p + {radius} AS INTEGER) AS threshold, CAST(delta <= min(delta) OVER p + 0.5 * (max(delta) OVER p - min(delta) OVER p) AS INTEGER) AS midpoint, 1 AS all_sources
  FROM est WINDOW o AS (PARTITION BY {case} ORDER BY delta, source), p AS (PARTITION BY {case}))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
