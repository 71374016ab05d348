"""SQL texts shared by the oracles: adapter, timeline and test statistics."""

from __future__ import annotations


def r(expr: str) -> str:
    """Six digits, half away from zero on the decimal text of the number."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 9)), 6) AS DOUBLE)"


def rd(expr: str, digits: int) -> str:
    """Report rounding, half away from zero on the decimal text of the number."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"


def i(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


EV = """
ev AS (
  SELECT entity, event_id, ts, mode, k, CAST(k % 2 AS INTEGER) AS win,
    CASE WHEN event_id % 23 <> 0 THEN least(value, 100.0) END AS metric,
    CASE WHEN event_id % 29 <> 0 THEN CAST(k AS DOUBLE) END AS metric2,
    CASE WHEN event_id % 31 <> 0 THEN (event_id % 41 - 20) / 10.0::DOUBLE END AS level,
    CASE WHEN event_id % 17 <> 0 THEN CASE WHEN k % 2 = 1 OR event_id % 37 = 0 THEN 30 ELSE -30 END END AS change,
    6000 + 40 * (entity % 100) AS current_rating,
    k % 4 AS score_for, (k // 4) % 4 AS score_against,
    value % 7 AS leak_for, (event_id % 70) / 10.0::DOUBLE AS leak_against,
    (entity * 131 + (ts // 259200) * 17 + CASE WHEN k % 10 = 0 THEN 7 ELSE 0 END) % (SELECT count(*) FROM orders) AS deck,
    event_id * 11 % (SELECT count(*) FROM orders) AS opp_deck,
    event_id * 13 % 1000 AS opponent
  FROM (
    SELECT user_id AS entity, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value,
      CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'Ladder' WHEN event_type = 'signup' THEN 'Ranked' ELSE 'Other' END AS mode,
      CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
    FROM events)
)"""

DECKS = """
decks AS (SELECT o_orderkey AS deck, o_orderpriority || '|' || o_orderstatus AS archetype FROM orders)"""

ITEMS = """
deck_items AS (
  SELECT l_orderkey AS deck, l_partkey AS item, max(l_quantity) AS level,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS evo, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS hero
  FROM lineitem GROUP BY 1, 2)"""

LIMITS = (
    0, 300, 600, 1000, 1300, 1600, 2000, 2300, 2600, 3000, 3400, 3800, 4200, 4600, 5000, 5500, 6000, 6500,
    7000, 7500, 8000, 8500, 9000, 9500, 10000, 10500, 11000, 11500,
)
THRESHOLDS = "thr AS (SELECT unnest([" + ", ".join(map(str, LIMITS)) + "]) AS lim)"

REGION = """
rg AS (
  SELECT n_nationkey AS nation, n_regionkey AS region,
    CASE n_regionkey WHEN 0 THEN 2 WHEN 1 THEN -5 WHEN 2 THEN 9 WHEN 3 THEN 1 WHEN 4 THEN 4 END AS shift_h
  FROM nation)"""

NEXT = ("metric", "metric2", "level", "win", "mode", "rating_before", "deck", "opp_deck")
PREV = ("win", "metric", "metric2", "level", "deck")


def tl(mode: str = "all", gap: int = 43200, long: int = 86400, quit: int = 172800, base: str = "") -> str:
    """CTE chain ending in ``tl``: the timeline with sessions and neighbours."""
    keep = {
        "all": "TRUE",
        "Ladder": "mode = 'Ladder'",
        "Ranked": "mode = 'Ranked'",
        "Ladder_Ranked": "mode IN ('Ladder', 'Ranked')",
    }[mode]
    nxt = ", ".join(f"lead({c}) OVER sw AS next_{c}" for c in NEXT)
    prv = ", ".join(
        f"lag({c}, {k}) OVER sw AS prev{'' if k == 1 else k}_{c}" for k in (1, 2, 3) for c in PREV
    )
    return f"""{EV},
rt0 AS (
  SELECT *, CASE WHEN mode = 'Ladder' THEN CASE WHEN win = 0 AND change > 0 THEN 0 ELSE coalesce(change, 0) END ELSE 0 END AS step
  FROM ev),
rt1 AS (
  SELECT *, current_rating - coalesce(sum(step) OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after0 FROM rt0),
rt AS (
  SELECT * EXCLUDE (step, after0), CASE WHEN mode = 'Ladder' THEN CAST(after0 AS BIGINT) END AS rating_after,
    CASE WHEN mode = 'Ladder' THEN CAST(after0 - step AS BIGINT) END AS rating_before,
    CASE WHEN mode = 'Ladder' THEN step END AS variation FROM rt1),
gp AS (
  SELECT *, ts - lag(ts) OVER w AS prev_gap, lead(ts) OVER w - ts AS next_gap, row_number() OVER w AS rn
  FROM rt WHERE {keep} WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
ss AS (
  SELECT *, (prev_gap IS NULL OR prev_gap >= {gap}) AS is_start, (next_gap IS NULL OR next_gap >= {gap}) AS is_last,
    CAST(sum(CASE WHEN prev_gap IS NULL OR prev_gap >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, event_id) AS BIGINT) AS session_no
  FROM gp),
tl0 AS (
  SELECT *, row_number() OVER sw AS pos, count(*) OVER (PARTITION BY entity, session_no) AS n,
    max(CASE WHEN is_last THEN next_gap END) OVER (PARTITION BY entity, session_no) AS break_s,
    lead(1) OVER sw IS NOT NULL AS has_next, lag(1) OVER sw IS NOT NULL AS has_prev,
    lag(1, 2) OVER sw IS NOT NULL AS has_prev2, lag(1, 3) OVER sw IS NOT NULL AS has_prev3, {nxt}, {prv}
  FROM ss WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id)),
tl AS (
  SELECT *, CASE WHEN break_s IS NULL THEN 'End' WHEN break_s >= {quit} THEN 'Quit' WHEN break_s >= {long} THEN 'Long' ELSE 'Short' END AS stop_type
  FROM tl0)"""


def streaks(source: str = "tl") -> str:
    """CTE chain ``sk``: streaks, stress and counter streak per event of ``source``."""
    return f"""sk0 AS (
  SELECT *, rn - max(CASE WHEN win = 0 THEN rn WHEN is_start THEN rn - 1 END) OVER sw AS win_streak,
    rn - max(CASE WHEN win = 1 THEN rn WHEN is_start THEN rn - 1 END) OVER sw AS loss_streak,
    CASE WHEN win = 0 AND metric < 45 THEN 1 ELSE 0 END AS hit
  FROM {source} WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id)),
sk1 AS (
  SELECT *, coalesce(lag(win_streak - loss_streak) OVER sw, 0) AS streak_before,
    CASE WHEN win = 1 THEN -2.0 * win_streak ELSE 1.0 + CASE WHEN metric < 45 THEN 0.5 ELSE 0.0 END + CASE WHEN metric < 35 THEN 0.5 ELSE 0.0 END END AS inc,
    sum(hit) OVER sw AS hits
  FROM sk0 WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id)),
sk2 AS (
  SELECT *, sum(inc) OVER sw AS s,
    hits - max(CASE WHEN win = 1 OR metric >= 45 THEN hits WHEN is_start THEN hits - hit END) OVER sw AS counter_streak
  FROM sk1 WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id)),
sk3 AS (
  SELECT *, CAST(s - least(0, min(s) OVER sw) AS DOUBLE) AS stress_after
  FROM sk2 WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id)),
sk AS (
  SELECT *, coalesce(lag(stress_after) OVER sw, 0) AS stress_before
  FROM sk3 WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id))"""


def sessions(source: str = "tl") -> str:
    """CTE ``sm``: one row per session with its summary."""
    ok = "(metric IS NOT NULL AND mode IN ('Ladder', 'Ranked'))"
    ok2 = "(metric2 IS NOT NULL AND mode IN ('Ladder', 'Ranked'))"
    return f"""sm AS (
  SELECT entity, session_no, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts,
    max(break_s) AS break_s, max(stop_type) AS stop_type,
    count(*) FILTER ({ok}) AS n_valid,
    coalesce(avg(metric) FILTER ({ok}), 0) AS avg_metric, coalesce(avg(metric2) FILTER ({ok2}), 0) AS avg_metric2,
    coalesce(stddev_samp(metric) FILTER ({ok}), 0) AS sd_metric, coalesce(stddev_samp(metric2) FILTER ({ok2}), 0) AS sd_metric2,
    CASE WHEN count(*) FILTER ({ok}) > 0 THEN coalesce(sum(level), 0) / count(*) FILTER ({ok}) ELSE 0 END AS avg_level,
    count(*) FILTER ({ok} AND (metric > 80 OR metric < 40)) AS n_extreme,
    coalesce(avg(win) FILTER ({ok}), 0) AS win_rate, coalesce(avg(1 - win) FILTER ({ok}), 0) AS loss_rate,
    coalesce(avg(win) FILTER ({ok} AND metric < 40), 0) AS win_when_low,
    coalesce(avg(1 - win) FILTER ({ok} AND metric > 80), 0) AS loss_when_high
  FROM {source} GROUP BY entity, session_no)"""


def profile() -> str:
    """CTE ``pf``: one row per entity, from ``sk``."""
    weight = "CASE stop_type WHEN 'Short' THEN 1.0 WHEN 'Long' THEN 2.5 WHEN 'Quit' THEN 5.0 ELSE 0.0 END"
    quits = "(is_last AND win = 0 AND stop_type <> 'End')"
    return f"""pf0 AS (
  SELECT entity, count(*) AS total_events, max(session_no) AS sessions,
    coalesce(sum(prev_gap) FILTER (NOT is_start), 0) AS play_s,
    count(*) FILTER (win = 0) AS losses, count(*) FILTER (win = 1) AS wins,
    coalesce(sum(({weight}) / stress_after) FILTER {quits}, 0) AS sens, count(*) FILTER {quits} AS quits,
    count(*) FILTER (win = 1 AND NOT is_last) AS win_cont, count(*) FILTER (win = 0 AND NOT is_last) AS loss_cont,
    count(*) FILTER (win = 0 AND NOT is_last AND loss_streak >= 2) AS l_streak_count,
    count(*) FILTER (win = 0 AND NOT is_last AND counter_streak >= 2) AS counter_streak_continuations,
    coalesce(max(loss_streak) FILTER (win = 0 AND NOT is_last), 0) AS max_loss_streak_tolerated,
    coalesce(avg(metric), 50.0) AS m1, coalesce(avg(metric2), 50.0) AS m2, coalesce(avg(level), 0.0) AS lv
  FROM sk GROUP BY entity),
pf1 AS (SELECT *, CASE WHEN losses > 0 THEN sens / losses ELSE 0.0 END AS fsi0, CASE WHEN quits > 0 THEN sens / quits ELSE 0.0 END AS imp0 FROM pf0),
pf AS (
  SELECT entity, total_events, sessions, {rd('fsi0', 3)} AS fsi, {rd('imp0', 3)} AS impulsivity, {rd('imp0 * exp(-fsi0)', 3)} AS ers,
    {rd('play_s / 60.0::DOUBLE / sessions', 2)} AS avg_session_min, {rd('total_events::DOUBLE / sessions', 2)} AS events_per_session,
    l_streak_count, CAST(max_loss_streak_tolerated AS BIGINT) AS max_loss_streak_tolerated,
    CASE WHEN wins > 0 THEN {rd('win_cont * 100.0::DOUBLE / wins', 1)} ELSE 0.0 END AS win_continuation_pct,
    CASE WHEN losses > 0 THEN {rd('loss_cont * 100.0::DOUBLE / losses', 1)} ELSE 0.0 END AS loss_continuation_pct,
    {rd('wins * 100.0::DOUBLE / total_events', 1)} AS win_pct, {rd('m1', 2)} AS avg_metric, {rd('m2', 2)} AS avg_metric2, {rd('lv', 2)} AS avg_level,
    total_events > 50 AS is_reliable, counter_streak_continuations
  FROM pf1)"""


# --- tails -----------------------------------------------------------------


def normal_sf(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.2316419 * abs({z})))"
    poly = (
        f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    )
    upper = f"(0.3989422804014327 * exp(-({z}) * ({z}) / 2) * {poly})"
    return f"(CASE WHEN ({z}) >= 0 THEN {upper} WHEN ({z}) < 0 THEN 1 - {upper} END)"


def beta_inc(a: str, b: str, x: str, terms: int = 2000) -> str:
    """I_x(a, b) by its positive power series; for x up to one half or small a."""
    lead = f"exp(lgamma(({a}) + ({b})) - lgamma(({a}) + 1) - lgamma({b}) + ({a}) * ln({x}) + ({b}) * ln(1 - ({x})))"
    body = (
        f"list_sum(list_transform(range(0, {terms}), lambda q: exp(lgamma(({a}) + ({b}) + q) - lgamma(({a}) + ({b}))"
        f" + lgamma(({a}) + 1) - lgamma(({a}) + 1 + q) + q * ln({x}))))"
    )
    return f"({lead} * {body})"


def student_p2(t: str, df: str) -> str:
    """Two-sided Student tail."""
    x, y = f"(({df}) / (({df}) + ({t}) * ({t})))", f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    return (
        f"(CASE WHEN ({t}) IS NULL OR ({df}) IS NULL OR ({df}) <= 0 THEN NULL WHEN ({t}) = 0 THEN 1.0"
        f" WHEN isinf({t}) OR abs({t}) > 38 AND ({df}) > 30 THEN 0.0"
        f" WHEN {x} < 0.5 THEN {beta_inc(f'({df}) / 2.0', '0.5', x, 400)}"
        f" ELSE 1 - {beta_inc('0.5', f'({df}) / 2.0', y)} END)"
    )


def f_sf(f: str, d1: str, d2: str) -> str:
    y = f"(({d1}) * ({f}) / (({d2}) + ({d1}) * ({f})))"
    return f"(1 - {beta_inc(f'({d1}) / 2.0', f'({d2}) / 2.0', y)})"


def chi2_sf(x: str, df: str) -> str:
    a = f"(({df}) / 2.0)"
    h = f"(({x}) / 2.0)"
    return (
        f"(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 3000), "
        f"lambda q: exp(-{h} + ({a} + q) * ln({h}) - lgamma({a} + q + 1))))) END)"
    )


def choose(n: str, k: str) -> str:
    return f"(lgamma(CAST(({n}) AS DOUBLE) + 1) - lgamma(CAST(({k}) AS DOUBLE) + 1) - lgamma(CAST(({n}) AS DOUBLE) - ({k}) + 1))"


def binomial_sf(k: str, n: str, p: str) -> str:
    return (
        f"(CASE WHEN ({k}) <= 0 THEN 1.0 ELSE list_sum(list_transform(range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1), "
        f"lambda q: exp({choose(n, 'q')} + q * ln({p}) + (({n}) - q) * ln(1 - ({p}))))) END)"
    )


def fisher_sf(a: str, b: str, c: str, d: str) -> str:
    r1, r2, c1 = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    top = f"least({r1}, {c1})"
    return (
        f"(CASE WHEN least({r1}, {r2}, {c1}, {b} + {d}) = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range({a}, {top} + 1), "
        f"lambda q: exp({choose(r1, 'q')} + {choose(r2, f'({c1} - q)')} - {choose(f'{r1} + {r2}', c1)})))) END)"
    )


# --- tests -----------------------------------------------------------------


def mwu(source: str, keys: list[str], group: str, value: str, a: str, b: str, alternative: str, min_n: int = 1) -> str:
    """SELECT text of a Mann-Whitney test over rows (keys, group, value) of ``source``."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    part_v = f"PARTITION BY {', '.join([*keys, 'v'])}"
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    k = "".join(f"{c}, " for c in keys)
    tested = {"greater": "u", "less": "n1 * n2 - u"}.get(alternative, "greatest(u, n1 * n2 - u)")
    z = f"(({tested}) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1.0))))"
    p = normal_sf("z") if alternative != "two-sided" else f"least(1.0, 2 * {normal_sf('z')})"
    return f"""SELECT {k}{i('n1')} AS n1, {i('n2')} AS n2, {r('mean1')} AS mean1, {r('mean2')} AS mean2, {r('u')} AS u, {r('z')} AS z, {r(p)} AS p
FROM (SELECT *, {z} AS z FROM (
  SELECT {k}n1, n2, mean1, mean2, r1 - n1 * (n1 + 1) / 2.0 AS u, tt FROM (
    SELECT {k}CAST(count(*) FILTER (g = {a}) AS DOUBLE) AS n1, CAST(count(*) FILTER (g = {b}) AS DOUBLE) AS n2,
      avg(v) FILTER (g = {a}) AS mean1, avg(v) FILTER (g = {b}) AS mean2, sum(rk) FILTER (g = {a}) AS r1,
      sum(CAST(c AS DOUBLE) * c - 1) AS tt
    FROM (SELECT *, rank() OVER ({part} ORDER BY v) + (count(*) OVER ({part_v}) - 1) / 2.0 AS rk, count(*) OVER ({part_v}) AS c
      FROM (SELECT {k}{group} AS g, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL AND {group} IN ({a}, {b}))) {by}))
  WHERE n1 >= {min_n} AND n2 >= {min_n})"""


def spearman(source: str, keys: list[str], x: str, y: str, min_n: int = 2) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    pk = ", ".join(keys) + ", " if keys else ""
    k = "".join(f"{c}, " for c in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    t = "(rho * sqrt((n - 2) / (1 - rho * rho)))"
    p = f"CASE WHEN n <= 2 OR rho IS NULL THEN NULL WHEN abs(rho) >= 1 - 1e-14 THEN 0.0 ELSE {student_p2(t, '(n - 2)')} END"
    return f"""SELECT {k}{i('n')} AS n, {r('rho')} AS rho, {r(p)} AS p FROM (
  SELECT {k}count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM (
    SELECT {k}rank() OVER ({part} ORDER BY x) + (count(*) OVER (PARTITION BY {pk}x) - 1) / 2.0 AS rx,
      rank() OVER ({part} ORDER BY y) + (count(*) OVER (PARTITION BY {pk}y) - 1) / 2.0 AS ry
    FROM (SELECT {k}CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)) {by})
  WHERE n >= {min_n}"""


def permutation(source: str, keys: list[str], x: str, y: str, unique: str, reps: int, seed: int = 7, min_n: int = 2) -> str:
    """Rank correlation and its share of ``reps`` keyed bijections that reach it, replicate by replicate."""
    from seqtide.operators.permutation import PRIME, ROUNDS

    k, part = "".join(f"{c}, " for c in keys), f"PARTITION BY {', '.join(keys)}" if keys else ""
    pk, by = ", ".join(keys) + ", " if keys else "", f"GROUP BY {', '.join(keys)}" if keys else ""
    join = f"USING ({', '.join(keys)})" if keys else "ON TRUE"

    def mixed(c: str, key: str) -> str:
        u = f"(({c} + {key}) % {PRIME})"
        return f"((((({u} * {u}) % {PRIME}) * (({u} * {u}) % {PRIME})) % {PRIME}) * {u} % {PRIME})"

    def once(rows: str) -> str:
        out = f"SELECT * EXCLUDE (v), v // b AS l, v % b AS r FROM ({rows})"
        for j in range(0, ROUNDS, 2):
            out = f"SELECT * REPLACE ((l + {mixed('r', f'k{j}')}) % a AS l) FROM ({out})"
            out = f"SELECT * REPLACE ((r + {mixed('l', f'k{j + 1}')}) % b AS r) FROM ({out})"
        return f"SELECT * EXCLUDE (l, r), l * b + r AS v FROM ({out})"

    round_keys = ", ".join(f"('0x' || substr(md5('{seed}|' || rep || '|{j}'), 1, 8))::BIGINT % {PRIME} AS k{j}" for j in range(ROUNDS))
    cols = f"{k}rep, place, x, n, a, b, {', '.join(f'k{j}' for j in range(ROUNDS))}"
    return f"""(WITH RECURSIVE pr AS (SELECT {k}{unique} AS u, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, count(*) OVER ({part}) AS n FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
  rr AS (SELECT {k}n, row_number() OVER ({part} ORDER BY u) - 1 AS place, CAST(2 * rank() OVER ({part} ORDER BY x) + count(*) OVER (PARTITION BY {pk}x) - n - 2 AS BIGINT) AS x,
    CAST(2 * rank() OVER ({part} ORDER BY y) + count(*) OVER (PARTITION BY {pk}y) - n - 2 AS BIGINT) AS y, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM pr WHERE n >= {min_n}),
  gr AS (SELECT *, (n + a - 1) // a AS b FROM rr),
  ky AS (SELECT rep, {round_keys} FROM range(1, {reps + 1}) AS t(rep)),
  st AS (SELECT {cols}, place AS v FROM gr, ky),
  wk AS (SELECT {cols}, v FROM ({once('SELECT * FROM st')}) UNION ALL SELECT {cols}, v FROM ({once('SELECT * FROM wk WHERE v >= n')})),
  sm AS (SELECT {k}rep, sum(wk.x * gr.y) AS s FROM wk JOIN (SELECT {k}place AS v, y FROM gr) gr USING ({k}v) WHERE v < n GROUP BY {k}rep),
  ob AS (SELECT {k}count(*) AS n, sum(x * y) AS o, sum(x * x) AS xx, sum(y * y) AS yy FROM gr {by})
  SELECT {k}{i('any_value(n)')} AS n, count(*) AS reps, {r('any_value(CASE WHEN xx > 0 AND yy > 0 THEN o / sqrt(CAST(xx AS DOUBLE) * yy) END)')} AS rho, count(*) FILTER (abs(s) >= abs(o)) AS extreme,
    {r('count(*) FILTER (abs(s) >= abs(o)) / count(*)')} AS p FROM sm JOIN ob {join} {by})"""


def kruskal(source: str, keys: list[str], group: str, value: str, min_n: int = 1) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    k = "".join(f"{c}, " for c in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}{i('groups')} AS groups, {i('n')} AS n, {r('h')} AS h, {r(chi2_sf('h', '(groups - 1)'))} AS p FROM (
  SELECT {k}groups, n, (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tt / (n * n * n - n)) AS h FROM (
    SELECT {k}count(*) AS groups, CAST(sum(gn) AS DOUBLE) AS n, sum(rs * rs / gn) AS s, sum(tg) AS tt FROM (
      SELECT {k}g, CAST(count(*) AS DOUBLE) AS gn, sum(rk) AS rs, sum(CAST(c AS DOUBLE) * c - 1) AS tg FROM (
        SELECT {k}g, rank() OVER ({part} ORDER BY v) + (count(*) OVER (PARTITION BY {k}v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {k}v) AS c
        FROM (SELECT *, count(*) OVER (PARTITION BY {k}g) AS gc FROM (SELECT {k}{group} AS g, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL AND {group} IS NOT NULL))
        WHERE gc >= {min_n}) GROUP BY {k}g) {by}) WHERE groups > 1)"""


def levene(source: str, keys: list[str], group: str, value: str, min_n: int = 1) -> str:
    k = "".join(f"{c}, " for c in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}{i('groups')} AS groups, {i('n')} AS n, {r('w')} AS w, {r(f_sf('w', '(groups - 1)', '(n - groups)'))} AS p FROM (
  SELECT {k}groups, n, (n - groups) * (bz - sz * sz / n) / ((groups - 1) * (szz - bz)) AS w FROM (
    SELECT {k}count(*) AS groups, CAST(sum(gn) AS DOUBLE) AS n, sum(z1) AS sz, sum(z1 * z1 / gn) AS bz, sum(z2) AS szz FROM (
      SELECT {k}g, CAST(count(*) AS DOUBLE) AS gn, sum(abs(v - med)) AS z1, sum((v - med) * (v - med)) AS z2 FROM (
        SELECT *, median(v) OVER (PARTITION BY {k}g) AS med, count(*) OVER (PARTITION BY {k}g) AS gc
        FROM (SELECT {k}{group} AS g, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL AND {group} IS NOT NULL))
      WHERE gc >= {min_n} GROUP BY {k}g) {by}) WHERE groups > 1)"""


def wilcoxon(source: str, keys: list[str], a: str, b: str, alternative: str = "two-sided", min_n: int = 1) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    k = "".join(f"{c}, " for c in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    on = " AND ".join(f"s1.{c} = s2.{c}" for c in keys) or "TRUE"
    k1 = "".join(f"s1.{c} AS {c}, " for c in keys)
    p = {
        "greater": normal_sf("z"),
        "less": f"1 - {normal_sf('z')}",
        "two-sided": f"least(1.0, 2 * {normal_sf('abs(z)')})",
    }[alternative]
    return f"""SELECT {k}{i('pairs')} AS pairs, {i('n')} AS n, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, {r('w_plus')} AS w_plus, {r('w_minus')} AS w_minus, {r('z')} AS z, {r(p)} AS p FROM (
  SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0) AS z FROM (
    SELECT {k1}pairs, mean_a, mean_b, s2.n AS n, w_plus, w_minus, tt FROM
      (SELECT {k}count(*) AS pairs, avg({a}) AS mean_a, avg({b}) AS mean_b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL {by}) s1 JOIN
      (SELECT {k}CAST(count(*) AS DOUBLE) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus, sum(CAST(c AS DOUBLE) * c - 1) AS tt FROM (
        SELECT {k}d, rank() OVER ({part} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {k}abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {k}abs(d)) AS c
        FROM (SELECT {k}round(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE), 9) AS d FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) WHERE d <> 0) {by}) s2 ON {on}
    WHERE pairs >= {min_n}))"""


def welch(source: str, keys: list[str], group: str, value: str, a: str, b: str, min_n: int = 2) -> str:
    k = "".join(f"{c}, " for c in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}{i('n1')} AS n1, {i('n2')} AS n2, {r('mean1')} AS mean1, {r('mean2')} AS mean2, {r('t')} AS t, {r('df')} AS df, {r(student_p2('t', 'df'))} AS p FROM (
  SELECT *, (mean1 - mean2) / sqrt(s1 + s2) AS t, (s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS df FROM (
    SELECT {k}count({value}) FILTER ({group} = {a}) AS n1, count({value}) FILTER ({group} = {b}) AS n2,
      avg({value}) FILTER ({group} = {a}) AS mean1, avg({value}) FILTER ({group} = {b}) AS mean2,
      var_samp({value}) FILTER ({group} = {a}) / count({value}) FILTER ({group} = {a}) AS s1, var_samp({value}) FILTER ({group} = {b}) / count({value}) FILTER ({group} = {b}) AS s2
    FROM {source} {by}) WHERE n1 >= {min_n} AND n2 >= {min_n})"""


def paired_t(source: str, keys: list[str], a: str, b: str) -> str:
    k = "".join(f"{c}, " for c in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}{i('n')} AS n, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, {r('mean_d')} AS mean_d, {r('t')} AS t, {r(student_p2('t', '(n - 1)'))} AS p FROM (
  SELECT *, mean_d / (sd_d / sqrt(n)) AS t FROM (
    SELECT {k}count(*) AS n, avg({a}) AS mean_a, avg({b}) AS mean_b, avg({a} - {b}) AS mean_d, stddev_samp({a} - {b}) AS sd_d
    FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL {by}) WHERE n >= 2)"""


def chi_square(source: str, keys: list[str], a: str, b: str, yates: bool = True) -> str:
    """Test of the rows (keys, a, b) of ``source``; empty cells are built explicitly."""
    k = "".join(f"{c}, " for c in keys)
    kk = "".join(f"rw.{c} AS {c}, " for c in keys)
    rc = " AND ".join(f"rw.{c} = cl.{c}" for c in keys) or "TRUE"
    rt = " AND ".join(f"rw.{c} = tot.{c}" for c in keys) or "TRUE"
    ce = " AND ".join([*[f"ce.{c} = rw.{c}" for c in keys], "ce.a = rw.a", "ce.b = cl.b"])
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    corrected = "sum(power(greatest(0.0, abs(o - e) - 0.5), 2) / e)" if yates else "sum(power(o - e, 2) / e)"
    return f"""SELECT {k}{i('rows')} AS rows, {i('cols')} AS cols, {i('n')} AS n, {i('dof')} AS dof, {r('chi2')} AS chi2, {r('min_expected')} AS min_expected, {i('min_expected < 5')} AS low_expected, {r(chi2_sf('chi2', 'dof'))} AS p FROM (
  SELECT *, CASE WHEN dof = 1 THEN yat ELSE plain END AS chi2 FROM (
    SELECT {k}count(DISTINCT a) AS rows, count(DISTINCT b) AS cols, max(n) AS n, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof,
      sum(power(o - e, 2) / e) AS plain, {corrected} AS yat, min(e) AS min_expected
    FROM (
      SELECT {kk}rw.a AS a, cl.b AS b, coalesce(ce.o, 0) AS o, rw.rn * cl.cn / CAST(tot.n AS DOUBLE) AS e, tot.n AS n
      FROM (SELECT {k}{a} AS a, CAST(count(*) AS DOUBLE) AS rn FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {k}{a}) rw
      JOIN (SELECT {k}{b} AS b, CAST(count(*) AS DOUBLE) AS cn FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {k}{b}) cl ON {rc}
      JOIN (SELECT {k}count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL {by}) tot ON {rt}
      LEFT JOIN (SELECT {k}{a} AS a, {b} AS b, count(*) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {k}{a}, {b}) ce ON {ce}) {by})
  WHERE dof > 0)"""


def ols_line(source: str, keys: list[str], x: str, y: str, min_n: int = 2) -> str:
    k = "".join(f"{c}, " for c in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    t = "(rr * sqrt((n - 2) / (1 - rr * rr)))"
    return f"""SELECT {k}{i('n')} AS n, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('rr')} AS r, {r(student_p2(t, '(n - 2)'))} AS p FROM (
  SELECT {k}count(*) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, corr({y}, {x}) AS rr
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL {by}) WHERE n >= {min_n}"""
