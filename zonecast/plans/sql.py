"""SQL text shared by the queries' reference statements."""

from __future__ import annotations

from zonecast import fixed_values as fv


def r(expression: str, places: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {places}) + 0.0)"


def rows(table: dict | list) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in row) + ")" for row in table)


ZONES = rows([(z, lat, lon) for z, (lat, lon) in fv.ZONE_CENTRES.items()])
EDGES = rows([(z, o) for z, others in fv.NEIGHBOURS.items() for o in others])

RIDES = f"""
ev AS (SELECT date_trunc('hour', ts) AS h, CAST(user_id % 20 + 1 AS VARCHAR) AS zone, ts, event_type, value FROM events),
hr AS (SELECT h, arg_min(event_type, ts) AS et, round(avg(value), 9) AS av, min(value) AS mn, max(value) AS mx,
       bool_or(event_type = 'purchase' AND value >= 150) AS pe FROM ev GROUP BY h),
zh AS (SELECT h, zone, count(*) AS n FROM ev GROUP BY h, zone),
hours AS (SELECT unnest(generate_series((SELECT min(h) FROM hr), (SELECT max(h) FROM hr), INTERVAL 1 HOUR)) AS h),
zone_list(zone, lat, lon) AS (VALUES {ZONES}),
cells AS (SELECT hours.h AS h, zone_list.zone AS zone, lat, lon,
          CASE et WHEN 'view' THEN 'cloudy' WHEN 'signup' THEN 'rain' WHEN 'error' THEN 'heavy_rain'
                  WHEN 'purchase' THEN 'snow' ELSE 'clear' END AS weather, av, mn, mx, coalesce(pe, false) AS pe
          FROM hours CROSS JOIN zone_list LEFT JOIN hr ON hr.h = hours.h),
rides AS MATERIALIZED (SELECT c.h AS timestamp, c.zone AS zone, CAST(coalesce(zh.n, 0) AS BIGINT) AS demand, c.weather AS weather,
          coalesce(c.av, 12.0) AS temperature_c,
          CASE WHEN c.weather = 'clear' THEN 0.0 ELSE c.mn / 10 END AS precipitation_mm,
          coalesce(c.mx / 10, 0.0) AS wind_speed_kmh, c.pe AS is_event,
          CASE WHEN c.pe THEN 'promo' END AS event_name, CAST(c.lat AS DOUBLE) AS lat, CAST(c.lon AS DOUBLE) AS lon
          FROM cells c LEFT JOIN zh ON zh.h = c.h AND zh.zone = c.zone)"""

SCORED = RIDES + """,
lagged AS (SELECT *, lag(demand, 24) OVER (PARTITION BY zone ORDER BY timestamp) AS l24,
           avg(demand) OVER (PARTITION BY zone ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m24 FROM rides),
scored AS MATERIALIZED (SELECT * EXCLUDE (l24, m24), coalesce(CAST(l24 AS DOUBLE), m24) AS pred FROM lagged
           WHERE l24 IS NOT NULL OR m24 IS NOT NULL)"""


def with_rides(select: str) -> str:
    return f"WITH {RIDES} {select}"


def with_scored(select: str) -> str:
    return f"WITH {SCORED} {select}"


RIDE_COLUMNS = """timestamp, zone, demand, weather, """ + ", ".join(
    f"{r(c, 9)} AS {c}" for c in ("temperature_c", "precipitation_mm", "wind_speed_kmh")
) + """, is_event, event_name, lat, lon"""


def calendar(ts: str = "timestamp") -> dict[str, str]:
    hour, day = f"hour({ts})", f"(isodow({ts}) - 1)"
    holidays = ", ".join(str(h) for h in fv.HOLIDAYS)
    return {
        "hour": hour, "day_of_week": day, "day_of_month": f"day({ts})", "month": f"month({ts})",
        "week_of_year": f"week({ts})", **day_flags(hour, day), "quarter": f"quarter({ts})",
        "is_holiday": f"CAST(month({ts}) * 100 + day({ts}) IN ({holidays}) AS BIGINT)",
    }


def day_flags(hour: str, day: str) -> dict[str, str]:
    return {
        "is_weekend": f"CAST({day} >= 5 AS BIGINT)",
        "is_friday_night": f"CAST({day} = 4 AND {hour} >= 20 AS BIGINT)",
        "is_rush_am": f"CAST({day} < 5 AND {hour} BETWEEN 7 AND 9 AS BIGINT)",
        "is_rush_pm": f"CAST({day} < 5 AND {hour} BETWEEN 17 AND 19 AS BIGINT)",
        "is_night": f"CAST({hour} BETWEEN 0 AND 5 AS BIGINT)",
    }


def fourier(hours: dict[str, str]) -> dict[str, str]:
    out = {}
    for name, (period, harmonics) in fv.FOURIER_PERIODS.items():
        for k in range(1, harmonics + 1):
            angle = f"2.0::DOUBLE * pi() * {k} * ({hours[name]}) / {float(period)}::DOUBLE"
            out[f"fourier_{name}_sin_{k}"] = f"sin({angle})"
            out[f"fourier_{name}_cos_{k}"] = f"cos({angle})"
    return out


SINCE_START = "date_diff('hour', (SELECT min(timestamp) FROM rides), timestamp)"
BY_ZONE = "PARTITION BY zone ORDER BY timestamp"


def lags(target: str = "demand", numbers: list[int] | None = None) -> dict[str, str]:
    return {f"{target}_lag_{n}h": f"lag({target}, {n}) OVER ({BY_ZONE})" for n in numbers or fv.LAGS}


def rolling(target: str = "demand") -> dict[str, str]:
    out = {}
    for n in fv.ROLLING_WINDOWS:
        over = f"OVER ({BY_ZONE} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out[f"{target}_roll{n}h_mean"] = f"avg({target}) {over}"
        out[f"{target}_roll{n}h_std"] = f"coalesce(stddev_samp({target}) {over}, 0.0)"
        out[f"{target}_roll{n}h_max"] = f"max({target}) {over}"
        out[f"{target}_roll{n}h_min"] = f"min({target}) {over}"
    return out


def velocity(target: str = "demand") -> dict[str, str]:
    return {
        f"{target}_velocity_{h}h": f"CAST({target} - lag({target}, {h}) OVER ({BY_ZONE}) AS DOUBLE) / {h}"
        for h in fv.VELOCITY_HOURS
    }


TEMPORAL = {
    **calendar(), **fourier({name: SINCE_START for name in fv.FOURIER_PERIODS}), **lags(), **rolling(), **velocity(),
}

POI = {}
for _name, (_home, _weight) in fv.POINTS_OF_INTEREST.items():
    _near = ", ".join(f"'{z}'" for z in fv.NEIGHBOURS[_home])
    POI[f"poi_{_name}"] = (
        f"CASE WHEN zone = '{_home}' THEN {_weight}::DOUBLE WHEN zone IN ({_near}) "
        f"THEN {_weight}::DOUBLE * {fv.POI_NEIGHBOUR_SHARE}::DOUBLE ELSE 0.0::DOUBLE END"
    )

CLUSTER = "CASE zone " + " ".join(f"WHEN '{z}' THEN '{name}'" for z, name in fv.ZONE_CLUSTERS.items()) + " END"

GEO_CTES = f"""
edges(zone, neighbour) AS (VALUES {EDGES}),
zone_mean AS (SELECT timestamp, zone, avg(demand) AS m FROM rides GROUP BY timestamp, zone),
around AS (SELECT z.timestamp AS timestamp, e.zone AS zone, avg(z.m) AS adj FROM zone_mean z JOIN edges e ON e.neighbour = z.zone
           GROUP BY z.timestamp, e.zone),
codes AS (SELECT zone, row_number() OVER (ORDER BY zone) - 1 AS code FROM (SELECT DISTINCT zone FROM rides))"""

GEO = {
    "zone_encoded": "codes.code",
    **{f"cluster_{c}": f"CAST(({CLUSTER.replace('zone', 'rides.zone')}) = '{c}' AS BIGINT)" for c in fv.CLUSTERS},
    "adj_zone_demand": "around.adj",
    **{k: v.replace("zone", "rides.zone") for k, v in POI.items()},
    "demand_share": "demand / (sum(demand) OVER (PARTITION BY rides.timestamp) + 1e-6)",
    "demand_rank": "CAST(rank() OVER (PARTITION BY rides.timestamp ORDER BY demand DESC) AS DOUBLE)",
}
GEO_FROM = (
    "rides JOIN codes ON codes.zone = rides.zone "
    "LEFT JOIN around ON around.timestamp = rides.timestamp AND around.zone = rides.zone"
)

RAW_FEATURES = ["temperature_c", "precipitation_mm", "wind_speed_kmh"]
ALL_FEATURES = RAW_FEATURES + list(TEMPORAL) + list(GEO)


def columns(expressions: dict[str, str], whole: tuple[str, ...] = (), places: int = 6) -> str:
    """Select list: names in `whole` as BIGINT, the rest rounded."""
    return ", ".join(
        f"CAST({e} AS BIGINT) AS {n}" if n in whole else f"{r(e, places)} AS {n}" for n, e in expressions.items()
    )


def plain(expressions: dict[str, str]) -> str:
    return ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in expressions.items())


# All 71 features, unrounded, one row per panel row.
FEATURES = RIDES + f""", {GEO_CTES},
geo AS (SELECT rides.timestamp AS gts, rides.zone AS gz, {plain(GEO)} FROM {GEO_FROM}),
temporal AS (SELECT timestamp, zone, demand, weather, is_event, {', '.join(RAW_FEATURES)}, {plain(TEMPORAL)} FROM rides),
features AS MATERIALIZED (SELECT t.*, geo.* EXCLUDE (gts, gz) FROM temporal t JOIN geo ON geo.gts = t.timestamp AND geo.gz = t.zone)"""


def with_features(select: str) -> str:
    return f"WITH {FEATURES} {select}"


def metrics(y: str = "demand", p: str = "pred", prefix: str = "", places: int = 7) -> str:
    e = f"({y} - {p})"
    named = {
        "rmse": f"sqrt(avg({e} * {e}))",
        "mape": f"avg(abs({e} / (abs({y}) + 1.0)))",
        "mae": f"avg(abs({e}))",
        "r2": f"1 - sum({e} * {e}) / (count(*) * var_pop({y}) + 1e-9)",
        "pinball_90": f"avg(greatest(0.9 * {e}, -0.1 * {e}))",
        "max_error": f"max(abs({e}))",
    }
    return ", ".join(f"{r(x, places)} AS {prefix}{n}" for n, x in named.items())


def surge(demand: str, baseline: str) -> str:
    ratio = f"({demand} / ({baseline} + 1e-3))"
    steps = " ".join(f"WHEN {ratio} >= {t} THEN {m}::DOUBLE" for t, m in reversed(fv.SURGE_STEPS))
    return f"(CASE {steps} ELSE 1.0::DOUBLE END)"


def unpivot(relation: str, names: list[str], alias: str = "feature") -> str:
    """(feature, value) rows without nulls, as a subquery."""
    parts = " UNION ALL ".join(f"SELECT '{n}' AS {alias}, CAST({n} AS DOUBLE) AS value FROM {relation}" for n in names)
    return f"(SELECT * FROM ({parts}) WHERE value IS NOT NULL)"


def psi(reference: str, current: str, names: list[str], bins: int = 10) -> str:
    """CTE text ending in table psi(feature, n_ref, n_cur, psi)."""
    shares = ", ".join(repr(i / bins) for i in range(bins + 1))
    upper = f"CASE WHEN b = {bins} THEN value <= e[b + 1] + 1e-6 ELSE value < e[b + 1] END"
    lower = "value >= CASE WHEN b = 1 THEN e[1] - 1e-6 ELSE e[b] END"
    return f"""
ref_long AS ({unpivot(reference, names)}),
cur_long AS ({unpivot(current, names)}),
edge_list AS (SELECT feature, quantile_cont(value, [{shares}]) AS e, count(*) AS n_ref FROM ref_long GROUP BY feature),
cur_n AS (SELECT feature, count(*) AS n_cur FROM cur_long GROUP BY feature),
bin_list AS (SELECT feature, e, n_ref, unnest(range(1, {bins + 1})) AS b FROM edge_list),
ref_bins AS (SELECT l.feature AS feature, b, count(*) AS n FROM ref_long l JOIN bin_list k ON k.feature = l.feature
             WHERE {lower} AND ({upper}) GROUP BY l.feature, b),
cur_bins AS (SELECT l.feature AS feature, b, count(*) AS n FROM cur_long l JOIN bin_list k ON k.feature = l.feature
             WHERE {lower} AND ({upper}) GROUP BY l.feature, b),
share_list AS (SELECT k.feature AS feature, k.n_ref AS n_ref, c.n_cur AS n_cur,
        CASE WHEN coalesce(rb.n, 0) = 0 THEN 1e-6 ELSE rb.n / k.n_ref END AS e,
        CASE WHEN coalesce(cb.n, 0) = 0 THEN 1e-6 ELSE cb.n / c.n_cur END AS a
        FROM bin_list k JOIN cur_n c ON c.feature = k.feature
        LEFT JOIN ref_bins rb ON rb.feature = k.feature AND rb.b = k.b
        LEFT JOIN cur_bins cb ON cb.feature = k.feature AND cb.b = k.b),
psi AS (SELECT feature, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur, sum((a - e) * ln(a / e)) AS psi
        FROM share_list GROUP BY feature)"""


def ks(reference: str, current: str, names: list[str]) -> str:
    """CTE text ending in table ks(feature, ks)."""
    return f"""
side_long AS (SELECT feature, value, 1 AS r, 0 AS c FROM {unpivot(reference, names)}
              UNION ALL SELECT feature, value, 0, 1 FROM {unpivot(current, names)}),
side_counts AS (SELECT feature, value, sum(r) AS r, sum(c) AS c FROM side_long GROUP BY feature, value),
running AS (SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr,
            sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS fc
            FROM side_counts WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs(fr - fc)) AS ks FROM running GROUP BY feature)"""
