"""SQL side of the registered queries, over the same tables."""

from __future__ import annotations

TRAIN = "TIMESTAMP '2024-01-14 23:00:00'"
VALIDATION = "TIMESTAMP '2024-01-20 23:00:00'"
Z90 = "1.2815515655446004"
Z95 = "1.6448536269514722"
TYPES = ("click", "error", "purchase", "signup", "view")


def r(expression: str, name: str) -> str:
    """Six decimals, exact halves nudged off the rounding edge, no negative zero."""
    return f"round(({expression}) + 1e-9, 6) + 0.0 AS {name}"


def resampled(key: str, name: str) -> str:
    """CTEs for the hourly mean of means per key on its own complete range."""
    return f"""
    {name}_ts AS (SELECT {key}, ts, avg(value) AS v FROM events
        WHERE {key} IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
    {name}_hour AS (SELECT {key}, date_trunc('hour', ts) AS h, avg(v) AS v FROM {name}_ts GROUP BY ALL),
    {name}_grid AS (SELECT {key}, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h
        FROM {name}_hour GROUP BY {key}),
    {name} AS (SELECT g.{key}, g.h AS ts, o.v AS value FROM {name}_grid g
        LEFT JOIN {name}_hour o ON o.{key} = g.{key} AND o.h = g.h)"""


SERIES = resampled("event_type", "series")
USERS = resampled("user_id", "users")
OVERALL = """
    overall_ts AS (SELECT ts, avg(value) AS v FROM events WHERE ts IS NOT NULL GROUP BY ts),
    overall_hour AS (SELECT date_trunc('hour', ts) AS h, avg(v) AS v FROM overall_ts GROUP BY ALL),
    overall_grid AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM overall_hour),
    overall AS (SELECT g.h AS ts, v AS value FROM overall_grid g LEFT JOIN overall_hour o ON o.h = g.h)"""


def interpolated(source: str, name: str, key: str, limit: int, method: str, both: bool = True) -> str:
    """CTEs that fill ``value`` of ``source`` within the limit."""
    x = "rn::DOUBLE" if method == "linear" else "epoch(ts)::DOUBLE"
    up = f"OVER (PARTITION BY {key} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = f"OVER (PARTITION BY {key} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = f"coalesce(rn - prn <= {limit}, FALSE)"
    if both:
        near += f" OR coalesce(nrn - rn <= {limit}, FALSE)"
    return f"""
    {name}_x AS (SELECT *, {x} AS x FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS rn FROM {source})),
    {name}_n AS (SELECT *,
        last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) {up} AS prn,
        last_value(CASE WHEN value IS NOT NULL THEN x END IGNORE NULLS) {up} AS px,
        last_value(value IGNORE NULLS) {up} AS py,
        first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) {down} AS nrn,
        first_value(CASE WHEN value IS NOT NULL THEN x END IGNORE NULLS) {down} AS nx,
        first_value(value IGNORE NULLS) {down} AS ny
        FROM {name}_x),
    {name} AS (SELECT * EXCLUDE (value, rn, x, prn, px, py, nrn, nx, ny), value AS raw_value,
        CASE WHEN value IS NOT NULL THEN value
             WHEN {near} THEN coalesce(py + (ny - py) * (x - px) / nullif(nx - px, 0), py, ny) END AS value
        FROM {name}_n)"""


def rolling(n: int, column: str, partition: str, shift: int = 0, order: str = "ts") -> dict[str, str]:
    frame = (
        f"OVER ({partition} ORDER BY {order} ROWS BETWEEN {n - 1 + shift} PRECEDING "
        f"AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    )
    guard = f"CASE WHEN count({column}) {frame} >= {n} THEN"
    return {
        "mean": f"{guard} avg({column}) {frame} END",
        "std": f"{guard} stddev_samp({column}) {frame} END",
    }


BY_TYPE = "PARTITION BY event_type"
TYPE_ORDER = f"({BY_TYPE} ORDER BY ts)"
LEADS = {"t_plus_1": 1, "t_plus_24": 24, "t_plus_168": 168}
SPLIT = f"CASE WHEN ts <= {TRAIN} THEN 'train' WHEN ts <= {VALIDATION} THEN 'validation' ELSE 'test' END"


def targets(source: str, name: str, partition: str) -> str:
    """CTEs for all horizon targets, wide and long."""
    wide = ", ".join(
        f"lead(value, {h}) OVER w AS load_target_{label}, lead(ts, {h}) OVER w AS target_timestamp_{label}"
        for label, h in LEADS.items()
    )
    long = " UNION ALL ".join(
        f"SELECT * EXCLUDE ({', '.join(f'load_target_{x}, target_timestamp_{x}' for x in LEADS)}), "
        f"'{label}' AS horizon, {h}::INTEGER AS lead_steps, load_target_{label} AS target, "
        f"target_timestamp_{label} AS target_timestamp FROM {name}"
        for label, h in LEADS.items()
    )
    return f"""
    {name} AS (SELECT *, {wide} FROM {source} WINDOW w AS ({partition} ORDER BY ts)),
    {name}_long AS ({long})"""


LABELLED = f"""{SERIES},{targets('series', 'tg', BY_TYPE)},
    lab AS (SELECT *, {SPLIT} AS split FROM tg_long WHERE target IS NOT NULL)"""
FORECASTS = f"""{LABELLED},
    fitted AS (SELECT horizon, event_type, hour(target_timestamp) AS th, avg(target) AS q50,
        coalesce(stddev_samp(target), 0) AS sp FROM lab WHERE split = 'train' GROUP BY ALL),
    fc AS (SELECT l.ts, l.event_type, l.horizon, l.lead_steps, l.split, l.target,
        'hourly_normal' AS model_name, q50 - {Z90} * sp AS pred_q10, q50 AS pred_q50,
        q50 + {Z90} * sp AS pred_q90
        FROM lab l JOIN fitted f ON f.horizon = l.horizon AND f.event_type = l.event_type
            AND f.th = hour(l.target_timestamp))"""
CALIBRATED = f"""{FORECASTS},
    scores AS (SELECT horizon, row_number() OVER (PARTITION BY horizon ORDER BY greatest(pred_q10 - target, target - pred_q90)) AS rn,
        greatest(pred_q10 - target, target - pred_q90) AS score, count(*) OVER (PARTITION BY horizon) AS n
        FROM fc WHERE split = 'validation'),
    adj AS (SELECT horizon, max(score) AS adjustment FROM scores WHERE rn = ceil((n + 1) * 0.8 - 1e-9) GROUP BY horizon),
    cal AS (SELECT fc.*, adjustment, pred_q10 - adjustment AS cal_low, pred_q90 + adjustment AS cal_high
        FROM fc LEFT JOIN adj ON adj.horizon = fc.horizon)"""
MODELS = f"""{FORECASTS},
    hist AS (SELECT event_type, ts, value AS persistence, {rolling(24, 'value', BY_TYPE)['mean']} AS trailing_day FROM series),
    mf AS (SELECT fc.horizon, fc.lead_steps, fc.split, fc.target, m.model,
        CASE m.model WHEN 'hourly_normal' THEN pred_q50 WHEN 'persistence' THEN persistence ELSE trailing_day END AS forecast
        FROM fc LEFT JOIN hist ON hist.event_type = fc.event_type AND hist.ts = fc.ts
        CROSS JOIN (VALUES ('hourly_normal'), ('persistence'), ('trailing_day')) m(model)),
    mr AS (SELECT horizon, model, sqrt(avg((target - forecast) * (target - forecast))) AS rmse
        FROM mf WHERE split = 'test' AND forecast IS NOT NULL GROUP BY ALL)"""


def measures(low: str = "pred_q10", high: str = "pred_q90") -> dict[str, str]:
    return {
        "mae": "avg(abs(target - pred_q50))",
        "rmse": "sqrt(avg((target - pred_q50) * (target - pred_q50)))",
        **{
            f"pinball_{q}": f"avg(greatest({a} * (target - pred_{q}), ({a} - 1) * (target - pred_{q})))"
            for q, a in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))
        },
        "coverage_80": f"avg(CASE WHEN target >= {low} AND target <= {high} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
        "width_80": f"avg({high} - {low})",
    }


M = measures()
LABEL = "CASE WHEN {c} IS NULL THEN 'inconclusive' WHEN {c} < 0.75 THEN 'under-covered' WHEN {c} > 0.85 THEN 'over-covered' ELSE 'reasonably calibrated' END"
REPORT_METRICS = ("mae", "rmse", "pinball_q10", "pinball_q50", "pinball_q90", "coverage_80")
REPORT = f"""{FORECASTS},
    ms AS (SELECT horizon, lead_steps, model_name, split, {', '.join(f'{M[k]} AS {k}' for k in REPORT_METRICS)}
        FROM fc WHERE split IN ('validation', 'test') GROUP BY ALL),
    rep AS (SELECT horizon, lead_steps, model_name,
        {', '.join(f"max({k}) FILTER (split = '{s}') AS {s}_{k}" for s in ('validation', 'test') for k in REPORT_METRICS)}
        FROM ms GROUP BY ALL)"""

_BASE_COLUMNS = [f"{s}_{k}" for s in ("validation", "test") for k in REPORT_METRICS]


_HORIZONS = f"(VALUES {', '.join(f'({chr(39)}{h}{chr(39)})' for h in LEADS)}) hz(horizon)"


def _flat(model: str, family: str) -> str:
    cells = []
    for c in _BASE_COLUMNS:
        split, _, k = c.partition("_")
        if k in ("mae", "rmse"):
            keep = f"FILTER (split = '{split}')"
            mae = f"avg(abs(target - forecast)) {keep}"
            rmse = f"sqrt(avg((target - forecast) * (target - forecast)) {keep})"
            cells.append(f"{mae if k == 'mae' else rmse} AS {c}")
        else:
            cells.append(f"NULL::DOUBLE AS {c}")
    return f"""SELECT '{model}' AS model_name, '{family}' AS model_family, {', '.join(cells)}
        , horizon FROM {_HORIZONS} LEFT JOIN (SELECT * FROM mf WHERE forecast IS NOT NULL AND model = '{model}') USING (horizon) GROUP BY horizon"""


def _deep() -> str:
    cells = [f"{M[k]} AS {k}" for k in REPORT_METRICS]
    return f"""SELECT 'hourly_normal' AS model_name, 'GradientBoostingRegressor_Quantile' AS model_family,
        {', '.join(f"max({k}) FILTER (split = '{s}') AS {s}_{k}" for s in ('validation', 'test') for k in REPORT_METRICS)}
        , horizon FROM {_HORIZONS} LEFT JOIN (SELECT horizon, split, {', '.join(cells)} FROM fc GROUP BY horizon, split) USING (horizon) GROUP BY horizon"""


BASELINES = f"""{MODELS},
    base AS ({_flat('persistence', 'SeasonalNaive')} UNION ALL BY NAME {_flat('trailing_day', 'SARIMAX')}
        UNION ALL BY NAME {_deep()})"""

WIDE = f"""{SERIES},
    hours AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM series),
    wide AS (SELECT h.ts, t.event_type, s.value FROM hours h
        CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in TYPES)}) t(event_type)
        LEFT JOIN series s ON s.ts = h.ts AND s.event_type = t.event_type),
    {interpolated('wide', 'wide_filled', 'event_type', 6, 'time').strip()}"""

CALENDAR = {
    "hour_of_day": "hour(ts)::INTEGER",
    "day_of_week": "(isodow(ts) - 1)::INTEGER",
    "month": "month(ts)::INTEGER",
    "day_of_year": "dayofyear(ts)::INTEGER",
}
CYCLES = {
    "hour": ("hour(ts)", 24),
    "dow": ("(isodow(ts) - 1)", 7),
    "month": ("(month(ts) - 1)", 12),
}


def calendar() -> str:
    parts = [f"{e} AS {n}" for n, e in CALENDAR.items()]
    for n, (e, p) in CYCLES.items():
        parts += [r(f"{f}(2 * pi() * {e} / {p})", f"{f}_{n}") for f in ("sin", "cos")]
    return ", ".join(parts)


def history(column: str, prefix: str, partition: str, lags=(1, 24, 48, 168), n: int | None = 24, shift: int = 0) -> str:
    parts = [r(f"lag({column}, {k}) OVER ({partition} ORDER BY ts)", f"{prefix}_lag_{k}") for k in lags]
    if n:
        roll = rolling(n, column, partition, shift)
        parts += [r(roll["mean"], f"{prefix}_rollmean_{n}"), r(roll["std"], f"{prefix}_rollstd_{n}")]
    return ", ".join(parts)


def wide_targets() -> str:
    parts = []
    for label in LEADS:
        parts += [
            r(f"load_target_{label}", f"load_target_{label}"),
            f"target_timestamp_{label}",
            f"(load_target_{label} IS NOT NULL)::INTEGER AS target_available_{label}",
        ]
    return ", ".join(parts)


EXOGENOUS = f"""{SERIES},
    joined AS (SELECT s.event_type, s.ts, s.value AS own, {', '.join(f'{t}.value AS {t}_raw' for t in TYPES)} FROM series s
        {' '.join(f"LEFT JOIN series {t} ON {t}.ts = s.ts AND {t}.event_type = '{t}'" for t in TYPES)}),
    {', '.join(f"{t}_x AS (SELECT event_type, ts, {t}_raw AS value FROM joined), {interpolated(f'{t}_x', f'{t}_f', 'event_type', 6, 'time').strip()}" for t in TYPES)},
    exo AS (SELECT j.event_type, j.ts, own AS value, {', '.join(f'{t}_raw, {t}_f.value AS {t}_fill' for t in TYPES)} FROM joined j
        {' '.join(f"JOIN {t}_f ON {t}_f.event_type = j.event_type AND {t}_f.ts = j.ts" for t in TYPES)})"""
EXOGENOUS_COLUMNS = ", ".join(
    f"{r(f'{c}_fill', c)}, ({c}_raw IS NULL)::INTEGER AS {c}_missing_flag_raw, "
    f"({c}_fill IS NULL)::INTEGER AS {c}_missing_flag_postfill"
    for c in TYPES
)
FOLD_SPECS = [(k + 1, f"TIMESTAMP '2024-01-10 23:00:00' + INTERVAL {72 * k} HOUR") for k in range(6)]
FOLDS = f"""{SERIES},
    folds AS (SELECT * FROM (VALUES {', '.join(f"({k}::INTEGER, {o})" for k, o in FOLD_SPECS)}) f(fold, origin)),
    scored AS (SELECT s.*, fold, (date_diff('hour', origin, s.ts))::INTEGER AS lead_steps FROM series s JOIN folds
        ON s.ts > origin AND s.ts <= origin + INTERVAL 168 HOUR),
    wf AS (SELECT s.*, p.value AS forecast FROM scored s LEFT JOIN series p ON p.event_type = s.event_type
        AND p.ts = s.ts - to_hours((ceil(s.lead_steps / 48.0) * 48)::INTEGER))"""
KNOWN = f"{SERIES}, known AS (SELECT *, {SPLIT} AS split FROM series WHERE value IS NOT NULL)"
RESOLUTION = "CASE l_returnflag WHEN 'A' THEN 'PT15M' WHEN 'N' THEN 'PT30M' WHEN 'R' THEN 'PT60M' END"
MINUTES = "CASE l_returnflag WHEN 'A' THEN 15 WHEN 'N' THEN 30 WHEN 'R' THEN 60 END"
POINT_TIME = f"l_shipdate + to_minutes(((l_linenumber - 1) * {MINUTES})::INTEGER)"
HOUR_ROWS = "hour_rows AS (SELECT event_type, user_id, date_trunc('hour', ts) AS ts, value FROM events)"


AUDIT_START = "TIMESTAMP '2024-01-01 00:00:00'"
AUDIT_END = "TIMESTAMP '2024-01-31 23:00:00'"


def audit(source: str, key: str, low: str, high: str) -> str:
    inside = f"count(DISTINCT ts) FILTER (ts >= {low} AND ts <= {high} AND ts = date_trunc('hour', ts))"
    expected = f"(date_diff('hour', {low}, {high}) + 1)"
    return f"""SELECT {key}, {expected} AS expected_count, count(*) AS observed_count,
        {expected} - {inside} AS missing_count, count(*) FILTER (value IS NULL) AS null_count,
        count(*) - count(DISTINCT ts) AS duplicate_count, min(ts) AS start_utc, max(ts) AS end_utc
        FROM {source} GROUP BY {key}"""


ORACLE: dict[str, str] = {
    "collapse_duplicates": f"""SELECT event_type, date_trunc('minute', ts) AS ts, {r('avg(value)', 'value')}
        FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2""",
    "hourly_resample": f"WITH {OVERALL} SELECT ts, {r('value', 'value')} FROM overall",
    "grouped_resample": f"WITH {SERIES} SELECT event_type, ts, {r('value', 'value')} FROM series",
    "user_resample": f"WITH {USERS} SELECT user_id, ts, {r('value', 'value')} FROM users",
    "half_hour_resample": f"""WITH per_ts AS (SELECT event_type, ts, avg(value) AS v FROM events GROUP BY ALL),
        slot AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS h, avg(v) AS v FROM per_ts GROUP BY ALL),
        grid AS (SELECT event_type, unnest(generate_series(TIMESTAMP '2024-01-03 00:00:00',
            TIMESTAMP '2024-01-25 23:30:00', INTERVAL 30 MINUTE)) AS h FROM (SELECT DISTINCT event_type FROM events))
        SELECT g.event_type, g.h AS ts, {r('v', 'value')} FROM grid g
        LEFT JOIN slot s ON s.event_type = g.event_type AND s.h = g.h""",
    "grid_alignment": f"""WITH observed AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL),
        grid AS (SELECT event_type, unnest(generate_series(TIMESTAMP '2023-12-31 00:00:00',
            TIMESTAMP '2024-02-01 23:00:00', INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT event_type FROM events))
        SELECT g.event_type, g.ts, {r('value', 'value')}, (value IS NULL)::INTEGER AS missing_flag
        FROM grid g LEFT JOIN observed o ON o.event_type = g.event_type AND o.ts = g.ts""",
    "missing_timestamps": f"WITH {SERIES} SELECT g.event_type, g.h AS ts FROM series_grid g ANTI JOIN series_hour o ON o.event_type = g.event_type AND o.h = g.h",
    "timestamp_difference": f"WITH {USERS} SELECT user_id, h AS ts FROM users_grid EXCEPT SELECT user_id, h FROM users_hour",
    "series_audit": f"WITH {HOUR_ROWS} {audit('hour_rows', 'event_type', AUDIT_START, AUDIT_END)}",
    "user_audit": f"WITH {USERS} {audit('users', 'user_id', 'min(ts)', 'max(ts)').replace('ts >= min(ts) AND ts <= max(ts) AND ', '')}",
    "label_profile": f"""WITH {SERIES} SELECT CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
        count(*) AS row_count, count(*) FILTER (value IS NULL) AS missing_values,
        {r('min(value)', 'min_value')}, {r('max(value)', 'max_value')} FROM series GROUP BY 1""",
    "coverage_profile": f"""WITH {USERS} SELECT user_id, count(*) AS row_count, min(ts) AS start_utc, max(ts) AS end_utc,
        count(*) FILTER (value IS NULL) AS missing_count, count(value) AS available_sum FROM users GROUP BY user_id""",
    "distinct_labels": "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL ORDER BY 1",
    "duplicate_count": f"WITH {HOUR_ROWS} SELECT event_type, count(*) - count(DISTINCT ts) AS duplicate_count FROM hour_rows GROUP BY 1",
    "null_hours": f"WITH {SERIES} SELECT event_type, ts FROM series WHERE value IS NULL",
    "interpolate_columns": f"""WITH {WIDE} SELECT ts, {', '.join(
        r(f"max(value) FILTER (event_type = '{t}')", t)
        + f", max((raw_value IS NULL)::INTEGER) FILTER (event_type = '{t}') AS {t}_missing_flag_raw"
        + f", max((value IS NULL)::INTEGER) FILTER (event_type = '{t}') AS {t}_missing_flag_postfill"
        for t in TYPES)} FROM wide_filled GROUP BY ts""",
    "column_quality": f"""WITH {WIDE} SELECT event_type AS column_name,
        count(*) FILTER (raw_value IS NULL) AS raw_missing_count,
        count(*) FILTER (value IS NULL) AS postfill_missing_count FROM wide_filled GROUP BY 1""",
    "interpolate_linear": f"WITH {SERIES},{interpolated('series', 'filled', 'event_type', 3, 'linear')} SELECT event_type, ts, {r('value', 'value')} FROM filled",
    "interpolate_time": f"WITH {USERS},{interpolated('users', 'filled', 'user_id', 6, 'time')} SELECT user_id, ts, {r('value', 'value')} FROM filled",
    "interpolate_forward": f"WITH {USERS},{interpolated('users', 'filled', 'user_id', 3, 'linear', both=False)} SELECT user_id, ts, {r('value', 'value')} FROM filled",
    "calendar_features": f"SELECT o_orderkey, ts, {calendar()} FROM (SELECT o_orderkey, o_orderdate AS ts FROM orders)",
    "lag_features": f"WITH {SERIES} SELECT event_type, ts, {r('value', 'value')}, {history('value', 'load', BY_TYPE, n=None)} FROM series",
    "lag_features_sparse": f"""WITH {USERS}, observed AS (SELECT * FROM users WHERE value IS NOT NULL)
        SELECT o.user_id, o.ts, {r('o.value', 'value')}, {', '.join(r(f'l{k}.value', f'load_lag_{k}') for k in (1, 24, 48, 168))} FROM observed o
        {' '.join(f'LEFT JOIN observed l{k} ON l{k}.user_id = o.user_id AND l{k}.ts = o.ts - INTERVAL {k} HOUR' for k in (1, 24, 48, 168))}""",
    "rolling_features": f"WITH {SERIES},{interpolated('series', 'filled', 'event_type', 3, 'linear')} SELECT event_type, ts, {r('value', 'value')}, {history('value', 'load', BY_TYPE, lags=())} FROM filled",
    "rolling_exclude_current": f"WITH {SERIES},{interpolated('series', 'filled', 'event_type', 3, 'linear')} SELECT event_type, ts, {r('value', 'value')}, {history('value', 'load', BY_TYPE, lags=(), shift=1)} FROM filled",
    "supplier_history": f"""WITH per_day AS (SELECT l_suppkey, l_shipdate AS ts, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
        grid AS (SELECT l_suppkey, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM per_day GROUP BY 1),
        daily AS (SELECT g.l_suppkey, g.ts, v AS l_quantity FROM grid g LEFT JOIN per_day p ON p.l_suppkey = g.l_suppkey AND p.ts = g.ts)
        SELECT l_suppkey, ts, {r('l_quantity', 'l_quantity')}, {history('l_quantity', 'quantity', 'PARTITION BY l_suppkey', lags=(1, 7), n=7)} FROM daily""",
    "modeling_table": f"""WITH {SERIES},
        wind AS (SELECT 0 AS k, ts, value FROM series WHERE event_type = 'view'),
        {interpolated('wind', 'wind_filled', 'k', 3, 'linear').strip()},
        merged AS (SELECT s.ts, s.value AS load_mw, w.raw_value, w.value AS wind, w.ts AS wind_ts FROM series s
            LEFT JOIN wind_filled w ON w.ts = s.ts WHERE s.event_type = 'click')
        SELECT ts, {r('load_mw', 'load_mw')}, (load_mw IS NULL)::INTEGER AS load_missing_flag,
            {r('wind', 'wind_onshore_mw')}, CASE WHEN wind_ts IS NOT NULL THEN (raw_value IS NULL)::INTEGER END AS wind_missing_flag_raw,
            CASE WHEN wind_ts IS NOT NULL THEN (wind IS NULL)::INTEGER END AS wind_missing_flag_postfill, {calendar()},
            {history('load_mw', 'load', '')}, (load_mw IS NOT NULL)::INTEGER AS target_available_for_training
        FROM merged""",
    "exogenous_join": f"""WITH {EXOGENOUS} SELECT event_type, ts, {r('value', 'value')}, {EXOGENOUS_COLUMNS} FROM exo""",
    "weather_horizons": f"""WITH {EXOGENOUS},{targets('exo', 'tg', BY_TYPE)}
        SELECT event_type, ts, {r('value', 'value')}, {EXOGENOUS_COLUMNS}, {wide_targets()} FROM tg""",
    "run_lineage": f"""WITH {SERIES} SELECT 'events' AS source, 'https://feed.example/api?securityToken=REDACTED&step=1h' AS resolved_url,
        count(*) AS row_count, min(ts) AS start_utc, max(ts) AS end_utc, '1 hour' AS step, 'event_type,ts,value' AS columns FROM series""",
    "horizon_targets": f"WITH {SERIES},{targets('series', 'tg', BY_TYPE)} SELECT event_type, ts, {r('value', 'value')}, {wide_targets()} FROM tg",
    "user_targets": f"""WITH {USERS},{targets('users', 'tg', 'PARTITION BY user_id')} SELECT horizon, lead_steps, count(*) AS row_count,
        count(target) AS available_count, count(*) - count(target) AS missing_count, min(ts) AS start_utc, max(ts) AS end_utc
        FROM tg_long GROUP BY 1, 2""",
    "supervised_table": f"WITH {SERIES},{targets('series', 'tg', BY_TYPE)} SELECT event_type, ts, {r('value', 'value')}, {history('value', 'load', BY_TYPE)}, {wide_targets()} FROM tg",
    "time_split": f"SELECT ts, user_id, event_type, {r('value', 'value')}, {SPLIT} AS split FROM events",
    "time_split_closed": f"""SELECT * FROM (SELECT ts, user_id, event_type, {r('value', 'value')},
        CASE WHEN ts <= {TRAIN} THEN 'train'
             WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts <= {VALIDATION} THEN 'validation'
             WHEN ts >= TIMESTAMP '2024-01-21 00:00:00' THEN 'test' END AS split FROM events) WHERE split IS NOT NULL""",
    "split_summary": f"WITH {LABELLED} SELECT horizon, split, count(*) AS row_count, min(ts) AS start_utc, max(ts) AS end_utc FROM lab GROUP BY 1, 2",
    "split_embargo": f"""WITH {LABELLED} SELECT event_type, split, count(*) AS row_count, min(ts) AS start_utc, max(ts) AS end_utc FROM lab
        WHERE horizon = 't_plus_24' AND NOT (split = 'train' AND target_timestamp > {TRAIN})
            AND NOT (split = 'validation' AND target_timestamp > {VALIDATION}) GROUP BY 1, 2""",
    "before_test": f"SELECT * FROM (SELECT ts, user_id, event_type, {r('value', 'value')}, {SPLIT} AS split FROM events) WHERE split <> 'test'",
    "train_median": f"SELECT event_type, {r('median(value)', 'median')} FROM events WHERE ts <= {TRAIN} GROUP BY 1",
    "train_median_impute": f"""WITH {SERIES},
        lagged AS (SELECT event_type, ts, value, lag(value, 1) OVER {TYPE_ORDER} AS l1, lag(value, 24) OVER {TYPE_ORDER} AS l24, {SPLIT} AS split FROM series),
        filled AS (SELECT * REPLACE (coalesce(l1, (SELECT median(l1) FROM lagged WHERE split = 'train')) AS l1) FROM lagged)
        SELECT event_type, ts, {r('value', 'value')}, {r('l1', 'load_lag_1')}, {r('l24', 'load_lag_24')}, split FROM filled
        WHERE value IS NOT NULL AND l1 IS NOT NULL AND l24 IS NOT NULL""",
    "row_position": f"WITH {USERS} SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS position FROM users WHERE value IS NOT NULL",
    "seasonal_naive": f"WITH {KNOWN} SELECT event_type, ts, {r('value', 'value')}, split, {r(f'lag(value, 168) OVER {TYPE_ORDER}', 'forecast')} FROM known",
    "seasonal_naive_time": f"""WITH {KNOWN} SELECT k.event_type, k.ts, {r('k.value', 'value')}, k.split, {r('p.value', 'forecast')}
        FROM known k LEFT JOIN known p ON p.event_type = k.event_type AND p.ts = k.ts - INTERVAL 168 HOUR""",
    "naive_evaluation": f"""WITH {KNOWN}, f AS (SELECT *, lag(value, 168) OVER {TYPE_ORDER} AS forecast FROM known)
        SELECT split, count(forecast) AS row_count, count(*) - count(forecast) AS unscored_count, {r('avg(abs(value - forecast))', 'mae')},
            {r('sqrt(avg((value - forecast) * (value - forecast)))', 'rmse')}, 'seasonal_naive_weekly' AS model_name
        FROM f WHERE split <> 'train' GROUP BY split""",
    "walk_forward_forecasts": f"WITH {FOLDS} SELECT event_type, ts, {r('value', 'value')}, fold, lead_steps, {r('forecast', 'forecast')} FROM wf",
    "walk_forward": f"""WITH {FOLDS}, pf AS (SELECT event_type, fold, avg(abs(value - forecast)) AS mae,
            sqrt(avg((value - forecast) * (value - forecast))) AS rmse, count(*) - count(forecast) AS lost FROM wf
            WHERE value IS NOT NULL GROUP BY 1, 2)
        SELECT event_type, count(*) AS folds, sum(lost)::BIGINT AS unscored_count, {r('avg(mae)', 'mae_mean')}, {r('stddev_samp(mae)', 'mae_std')},
            {r('avg(rmse)', 'rmse_mean')}, {r('stddev_samp(rmse)', 'rmse_std')} FROM pf GROUP BY 1""",
    "point_metrics": f"WITH {FORECASTS} SELECT horizon, event_type, split, count(*) AS row_count, {r(M['mae'], 'mae')}, {r(M['rmse'], 'rmse')} FROM fc GROUP BY 1, 2, 3",
    "metric_table": f"WITH {FORECASTS} SELECT horizon, model_name, split, count(*) AS row_count, {', '.join(r(e, k) for k, e in M.items())} FROM fc GROUP BY 1, 2, 3",
    "interval_levels": f"""WITH {FORECASTS},
        w AS (SELECT *, (pred_q90 - pred_q50) / {Z90} * {Z95} AS half FROM fc),
        b AS (SELECT horizon, split, target, 0.8::DOUBLE AS nominal, pred_q10 AS lo, pred_q90 AS hi FROM w
            UNION ALL SELECT horizon, split, target, 0.9::DOUBLE, pred_q50 - half, pred_q50 + half FROM w)
        SELECT horizon, split, nominal, {r('avg(CASE WHEN target >= lo AND target <= hi THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 'coverage')},
            {r('avg(hi - lo)', 'width')} FROM b GROUP BY 1, 2, 3""",
    "conformal_rank": f"""WITH {FORECASTS},
        s AS (SELECT horizon, event_type, greatest(pred_q10 - target, target - pred_q90) AS score FROM fc WHERE split = 'validation'),
        k AS (SELECT *, row_number() OVER (PARTITION BY horizon, event_type ORDER BY score) AS rn, count(*) OVER (PARTITION BY horizon, event_type) AS n FROM s)
        SELECT horizon, event_type, max(n) AS n, {r('max(score) FILTER (rn = ceil((n + 1) * 0.8 - 1e-9))', 'adjustment')} FROM k GROUP BY 1, 2""",
    "conformal_calibrate_intervals": f"WITH {CALIBRATED} SELECT ts, event_type, horizon, split, {r('adjustment', 'adjustment')}, {r('cal_low', 'calibrated_lower')}, {r('cal_high', 'calibrated_upper')} FROM cal",
    "conformal_comparison": f"""WITH {CALIBRATED} SELECT horizon AS horizon_label, {r('max(adjustment)', 'conformal_adjustment_mw')},
        {r(M['coverage_80'], 'test_raw_coverage_80')}, {r(measures('cal_low', 'cal_high')['coverage_80'], 'test_calibrated_coverage_80')},
        {r(M['width_80'], 'test_raw_interval_width')}, {r('avg(cal_high - cal_low)', 'test_calibrated_interval_width')},
        {r(M['rmse'], 'test_rmse_q50')} FROM cal WHERE split = 'test' GROUP BY 1""",
    "calibration_metrics": f"""WITH {CALIBRATED},
        both_ AS (SELECT horizon, split, 'raw' AS interval, target, pred_q10, pred_q50, pred_q90 FROM cal
            UNION ALL SELECT horizon, split, 'calibrated', target, cal_low, pred_q50, cal_high FROM cal)
        SELECT horizon, split, interval, count(*) AS row_count, {', '.join(r(e, k) for k, e in M.items())} FROM both_ GROUP BY 1, 2, 3""",
    "model_pivot": f"WITH {MODELS} SELECT horizon, {', '.join(r(f'''max(rmse) FILTER (model = '{m}')''', m) for m in ('hourly_normal', 'persistence', 'trailing_day'))} FROM mr GROUP BY 1",
    "best_model": f"""WITH {MODELS} SELECT horizon, {', '.join(r(f'''max(rmse) FILTER (model = '{m}')''', m) for m in ('hourly_normal', 'persistence', 'trailing_day'))},
        arg_min(model, rmse) AS best_model, {r('min(rmse)', 'best_rmse')} FROM mr GROUP BY 1""",
    "combined_metrics": f"""WITH {MODELS}
        SELECT horizon, model_name, count(*) AS row_count, {', '.join(r(e, k) for k, e in M.items())}
        FROM fc WHERE split = 'test' GROUP BY 1, 2
        UNION ALL BY NAME SELECT horizon, model AS model_name, count(*) AS row_count, {r('avg(abs(target - forecast))', 'mae')},
            {r('sqrt(avg((target - forecast) * (target - forecast)))', 'rmse')}
        FROM mf WHERE split = 'test' AND model = 'persistence' AND forecast IS NOT NULL GROUP BY 1, 2""",
    "best_model_per_horizon": f"WITH {MODELS} SELECT horizon, arg_min(model, rmse) AS model, {r('min(rmse)', 'rmse')} FROM mr GROUP BY 1",
    "rmse_by_horizon": f"""WITH {MODELS} SELECT horizon, model, {r('rmse', 'rmse')},
        CASE horizon WHEN 't_plus_1' THEN 1 WHEN 't_plus_24' THEN 2 ELSE 3 END::BIGINT AS horizon_order FROM mr""",
    "model_summaries": f"WITH {MODELS} SELECT horizon, model, {r('rmse', 'rmse')} FROM mr",
    "horizon_report": f"""WITH {REPORT} SELECT horizon, lead_steps, model_name,
        {', '.join(r(c, c) for c in _BASE_COLUMNS)}, {LABEL.format(c='test_coverage_80')} AS test_calibration_assessment FROM rep""",
    "horizon_comparison": f"""WITH {REPORT} SELECT horizon AS horizon_label, lead_steps AS lead_hours, model_name AS selected_model_name,
        'HourlyNormal' AS model_family, {', '.join(r(c, c) for c in _BASE_COLUMNS)}, 'models/' || horizon AS source_summary_path,
        {LABEL.format(c='test_coverage_80')} AS test_calibration_assessment FROM rep""",
    "best_and_worst_horizon": f"""WITH {REPORT} SELECT * FROM (SELECT horizon, lead_steps, {r('test_rmse', 'test_rmse')}, {r('test_mae', 'test_mae')}, 'best' AS place FROM rep ORDER BY rep.test_rmse LIMIT 1)
        UNION ALL SELECT * FROM (SELECT horizon, lead_steps, {r('test_rmse', 'test_rmse')}, {r('test_mae', 'test_mae')}, 'worst' AS place FROM rep ORDER BY rep.test_rmse DESC LIMIT 1)""",
    "horizon_statement": f"""WITH {REPORT} SELECT printf('The strongest horizon is %s with test RMSE %.2f, the weakest is %s with test RMSE %.2f. The 80%% prediction intervals are %s.',
        arg_min(horizon, test_rmse), min(test_rmse), arg_max(horizon, test_rmse), max(test_rmse),
        string_agg(DISTINCT label, ', ' ORDER BY label)) AS summary_statement
        FROM (SELECT *, {LABEL.format(c='test_coverage_80')} AS label FROM rep)""",
    "coverage_by_horizon": f"""WITH {FORECASTS} SELECT horizon, CASE horizon WHEN 't_plus_1' THEN 1 WHEN 't_plus_24' THEN 2 ELSE 3 END::BIGINT AS horizon_order,
        {r(M['coverage_80'], 'coverage')}, 0.8::DOUBLE AS nominal FROM fc WHERE split = 'test' GROUP BY 1""",
    "baseline_report": f"""WITH {BASELINES} SELECT horizon, model_name, model_family, {', '.join(r(c, c) for c in _BASE_COLUMNS)},
        {r('test_rmse', 'primary_selection_metric')}, 'test_rmse' AS selection_metric_name FROM base""",
    "baseline_interpretation": f"""WITH {BASELINES},
        pick AS (SELECT horizon, arg_min(model_name, test_rmse) AS p, arg_min(model_name, test_pinball_q50) FILTER (test_pinball_q50 IS NOT NULL) AS q,
            arg_min(test_coverage_80, test_pinball_q50) FILTER (test_pinball_q50 IS NOT NULL) AS c FROM base GROUP BY horizon),
        lbl AS (SELECT *, {LABEL.format(c='c')} AS label FROM pick)
        SELECT horizon, p AS best_point_forecast_model, q AS best_probabilistic_model, label AS interval_calibration_assessment,
            printf('The strongest current point-forecast baseline is %s, and the strongest probabilistic baseline is %s. The observed 80%% interval coverage is %.4f, which is %s relative to the nominal target.', p, q, c, label) AS summary_statement
        FROM lbl""",
    "last_n": f"""WITH {FORECASTS}, n AS (SELECT *, row_number() OVER ({BY_TYPE}, horizon ORDER BY ts DESC) AS rn FROM fc)
        SELECT event_type, horizon, ts, {r('target', 'target')}, {r('pred_q10', 'pred_q10')}, {r('pred_q50', 'pred_q50')}, {r('pred_q90', 'pred_q90')},
            (row_number() OVER ({BY_TYPE}, horizon ORDER BY ts) - 1)::INTEGER AS sequence FROM n WHERE rn <= 200""",
    "last_n_overall": f"""WITH {OVERALL}, n AS (SELECT * FROM overall ORDER BY ts DESC LIMIT 200)
        SELECT ts, {r('value', 'value')}, (row_number() OVER (ORDER BY ts) - 1)::INTEGER AS sequence FROM n""",
    "position_to_timestamp": f"SELECT l_orderkey, l_linenumber, {POINT_TIME} AS ts, l_quantity AS quantity FROM lineitem",
    "resolution_minutes": f"SELECT {RESOLUTION} AS resolution, {MINUTES}::INTEGER AS minutes, count(*) AS points FROM lineitem GROUP BY 1, 2",
    "points_to_hourly": f"""WITH p AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'UNKNOWN' END AS psr_type,
            CASE WHEN o_orderpriority <> '5-LOW' THEN substr(o_orderpriority, 1, 1) END AS business_type,
            {POINT_TIME} AS t, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        u AS (SELECT psr_type, business_type, t, avg(q) AS q FROM p WHERE business_type IS NOT NULL GROUP BY ALL),
        h AS (SELECT psr_type, business_type, date_trunc('hour', t) AS ts, avg(q) AS q FROM u GROUP BY 1, 2, 3),
        g AS (SELECT psr_type, business_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1, 2)
        SELECT g.psr_type, g.business_type, g.ts AS timestamp_utc, {r('h.q', 'generation_mw')} FROM g
            LEFT JOIN h ON h.psr_type = g.psr_type AND h.business_type = g.business_type AND h.ts = g.ts""",
    "redact_url": "SELECT page_id, regexp_replace(url || '?securityToken=TEST' || page_id || '&page=1', '(securityToken=)[^&]+', '\\1REDACTED', 'g') AS url FROM pages",
    "text_to_number": """SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
        TRY_CAST(substr(o_orderpriority, 3) AS DOUBLE) AS bad_number, CAST(o_orderkey AS DOUBLE) AS good_number,
        date_trunc('second', o_orderdate) AS parsed, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'UNKNOWN' END AS status FROM orders""",
    "json_hour_map": f"""WITH {SERIES},
        known AS (SELECT *, date_trunc('day', ts) AS d FROM series WHERE value IS NOT NULL),
        first_type AS (SELECT d, min(event_type) AS event_type FROM known GROUP BY d),
        hrs AS (SELECT k.ts FROM known k JOIN first_type f ON f.d = k.d AND f.event_type = k.event_type)
        SELECT strftime(h.ts, '%Y%m%d%H') AS hour_key, {', '.join(r(f"max(k.value) FILTER (k.event_type = '{t}')", t) for t in TYPES)}, h.ts
        FROM hrs h LEFT JOIN known k ON k.ts = h.ts GROUP BY h.ts""",
    "least_squares_fit": f"""WITH e AS (SELECT event_type, value AS y, hour(ts)::DOUBLE AS x, user_id::DOUBLE AS z FROM events
            WHERE value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL),
        m AS (SELECT event_type, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, var_pop(y) AS yy,
            covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM e GROUP BY 1),
        b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM m)
        SELECT event_type, n, {r('my - b1 * mx - b2 * mz', 'b0')}, {r('b1', 'b1')}, {r('b2', 'b2')}, {r('n * (yy - b1 * xy - b2 * zy)', 'rss')} FROM b""",
    "xml_points": """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY ALL)
        SELECT 'events' AS dataset_name, dense_rank() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_type)::INTEGER AS series_index,
            'A01' AS business_type, event_type AS psr_type, 'PT60M' AS resolution, (hour(ts) + 1)::INTEGER AS position,
            n::DOUBLE AS quantity, ts FROM h""",
}
