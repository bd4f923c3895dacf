"""DuckDB SQL for the registered queries, written against the driver's tables on its own."""

from __future__ import annotations

_CLICK = """c AS (
 SELECT e.ts AS event_time, CASE e.event_type WHEN 'click' THEN 'cart' WHEN 'error' THEN 'remove_from_cart' WHEN 'signup' THEN 'other' ELSE e.event_type END AS event_type,
  e.k AS product_id, CAST(NULL AS BIGINT) AS category_id, p.p_type AS category_code, p.p_brand AS brand, e.value AS price, e.user_id,
  CAST(e.user_id AS VARCHAR) || '-' || strftime(e.ts, '%Y%m%d') AS user_session
 FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events) e LEFT JOIN part p ON p.p_partkey = e.k)"""
_RETAIL = """r AS (
 SELECT o_orderdate AS event_time, 'purchase' AS event_type, l_partkey AS product_id, CAST(NULL AS BIGINT) AS category_id, p_type AS category_code, p_brand AS brand,
  l_extendedprice AS price, o_custkey AS user_id, CAST(o_orderkey AS VARCHAR) AS user_session
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _products(t: str, where: str = "TRUE") -> str:
    return f"""products AS (SELECT product_id, category_id, coalesce(category_code, 'unknown') AS category_code, coalesce(brand, 'unknown') AS brand, current_price FROM (
 SELECT product_id, category_id, category_code, brand, price AS current_price, row_number() OVER (PARTITION BY product_id
  ORDER BY event_time DESC, price DESC NULLS LAST, category_code DESC NULLS LAST, brand DESC NULLS LAST) AS nth FROM {t} WHERE {where}) WHERE nth = 1)"""


def _n(kind: str, test: str = "") -> str:
    return f"count(*) FILTER (WHERE event_type = '{kind}')"


_REV = "coalesce(sum(price) FILTER (WHERE event_type = 'purchase'), 0)"
_DAY = "CAST(event_time AS DATE)"


def _users(t: str) -> str:
    return f"""users AS (SELECT user_id, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS event_count, count(DISTINCT user_session) AS session_count,
 {_REV} AS total_spend, {_n("purchase")} AS purchase_count, bool_or(event_type = 'purchase') AS is_buyer,
 max(category_code) FILTER (WHERE event_type = 'view') AS favorite_category_by_recency FROM {t} GROUP BY user_id)"""


def _sessions(t: str) -> str:
    return f"""tops AS (SELECT user_session, category_code AS top_category FROM (SELECT user_session, category_code, row_number() OVER (PARTITION BY user_session ORDER BY n DESC, category_code) AS nth
  FROM (SELECT user_session, category_code, count(*) AS n FROM {t} WHERE category_code IS NOT NULL GROUP BY 1, 2)) WHERE nth = 1),
sessions AS (SELECT s.*, top_category FROM (SELECT user_session, max(user_id) AS user_id, min(event_time) AS session_start, max(event_time) AS session_end,
  date_diff('second', min(event_time), max(event_time)) AS duration_sec, count(*) AS event_count, bool_or(event_type = 'view') AS has_view, bool_or(event_type = 'cart') AS has_cart,
  bool_or(event_type = 'remove_from_cart') AS has_remove, bool_or(event_type = 'purchase') AS has_purchase, {_REV} AS session_revenue
  FROM {t} WHERE user_session IS NOT NULL GROUP BY user_session) s LEFT JOIN tops USING (user_session))"""


def _days(t: str, variant: str = "f") -> str:
    names = ("total_events", "total_views", "total_carts", "total_purchases") if variant == "f" else ("daily_events", "views", "carts", "purchases")
    return f"""days AS (SELECT {_DAY} AS date, count(*) AS {names[0]}, count(DISTINCT user_id) AS dau, count(DISTINCT user_session) AS daily_sessions, {_REV} AS daily_revenue,
 {_n("purchase")} AS {names[3]}, {_n("cart")} AS {names[2]}, {_n("view")} AS {names[1]} FROM {t} GROUP BY 1)"""


def _rfm(t: str) -> str:
    return f"""base AS (SELECT user_id, date_diff('day', max(event_time), (SELECT max(event_time) FROM {t})) AS recency_days, count(*) AS frequency_count, sum(price) AS monetary_value
  FROM {t} WHERE event_type = 'purchase' GROUP BY user_id),
scores AS (SELECT *, 6 - ntile(5) OVER (ORDER BY recency_days, user_id) AS r, ntile(5) OVER (ORDER BY frequency_count, user_id) AS f, ntile(5) OVER (ORDER BY monetary_value, user_id) AS m FROM base),
rfm AS (SELECT user_id, CAST(recency_days AS INTEGER) AS recency_days, frequency_count, monetary_value, CAST(r AS INTEGER) AS r_score, CAST(f AS INTEGER) AS f_score, CAST(m AS INTEGER) AS m_score,
  CAST(r AS VARCHAR) || CAST(f AS VARCHAR) || CAST(m AS VARCHAR) AS rfm_code,
  CASE WHEN r >= 4 AND f >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 THEN 'Loyal Customers' WHEN r >= 4 AND f = 1 THEN 'New Customers' WHEN r >= 3 AND f = 1 THEN 'Promising'
   WHEN r = 2 AND f >= 2 THEN 'Need Attention' WHEN r = 1 AND f >= 4 THEN 'Cant Lose Them' WHEN r = 1 AND f <= 2 THEN 'Hibernating' ELSE 'At Risk' END AS segment_name FROM scores)"""


_SHOWN_RFM = "user_id, recency_days, frequency_count, round(monetary_value, 4) AS monetary_value, r_score, f_score, m_score, rfm_code, segment_name"
_BEHAVIOUR = """behaviour AS (SELECT user_id, count(user_session) AS total_sessions, avg(duration_sec) AS avg_session_duration, coalesce(stddev_samp(duration_sec), 0) AS std_session_duration,
 avg(event_count) AS avg_events_per_session, count(*) FILTER (WHERE has_cart) / CAST(count(user_session) AS DOUBLE) AS cart_rate,
 coalesce(count(*) FILTER (WHERE has_purchase) / nullif(CAST(count(*) FILTER (WHERE has_cart) AS DOUBLE), 0), 0) AS checkout_rate FROM sessions GROUP BY user_id)"""
_WIDE = """wide AS (SELECT u.user_id, total_spend, purchase_count, event_count, first_seen, last_seen, coalesce(recency_days, -1) AS recency_days, coalesce(frequency_count, 0) AS frequency_raw,
 coalesce(monetary_value, 0) AS monetary_raw, coalesce(segment_name, 'Browser') AS rfm_segment, coalesce(rfm_code, '000') AS rfm_code, coalesce(total_sessions, 0) AS total_sessions,
 coalesce(avg_session_duration, 0) AS avg_session_duration, coalesce(std_session_duration, 0) AS std_session_duration, coalesce(avg_events_per_session, 0) AS avg_events_per_session,
 coalesce(cart_rate, 0) AS cart_rate, coalesce(checkout_rate, 0) AS checkout_rate FROM users u LEFT JOIN rfm USING (user_id) LEFT JOIN behaviour b ON b.user_id = u.user_id)"""


def _rules(variant: str, least: int, lift: float | None) -> str:
    count, less = ("count(*)", "<>") if variant == "f" else ("count(DISTINCT a.user_session)", "<")
    support = "count(*)" if variant == "f" else "count(DISTINCT user_session)"
    keep = "TRUE" if lift is None else f"lift > {lift}"
    return f"""pairs AS (SELECT a.product_id AS product_a, b.product_id AS product_b, {count} AS pair_count FROM r a JOIN r b ON a.user_session = b.user_session AND a.product_id {less} b.product_id
  GROUP BY ALL HAVING {count} >= {least}),
support AS (SELECT product_id, CAST({support} AS DOUBLE) AS n FROM r GROUP BY 1),
all_rules AS (SELECT product_a, product_b, pair_count, pair_count / pa.n AS confidence, CAST(pair_count AS DOUBLE) * (SELECT count(DISTINCT user_session) FROM r) / (pa.n * pb.n) AS lift
  FROM pairs JOIN support pa ON product_a = pa.product_id JOIN support pb ON product_b = pb.product_id),
rules AS (SELECT * FROM all_rules WHERE {keep})"""


_SHOWN_RULES = "product_a, product_b, pair_count, round(confidence, 4) AS confidence, round(lift, 4) AS lift"
_STAGES = f"count(*) AS total_events, {_n('view')} AS views, {_n('cart')} AS carts, {_n('purchase')} AS purchases"
_BY_PRODUCT = f"""firsts AS (SELECT product_id, price, brand, category_code FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY event_time, price, brand, category_code) AS nth FROM c) WHERE nth = 1),
by_product AS (SELECT s.product_id, total_events, views, carts, purchases, price, brand, category_code, unique_users FROM
 (SELECT product_id, {_STAGES}, count(DISTINCT user_id) AS unique_users FROM c GROUP BY 1) s LEFT JOIN firsts USING (product_id))"""
_BY_USER = f"by_user AS (SELECT user_id, {_STAGES}, count(DISTINCT product_id) AS unique_products, {_REV} AS total_spent FROM c GROUP BY 1)"
_BY_DAY = f"by_day AS (SELECT {_DAY} AS date, event_type, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, {_REV} AS revenue FROM c GROUP BY 1, 2)"
_TREND = f"trend AS (SELECT {_DAY} AS date, count(*) AS events, count(DISTINCT user_id) AS dau, {_REV} AS revenue FROM c GROUP BY 1)"
_WEEKLY = """cohorts AS (SELECT user_id, date_trunc('week', min(event_time)) AS cohort_week FROM r GROUP BY 1),
active AS (SELECT DISTINCT user_id, date_trunc('week', event_time) AS activity_week FROM r),
sizes AS (SELECT cohort_week, count(*) AS cohort_size FROM cohorts GROUP BY 1),
weekly AS (SELECT cohort_week, weeks_since_first, cohort_size, active_users, active_users / CAST(cohort_size AS DOUBLE) AS retention_rate FROM
 (SELECT cohort_week, CAST(date_diff('day', cohort_week, activity_week) // 7 AS BIGINT) AS weeks_since_first, count(*) AS active_users FROM active JOIN cohorts USING (user_id) GROUP BY 1, 2) JOIN sizes USING (cohort_week))"""
_TESTED = "tested AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, CAST(purchase_count > 12 AS INTEGER) AS converted FROM users)"
_FRAME = """frame AS (SELECT a.*, CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END AS target FROM (
 SELECT user_id, count(*) AS events, count(DISTINCT user_session) AS sessions, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'cart') AS carts,
  count(*) FILTER (WHERE event_type = 'remove_from_cart') AS removes, CAST(date_diff('day', min(event_time), max(event_time)) AS INTEGER) AS active_span_days,
  CAST(date_diff('day', max(event_time), TIMESTAMP '2001-02-01') AS INTEGER) AS recency_days FROM r WHERE event_time < TIMESTAMP '2001-02-01' GROUP BY 1) a
 LEFT JOIN (SELECT DISTINCT user_id FROM r WHERE event_time >= TIMESTAMP '2001-02-01' AND event_type = 'purchase') b USING (user_id))"""


def _mix(name: str, where: str = "TRUE") -> str:
    return f"SELECT '{name}' AS dataset, event_type, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM c WHERE {where} GROUP BY event_type"


def _pct(part: str, whole: str, places: int = 4) -> str:
    return f"round(coalesce(100.0 * {part} / nullif(CAST({whole} AS DOUBLE), 0), 0), {places})"


def _profile() -> str:
    rows = []
    for name, kind, numeric in (
        ("event_time", "timestamp_ntz", False), ("event_type", "string", False), ("product_id", "bigint", True), ("category_id", "bigint", True), ("category_code", "string", False),
        ("brand", "string", False), ("price", "double", True), ("user_id", "bigint", True), ("user_session", "string", False),
    ):
        values = [f"round(CAST({g}({name}) AS DOUBLE), 4)" if numeric else "CAST(NULL AS DOUBLE)" for g in ("min", "max", "avg")]
        rows.append(f"SELECT '{name}' AS column_name, '{kind}' AS data_type, count(*) AS \"rows\", count(*) - count({name}) AS nulls, {values[0]} AS min_value, {values[1]} AS max_value, {values[2]} AS mean_value FROM r")
    return _with(_RETAIL) + "\nUNION ALL ".join(rows)


def _top(column: str) -> str:
    return _with(_CLICK) + f"SELECT coalesce({column}, 'unknown') AS {column}, count(*) AS events, count(DISTINCT user_id) AS users, {_n('purchase')} AS purchases FROM c GROUP BY 1 ORDER BY events DESC, 1 LIMIT 15"


def _arm(name: str) -> str:
    x = f"FILTER (WHERE variant = '{name}')"
    return f"count(*) {x} AS {name}_n, avg(converted) {x} AS {name}_rate, var_samp(converted) {x} / count(*) {x} AS {name}_v"


def _hash(seed: int | str, *columns: str) -> str:
    text = " || '|' || ".join([*(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns), f"'{seed}'"])
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


_TILED = "tiled AS (SELECT user_id, ntile(5) OVER (ORDER BY n, user_id) AS quintile FROM (SELECT user_id, count(*) AS n FROM r GROUP BY 1))"


def _firsts(rows: str, stratum: str, part: str, seed: int) -> str:
    return f"""firsts AS (SELECT user_id, {stratum} FROM (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {_hash(seed, "user_id")}, user_id) AS nth, count(*) OVER (PARTITION BY {stratum}) AS n FROM {rows})
 WHERE nth <= ceil(n * CAST({part} AS DOUBLE)))"""


def _compact(x: str) -> str:
    steps = "".join(f"WHEN abs({x}) >= {size} THEN printf('%.1f{unit}', {x} / {size}) " for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")))
    return f"CASE {steps}ELSE printf('%.0f', CAST({x} AS DOUBLE)) END"


_Z = "1.959963984540054"
_FEATURES = (_CLICK, _users("c"), _sessions("c"), _rfm("c"), _BEHAVIOUR, _WIDE)
_D = {"f": _with(_RETAIL, _rules("f", 2, 1.2), _products("r"))}

_AB = (
    f"arms AS (SELECT {_arm('control')}, {_arm('treatment')} FROM tested)",
    "facts AS (SELECT *, control_rate AS p, treatment_rate AS q, treatment_rate - control_rate AS diff, control_v + treatment_v AS v, sqrt(control_rate * (1 - control_rate) / control_n + treatment_rate * (1 - treatment_rate) / treatment_n) AS se FROM arms)",
    f"""stats AS (SELECT control_n, treatment_n, control_rate, treatment_rate, diff / p AS lift, diff / sqrt(v) AS t_stat,
 v * v / (control_v * control_v / (control_n - 1) + treatment_v * treatment_v / (treatment_n - 1)) AS df, diff / se AS z_stat, diff - {_Z} * se AS ci_lower, diff + {_Z} * se AS ci_upper,
 diff / sqrt((p * (1 - p) + q * (1 - q)) / 2) AS effect_size FROM facts)""",
)
_AB_DOUBLES = ["control_rate", "treatment_rate", "lift", "t_stat", "df", "z_stat", "ci_lower", "ci_upper", "effect_size"]


def _integral(f: str, start: str, width: str) -> str:
    """Simpson's rule over 1000 steps of f, an expression of {x}."""
    x = f"({start} + ({width}) * i / 1000)"
    return f"(list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 ELSE 2 + 2 * (i % 2) END) * {f.format(x=x)})) * ({width}) / 3000)"


def _angle_tail(a: str, k: str) -> str:
    """Tail of Student's t by the angle whose tangent is t / sqrt(df), with k = df - 1, before it is divided by the whole."""
    return _integral(f"pow(greatest(cos({{x}}), 0), {k})", a, f"least(pi() / 2 - {a}, sqrt(80 / ({k} + 1e-300)), 40 / ({k} * tan({a}) + 1e-300))")


def _normal_below(x: str) -> str:
    """Abramowitz and Stegun 7.1.26."""
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    above = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x}) / 2) / 2)"
    return f"(CASE WHEN {x} < 0 THEN {above} ELSE 1 - {above} END)"


#: The density of the sample's deviation, but for a constant, and its range.
_SPREAD = "exp((dn - 1) * ln({x}) - dn * ({x} * {x} - 1) / 2)"
_SPAN = ("greatest(1e-9, 1 - 10 / sqrt(dn))", "1 + 10 / sqrt(dn) - greatest(1e-9, 1 - 10 / sqrt(dn))")
#: p values and power of stats; the critical value by Newton's steps.
_DECIDED = (
    f"step0 AS (SELECT *, df - 1 AS kt, atan(abs(t_stat) / sqrt(df)) AS theta, abs(z_stat) AS az, CAST(2 * control_n - 2 AS DOUBLE) AS dn, CAST(2 * control_n - 3 AS DOUBLE) AS kn, abs(effect_size) * sqrt(control_n / 2) AS shift, atan({_Z} / sqrt(2.0 * control_n - 2)) AS angle FROM stats)",
    f"whole AS (SELECT *, {_angle_tail('0', 'kn')} AS total FROM step0)",
    *(f"step{i} AS (SELECT * REPLACE (angle + ({_angle_tail('angle', 'kn')} - 0.05 * total) / pow(cos(angle), kn) AS angle) FROM {'whole' if i == 1 else f'step{i - 1}'})" for i in range(1, 8)),
    "critical AS (SELECT *, tan(angle) * sqrt(dn) AS cut FROM step7)",
    f"""decided AS (SELECT *, {_angle_tail('theta', 'kt')} / {_angle_tail('0', 'kt')} AS t_p_value, sqrt(2 / pi()) * {_integral('exp(-{x} * {x} / 2)', 'az', 'least(sqrt(80), 40 / (az + 1e-300))')} AS z_p_value,
 {_integral(_SPREAD + ' * (' + _normal_below('(shift - cut * {x})') + ' + ' + _normal_below('(-shift - cut * {x})') + ')', *_SPAN)} / {_integral(_SPREAD, *_SPAN)} AS power FROM critical)""",
)
SQL: dict[str, str] = {
    "dim_products_f": _with(_RETAIL, _products("r")) + "SELECT product_id, category_id, category_code, brand, round(current_price, 4) AS current_price FROM products",
    "dim_products_c": _with(_CLICK, _products("c", "product_id IS NOT NULL")) + "SELECT product_id, category_id, category_code, brand, round(current_price, 4) AS current_price FROM products",
    "dim_users_f": _with(_CLICK, _users("c")) + "SELECT * REPLACE (round(total_spend, 4) AS total_spend) FROM users",
    "dim_users_c": _with(_RETAIL, _users("r")) + "SELECT user_id, first_seen, last_seen, event_count, session_count, round(total_spend, 4) AS total_spend, purchase_count, CAST(is_buyer AS INTEGER) AS is_buyer FROM users",
    "favorite_category": _with(_CLICK) + "SELECT user_id, category_code AS last_viewed_category FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, category_code DESC NULLS LAST) AS nth FROM c WHERE event_type = 'view') WHERE nth = 1",
    "daily_kpis_f": _with(_RETAIL, _days("r")) + "SELECT * REPLACE (round(daily_revenue, 4) AS daily_revenue) FROM days",
    "daily_kpis_c": _with(_CLICK, _days("c", "c")) + "SELECT * REPLACE (round(daily_revenue, 4) AS daily_revenue) FROM days",
    "sessions_f": _with(_CLICK, _sessions("c")) + "SELECT * REPLACE (round(session_revenue, 4) AS session_revenue) FROM sessions",
    "sessions_c": _with(_CLICK)
    + f"""SELECT user_session, user_id, min(event_time) AS session_start, max(event_time) AS session_end, CAST(round(epoch_us(max(event_time)) / 1e6 - epoch_us(min(event_time)) / 1e6) AS BIGINT) AS duration_sec,
 count(*) AS event_count, count(DISTINCT product_id) AS unique_products, CAST(bool_or(event_type = 'purchase') AS INTEGER) AS has_purchase, round({_REV}, 4) AS session_revenue FROM c GROUP BY ALL""",
    "rfm_f": _with(_RETAIL, _rfm("r")) + f"SELECT {_SHOWN_RFM} FROM rfm",
    "rfm_c": _with(_RETAIL)
    + ", " + """base AS (SELECT user_id, date_diff('day', CAST(max(event_time) AS DATE), DATE '2001-08-01') AS recency_days, count(DISTINCT CAST(event_time AS DATE)) AS frequency, sum(price) AS monetary FROM r GROUP BY 1),
scores AS (SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, user_id) AS r_score, ntile(5) OVER (ORDER BY frequency, user_id) AS f_score, ntile(5) OVER (ORDER BY monetary, user_id) AS m_score FROM base)
SELECT user_id, CAST(recency_days AS INTEGER) AS recency_days, frequency, round(monetary, 4) AS monetary, CAST(r_score AS INTEGER) AS r_score, CAST(f_score AS INTEGER) AS f_score, CAST(m_score AS INTEGER) AS m_score,
 CAST(r_score + f_score + m_score AS INTEGER) AS rfm_total, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal Customers' WHEN r_score >= 4 AND f_score <= 2 THEN 'Promising'
 WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk' WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost' ELSE 'Regular' END AS segment FROM scores""",
    "rfm_base": _with(_RETAIL, _rfm("r")) + "SELECT user_id, CAST(recency_days AS INTEGER) AS recency_days, frequency_count, round(monetary_value, 4) AS monetary_value FROM base",
    "affinity_f": _with(_RETAIL, _rules("f", 2, 1.2)) + f"SELECT {_SHOWN_RULES} FROM rules",
    "affinity_c": _with(_RETAIL, _rules("c", 2, 1.2)) + f"SELECT {_SHOWN_RULES} FROM rules",
    "affinity_nofilter": _with(_RETAIL, _rules("c", 2, None)) + f"SELECT {_SHOWN_RULES} FROM rules",
    "session_funnel": _with(_CLICK, _sessions("c"))
    + """SELECT v AS sessions_with_view, k AS sessions_with_cart, p AS sessions_with_purchase, round(k / CAST(v AS DOUBLE), 4) AS view_to_cart_rate, round(p / CAST(k AS DOUBLE), 4) AS cart_to_purchase_rate,
 round(p / CAST(n AS DOUBLE), 4) AS overall_conversion FROM (SELECT count(*) FILTER (WHERE has_view) AS v, count(*) FILTER (WHERE has_cart) AS k, count(*) FILTER (WHERE has_purchase) AS p, count(*) AS n FROM sessions)""",
    "session_stats": _with(_CLICK, _sessions("c")) + "SELECT count(*) AS sessions, round(avg(duration_sec), 4) AS avg_duration_sec FROM sessions",
    "session_features": _with(_CLICK, _sessions("c"), _BEHAVIOUR)
    + "SELECT user_id, total_sessions, round(avg_session_duration, 4) AS avg_session_duration, round(std_session_duration, 4) AS std_session_duration, round(avg_events_per_session, 4) AS avg_events_per_session, round(cart_rate, 4) AS cart_rate, round(checkout_rate, 4) AS checkout_rate FROM behaviour",
    "feature_table": _with(*_FEATURES) + "SELECT * REPLACE (" + ", ".join(f"round({x}, 4) AS {x}" for x in ("total_spend", "monetary_raw", "avg_session_duration", "std_session_duration", "avg_events_per_session", "cart_rate", "checkout_rate")) + ") FROM wide",
    "segment_profile": _with(_RETAIL, _rfm("r")) + "SELECT segment_name, count(*) AS user_count, round(avg(monetary_value), 2) AS avg_spend, round(avg(recency_days), 1) AS avg_recency, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM rfm GROUP BY 1",
    "segment_coverage": _with(*_FEATURES) + "SELECT rfm_segment, count(*) AS users FROM wide GROUP BY 1",
    "weekly_retention": _with(_RETAIL, _WEEKLY) + "SELECT CAST(cohort_week AS TIMESTAMP) AS cohort_week, weeks_since_first, cohort_size, active_users, round(retention_rate, 4) AS retention_rate FROM weekly",
    "retention_matrix": _with(_RETAIL, _WEEKLY) + "SELECT CAST(cohort_week AS TIMESTAMP) AS cohort_week, " + ", ".join(f'max(round(retention_rate, 3)) FILTER (WHERE weeks_since_first = {w}) AS "{w}"' for w in range(12)) + " FROM weekly GROUP BY 1",
    "retention_matrix_all": _with(_RETAIL, _WEEKLY)
    + "SELECT CAST(cohort_week AS TIMESTAMP) AS cohort_week, max(cohort_size) AS cohort_size, count(*) AS weeks, string_agg(weeks_since_first || ':' || CAST(round(retention_rate * 1000) AS BIGINT), ' ' ORDER BY weeks_since_first) AS rates FROM weekly GROUP BY 1",
    "events_by_day": _with(_RETAIL) + "SELECT event_time, product_id, round(price, 4) AS price, user_id, user_session FROM r WHERE event_time >= TIMESTAMP '1995-11-05' AND event_time < TIMESTAMP '1996-03-01'",
    "events_slices": _with(_RETAIL, "n AS (SELECT count(*) AS n FROM r)")
    + "SELECT least(7000, n - 7000 * i) AS rows, 'zstd' AS codec, CAST(i + 1 AS INTEGER) AS nth FROM n, range(0, CAST((SELECT (n + 6999) // 7000 FROM n) AS BIGINT)) t(i)",
    "events_lookup": _with(_RETAIL) + "SELECT * REPLACE (round(price, 4) AS price) FROM r WHERE product_id IN (7, 77, 177) OR brand = 'Brand#23' AND price > 50000",
    "column_statistics": _with(_RETAIL)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, {f'CAST(min({c}) AS VARCHAR)' if shown else 'CAST(NULL AS VARCHAR)'} AS least, {f'CAST(max({c}) AS VARCHAR)' if shown else 'CAST(NULL AS VARCHAR)'} AS greatest FROM r"
        for c, shown in {"event_time": 0, "event_type": 1, "product_id": 1, "category_id": 0, "category_code": 0, "brand": 1, "price": 0, "user_id": 1, "user_session": 1}.items()
    ),
    "churn_status": _with(_RETAIL, _users("r"))
    + "SELECT user_id, last_seen, CAST(d AS INTEGER) AS days_inactive, CASE WHEN d > 14 THEN 'Churned' WHEN d > 7 THEN 'At Risk' ELSE 'Active' END AS status FROM (SELECT *, date_diff('day', CAST(last_seen AS DATE), DATE '2001-08-01') AS d FROM users)",
    "churn_counts": _with(_RETAIL, _users("r"))
    + "SELECT CASE WHEN d > 14 THEN 'Churned' WHEN d > 7 THEN 'At Risk' ELSE 'Active' END AS status, count(*) AS users FROM (SELECT date_diff('day', last_seen, (SELECT max(event_time) FROM r)) AS d FROM users) GROUP BY 1",
    "baskets": _with(_CLICK) + "SELECT user_session, product_id FROM c WHERE event_type = 'purchase'",
    "product_pairs": _with(_RETAIL, _rules("f", 2, None)) + "SELECT product_a, product_b, pair_count FROM pairs",
    "product_support": _with(_RETAIL) + "SELECT product_id, count(*) AS support FROM r GROUP BY 1",
    "total_purchase_sessions": _with(_CLICK) + "SELECT count(DISTINCT user_session) AS total FROM c WHERE event_type = 'purchase'",
    "top_pairs_preview": _D["f"]
    + f"""SELECT {_SHOWN_RULES}, a.brand AS brand_a, a.category_code AS category_a, b.brand AS brand_b, b.category_code AS category_b FROM (SELECT * FROM rules ORDER BY pair_count DESC, product_a, product_b LIMIT 10)
 JOIN products a ON product_a = a.product_id JOIN products b ON product_b = b.product_id""",
    "brands_with_rules": _D["f"] + "SELECT DISTINCT brand FROM rules JOIN products ON product_a = product_id WHERE brand <> 'unknown'",
    "products_with_rules": _D["f"] + "SELECT DISTINCT category_code, product_id FROM rules JOIN products ON product_a = product_id WHERE brand = 'Brand#11' ORDER BY 1, 2 LIMIT 50",
    "recommend_topk": _with(_RETAIL, _rules("f", 2, 1.2)) + f"SELECT {_SHOWN_RULES}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY product_a ORDER BY lift DESC, product_b) AS rank FROM rules) WHERE rank <= 6",
    "dataset_overview": _with(_CLICK)
    + "SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, count(DISTINCT product_id) AS unique_products, count(DISTINCT user_session) AS unique_sessions, count(DISTINCT brand) AS unique_brands, count(DISTINCT category_code) AS unique_categories, min(event_time) AS first_event, max(event_time) AS last_event FROM c",
    "event_mix": _with(_CLICK) + "SELECT event_type, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM c GROUP BY 1",
    "event_funnel": _with(_CLICK)
    + f"SELECT v AS views, k AS carts, p AS purchases, {_pct('k', 'v')} AS view_to_cart_pct, {_pct('p', 'k')} AS cart_to_purchase_pct, {_pct('p', 'v')} AS view_to_purchase_pct, round(CASE WHEN k > 0 THEN 100 - 100.0 * p / CAST(k AS DOUBLE) ELSE 0 END, 4) AS cart_abandonment_pct FROM (SELECT {_n('view')} AS v, {_n('cart')} AS k, {_n('purchase')} AS p FROM c)",
    "distinct_session_funnel": _with(_CLICK) + "SELECT " + ", ".join(f"count(DISTINCT user_session) FILTER (WHERE event_type = '{k}') AS {k}_sessions" for k in ("view", "cart", "purchase")) + " FROM c",
    "daily_trend": _with(_CLICK, _TREND) + "SELECT * REPLACE (round(revenue, 4) AS revenue) FROM trend",
    "daily_trend_stats": _with(_CLICK, _TREND) + "SELECT round(avg(events), 4) AS avg_events, max(events) AS peak_events, round(avg(dau), 4) AS avg_dau, max(dau) AS peak_dau, round(sum(revenue), 4) AS total_revenue, round(max(revenue), 4) AS peak_revenue FROM trend",
    "price_percentiles": _with(_RETAIL)
    + "SELECT round(min(price), 4) AS min_price, " + ", ".join(f"round(quantile_cont(price, {q}), 4) AS p{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", round(max(price), 4) AS max_price, round(avg(price), 4) AS avg_price FROM r WHERE price > 0",
    "price_bands": _with(_CLICK)
    + f"""SELECT CAST(CASE WHEN price < 10 THEN 1 WHEN price < 50 THEN 2 WHEN price < 100 THEN 3 WHEN price < 500 THEN 4 WHEN price < 1000 THEN 5 ELSE 6 END AS INTEGER) AS band_rank,
 CASE WHEN price < 10 THEN '$0-10' WHEN price < 50 THEN '$10-50' WHEN price < 100 THEN '$50-100' WHEN price < 500 THEN '$100-500' WHEN price < 1000 THEN '$500-1K' ELSE '$1K+' END AS price_band,
 count(*) AS events, {_n("purchase")} AS purchases FROM c WHERE price > 0 GROUP BY 1, 2""",
    "top_categories": _top("category_code"),
    "top_brands": _top("brand"),
    "category_performance": _with(_RETAIL) + "SELECT category_code, count(*) AS total_events, count(*) AS purchases FROM r WHERE category_code IS NOT NULL GROUP BY 1 ORDER BY purchases DESC, 1 LIMIT 15",
    "brand_performance": _with(_CLICK, _BY_PRODUCT) + "SELECT brand, count(*) AS product_count, CAST(sum(purchases) AS BIGINT) AS total_purchases, CAST(sum(views) AS BIGINT) AS total_views FROM by_product WHERE brand IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15",
    "activity_histogram": _with(_CLICK, _users("c")) + "SELECT event_count, count(*) AS users FROM users GROUP BY 1",
    "user_stats": _with(_RETAIL, _users("r"))
    + f"SELECT count(*) AS total_users, round(avg(event_count), 4) AS avg_events, median(event_count) AS median_events, max(event_count) AS max_events, count(*) FILTER (WHERE purchase_count > 0) AS buyers, {_pct('count(*) FILTER (WHERE purchase_count > 0)', 'count(*)')} AS conversion_pct FROM users",
    "user_engagement": _with(_CLICK, _BY_USER) + "SELECT round(avg(total_events), 4) AS avg_events, median(total_events) AS median_events, max(total_events) AS max_events, " + ", ".join(f"round(avg({x}), 4) AS avg_{n}" for x, n in (("views", "views"), ("carts", "carts"), ("purchases", "purchases"), ("unique_products", "unique_products"), ("total_spent", "total_spent"))) + " FROM by_user",
    "buyer_tiers": _with(_CLICK, _BY_USER)
    + "SELECT CASE WHEN purchases > 10 THEN 'High Buyer (10+)' WHEN purchases > 5 THEN 'Medium Buyer (5-10)' WHEN purchases > 0 THEN 'Low Buyer (1-5)' WHEN carts > 0 THEN 'Cart User' ELSE 'Browser Only' END AS segment, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM by_user GROUP BY 1",
    "product_stats": _with(_CLICK, _BY_PRODUCT)
    + "SELECT " + ", ".join(f"round(avg({x}), 4) AS avg_{n}" for x, n in (("total_events", "events"), ("views", "views"), ("carts", "carts"), ("purchases", "purchases"), ("unique_users", "unique_users"), ("price", "price"))) + f", round(median(price), 4) AS median_price, round(min(price), 4) AS min_price, round(max(price), 4) AS max_price, {_pct('count(*) FILTER (WHERE purchases > 0)', 'count(*)')} AS sold_pct FROM by_product",
    "top_products": _with(_CLICK) + "SELECT product_id, count(*) AS views FROM c WHERE event_type = 'view' GROUP BY 1 ORDER BY views DESC, 1 LIMIT 10",
    "daily_aggregates": _with(_CLICK, _BY_DAY, "d AS (SELECT date, sum(event_count) AS events, sum(unique_users) AS users, sum(revenue) AS revenue FROM by_day GROUP BY 1)")
    + """SELECT round(avg(events), 4) AS avg_events, round(avg(users), 4) AS avg_users, round(avg(revenue), 4) AS avg_revenue, (SELECT date FROM d ORDER BY events DESC, date DESC LIMIT 1) AS busiest_day,
 (SELECT date FROM d ORDER BY events, date LIMIT 1) AS slowest_day, round(sum(revenue), 4) AS total_revenue, (SELECT date FROM d ORDER BY revenue DESC, date DESC LIMIT 1) AS peak_revenue_day, round(max(revenue), 4) AS peak_revenue FROM d""",
    "null_profile": _with(_CLICK) + "SELECT " + ", ".join(f"count(*) - count({x}) AS {x}_nulls, {_pct(f'(count(*) - count({x}))', 'count(*)')} AS {x}_null_pct" for x in ("category_code", "brand", "user_session")) + f", {_pct('count(*) FILTER (WHERE price = 0 OR price IS NULL)', 'count(*)')} AS no_price_pct FROM c",
    "profile": _profile(),
    "events_per_session": _with(_CLICK) + "SELECT round(avg(n), 4) AS avg_events, median(n) AS median_events, max(n) AS max_events FROM (SELECT count(*) AS n FROM c GROUP BY user_session)",
    "session_characteristics": _with(_CLICK, _sessions("c")) + "SELECT round(avg(duration_sec), 4) AS avg_duration, median(duration_sec) AS median_duration, round(avg(event_count), 4) AS avg_events, round(100.0 * avg(CAST(has_purchase AS INTEGER)), 4) AS purchase_session_pct FROM sessions",
    "session_conversion": _with(_CLICK, _sessions("c")) + "SELECT round(avg(CAST(has_purchase AS INTEGER)), 4) AS conversion FROM sessions",
    "key_metrics": _with(_CLICK, _BY_USER) + f"SELECT {_pct('count(*) FILTER (WHERE purchases > 0)', 'count(*)')} AS buyer_rate_pct, round(avg(total_spent / purchases) FILTER (WHERE purchases > 0), 4) AS avg_order_value FROM by_user",
    "executive_kpis": _with(_CLICK, _days("c", "c")) + "SELECT round(sum(daily_revenue), 4) AS total_revenue, CAST(sum(purchases) AS BIGINT) AS total_orders, round(sum(daily_revenue) / nullif(sum(purchases), 0), 4) AS aov FROM days",
    "sanity_totals": _with(_CLICK, _days("c"), _users("c")) + "SELECT round(sum(daily_revenue), 4) AS total_revenue, (SELECT count(*) FROM users WHERE is_buyer) AS buyers FROM days",
    "row_counts": _with(_CLICK)
    + "SELECT 'dim_products' AS table_name, count(*) AS \"rows\" FROM (SELECT DISTINCT product_id FROM c) UNION ALL SELECT 'dim_users', count(DISTINCT user_id) FROM c UNION ALL SELECT 'fact_daily_kpis', count(DISTINCT CAST(event_time AS DATE)) FROM c UNION ALL SELECT 'fact_sessions', count(DISTINCT user_session) FROM c",
    "product_summary": _with(_CLICK, _BY_PRODUCT) + "SELECT * REPLACE (round(price, 4) AS price) FROM by_product",
    "user_summary": _with(_CLICK, _BY_USER) + "SELECT * REPLACE (round(total_spent, 4) AS total_spent) FROM by_user",
    "daily_summary": _with(_CLICK, _BY_DAY) + "SELECT * REPLACE (round(revenue, 4) AS revenue) FROM by_day",
    "summary_row_counts": _with(_CLICK, _BY_PRODUCT, _BY_USER, _BY_DAY) + "SELECT 'product_summary' AS table_name, count(*) AS \"rows\" FROM by_product UNION ALL SELECT 'user_summary', count(*) FROM by_user UNION ALL SELECT 'daily_summary', count(*) FROM by_day",
    "user_modulo_sample": _with(_CLICK) + "SELECT * REPLACE (round(price, 4) AS price) FROM c WHERE user_id % 10 = 0",
    "stratified_users": _with(_RETAIL, _TILED, _firsts("tiled", "quintile", "0.03", 5)) + "SELECT user_id, CAST(quintile AS INTEGER) AS quintile FROM firsts",
    "stratified_sample": _with(_RETAIL, _TILED, _firsts("tiled", "quintile", "0.2", 5)) + f"SELECT * REPLACE (round(price, 4) AS price) FROM r WHERE user_id IN (SELECT user_id FROM firsts) AND {_hash(5, 'user_session', 'product_id')} % 1000000 < 500000",
    "rfm_scatter_sample": _with(_RETAIL, _rfm("r")) + f"SELECT {_SHOWN_RFM} FROM rfm ORDER BY {_hash(7, 'user_id')}, user_id LIMIT 500",
    "variant_assignment": _with(_CLICK) + f"SELECT DISTINCT user_id, CASE WHEN {_hash('checkout', 'user_id')} % 10000 < 5000 THEN 'treatment' ELSE 'control' END AS variant FROM c",
    "recommend_named": _D["f"]
    + f"""SELECT {_SHOWN_RULES}, CAST(rank AS INTEGER) AS rank, brand AS brand_b, category_code AS category_b FROM (SELECT *, row_number() OVER (PARTITION BY product_a ORDER BY lift DESC, product_b) AS rank FROM rules)
 JOIN products ON product_b = product_id WHERE rank <= 6""",
    "split_by_class": _with(_RETAIL, _FRAME, _firsts("frame", "target", "0.2", 42)) + "SELECT user_id, target, CASE WHEN user_id IN (SELECT user_id FROM firsts) THEN 'test' ELSE 'train' END AS side FROM frame",
    "roc_auc": _with(_RETAIL, _FRAME, "scored AS (SELECT target, events / (1.0 + recency_days) AS score FROM frame)",
        "ranked AS (SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM scored)")
    + "SELECT round((sum(place) FILTER (WHERE target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * CAST(count(*) - sum(target) AS DOUBLE)), 4) AS roc_auc FROM ranked",
    "events_through_csv": _with(_CLICK) + """SELECT date_trunc('second', event_time) AS event_time, event_type, CAST(product_id AS INTEGER) AS product_id, category_id, category_code, brand,
 round(CAST(CAST(price AS FLOAT) AS DOUBLE), 4) AS price, CAST(user_id AS INTEGER) AS user_id, user_session FROM c""",
    "events_through_chunks": _with(_CLICK) + "SELECT * REPLACE (round(price, 4) AS price) FROM c",
    "view_sql": _with(_RETAIL, _days("r"), _products("r")) + "SELECT date, dau, total_purchases, (SELECT count(*) FROM products) AS products FROM days WHERE dau >= 2",
    "formatted_totals": _with(_RETAIL, _days("r")) + f"SELECT date, {_compact('daily_revenue')} AS revenue_compact, '$' || format('{{:,.2f}}', daily_revenue) AS revenue_usd, {_compact('total_events')} AS events_compact FROM days",
    "compare_mix": _with(_CLICK) + _mix("Original") + " UNION ALL " + _mix("Sample", "user_id % 10 = 0"),
    "temporal_coverage": _with(_CLICK) + "SELECT count(DISTINCT CAST(event_time AS DATE)) AS days, min(event_time) AS first_event, max(event_time) AS last_event FROM c",
    "segment_population": _with(*_FEATURES) + "SELECT user_id, round(checkout_rate, 4) AS checkout_rate FROM wide WHERE rfm_segment = 'Champions'",
    "variant_summary": _with(_CLICK, _users("c"), _TESTED) + "SELECT variant, count(*) AS visitors, CAST(sum(converted) AS BIGINT) AS conversions, round(avg(converted), 4) AS conversion_rate FROM tested GROUP BY 1",
    "ab_statistics": _with(_CLICK, _users("c"), _TESTED, *_AB)
    + f"SELECT control_n, treatment_n, {', '.join(f'round({c}, 4) AS {c}' for c in _AB_DOUBLES)} FROM stats",
    "ab_readout": _with(_CLICK, _users("c"), _TESTED, *_AB, *_DECIDED)
    + f"""SELECT control_n, treatment_n, {', '.join(f'round({c}, 4) AS {c}' for c in [*_AB_DOUBLES, 't_p_value', 'z_p_value', 'power'])}, coalesce(t_p_value < 0.05, FALSE) AS significant,
 CASE WHEN t_p_value < 0.05 AND lift > 0 THEN 'SHIP' ELSE 'HOLD' END AS decision FROM decided""",
    "propensity_frame": _with(_RETAIL, _FRAME) + "SELECT * FROM frame",
    "class_balance": _with(_RETAIL, _FRAME) + "SELECT target, count(*) AS users, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share FROM frame GROUP BY 1",
    "topk_precision_recall": _with(_RETAIL, _FRAME, "scored AS (SELECT target, events / (1.0 + recency_days) AS score FROM frame)", "cut AS (SELECT quantile_cont(score, 0.95) AS t FROM scored)",
        "top AS (SELECT count(*) FILTER (WHERE score >= t) AS n, CAST(sum(target) FILTER (WHERE score >= t) AS DOUBLE) AS hits, CAST(sum(target) AS DOUBLE) AS pos, avg(target) AS base, any_value(t) AS t FROM scored, cut)")
    + "SELECT round(t, 4) AS threshold, n AS selected, round(hits / n, 4) AS precision, round(hits / pos, 4) AS recall, round(hits / n / base, 4) AS lift FROM top",
}
SQL["feature_table_bucketed"] = SQL["feature_table"]
SQL["sample_export"] = SQL["stratified_sample"]
SQL["saved_model"] = f"SELECT user_id, target, TRUE AS same_score FROM ({SQL['split_by_class']}) WHERE side = 'test'"
SQL["ingest_check"] = _with(_RETAIL) + "SELECT count(*) AS table_rows, least(3, count(*)) AS preview_rows, CAST(9 AS BIGINT) AS columns FROM r"
SQL["saved_tables"] = f"""SELECT table_name, "rows", CAST(CASE table_name WHEN 'dim_products' THEN 5 WHEN 'dim_users' THEN 9 WHEN 'fact_daily_kpis' THEN 8 ELSE 12 END AS BIGINT) AS columns, TRUE AS has_bytes
 FROM ({SQL['row_counts']})"""
