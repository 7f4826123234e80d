"""The registered queries again, as SQL over the same tables (used to check results)."""

from __future__ import annotations


def fixed(x: str, k: int) -> str:
    return f"CAST(CAST(round_even(CAST({x} AS DOUBLE), {k}) AS DECIMAL(18,{k})) AS VARCHAR)"


def percent(x: str) -> str:
    return f"({fixed(f'({x}) * 100.0', 1)} || '%')"


def grouped(x: str) -> str:
    return f"format('{{:,}}', {x})"


def exact_mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / count({x}))"


def share(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))"


DELAY = (
    "CAST(greatest(((date_diff('day', o_orderdate, l_shipdate) % 200) + 200) % 200 - 175, 0) AS INTEGER)"
)
SHIPMENTS = f"""
shipments AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d'), l_partkey, l_suppkey,
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR),
      l_returnflag) AS order_id, s_name AS carrier, l_returnflag AS mode,
    p_type AS cargo_type, n1.n_name AS origin, n2.n_name AS dest, o_orderdate AS ship_ts,
    o_orderdate + to_days(p_size) AS plan_arrival_ts,
    o_orderdate + to_days(p_size + {DELAY}) AS actual_arrival_ts,
    CAST(p_size AS DOUBLE) AS planned_days, CAST({DELAY} AS DOUBLE) AS delay_days,
    l_quantity AS weight_t, l_extendedprice AS freight_usd
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
)"""

RAW = f"""
raw_once AS (
  SELECT CASE WHEN l_partkey % 131 = 0 THEN 'nan'
      WHEN l_partkey % 11 = 0 THEN concat('  ', l_orderkey, '-', l_linenumber, ' ')
      ELSE concat(l_orderkey, '-', l_linenumber) END AS order_id,
    CASE WHEN l_partkey % 89 = 0 THEN '' ELSE s_name END AS carrier,
    l_returnflag AS mode, n1.n_name AS origin, n2.n_name AS dest,
    CASE WHEN l_partkey % 101 = 0 THEN 'not-a-date'
      WHEN l_linenumber % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN l_linenumber % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
      WHEN l_linenumber = 2 THEN strftime(o_orderdate, '%-d %b %Y')
      WHEN l_linenumber = 5 THEN strftime(o_orderdate, '%m/%d/%Y %I:%M %p')
      ELSE strftime(o_orderdate, '%Y%m%d') END AS ship_ts,
    strftime(o_orderdate + to_days(p_size), '%Y-%m-%d') AS plan_arrival_ts,
    CASE WHEN l_suppkey % 10 = 0 THEN strftime(l_shipdate, '%Y-%m-%d')
      ELSE strftime(o_orderdate + to_days(p_size + {DELAY}), '%Y-%m-%d') END AS actual_arrival_ts,
    CASE WHEN l_partkey % 103 = 0 THEN 'inf' WHEN l_partkey % 107 = 0 THEN '-5'
      WHEN l_partkey % 109 = 0 THEN '1,234' ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS weight_t,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS freight_usd,
    CAST(CASE WHEN l_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS planned_days,
    CAST({DELAY} + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS delay_days,
    p_type AS cargo_type,
    concat_ws('|', strftime(l_shipdate, '%Y-%m-%d'), l_partkey, l_suppkey,
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR),
      l_returnflag) AS src_ord,
    l_partkey % 50 = 0 AS twice
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
),
raw AS (
  SELECT * EXCLUDE (twice), 0 AS cp FROM raw_once
  UNION ALL SELECT * EXCLUDE (twice), 1 AS cp FROM raw_once WHERE twice
)"""

CONTENT = (
    "order_id, carrier, mode, origin, dest, ship_ts, plan_arrival_ts, actual_arrival_ts, "
    "weight_t, freight_usd, planned_days, delay_days, cargo_type"
)


def norm(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN ('', 'nan', 'NaN', 'None', 'null') THEN trim({c}) END"


def number(c: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({c}, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') "
        f"THEN TRY_CAST({c} AS DOUBLE) END"
    )


def date(c: str) -> str:
    return f"try_strptime({c}, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%d %b %Y', '%m/%d/%Y %I:%M %p'])"


def days(a: str, b: str) -> str:
    return f"round_even(date_diff('microsecond', {a}, {b}) / 86400000000.0, 2)"


NORMAL = RAW + f""",
normal AS (
  SELECT {norm('order_id')} AS order_id, {norm('carrier')} AS carrier, {norm('mode')} AS mode,
    {norm('origin')} AS origin, {norm('dest')} AS dest, ship_ts, plan_arrival_ts, actual_arrival_ts,
    weight_t, freight_usd, planned_days, delay_days, cargo_type, src_ord, cp FROM raw
)"""

DEDUP = NORMAL + f""",
exact AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CONTENT} ORDER BY src_ord, cp) AS rn_exact FROM normal)
  WHERE rn_exact = 1
),
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY src_ord, cp) AS rn_key FROM exact
  ) WHERE order_id IS NULL OR rn_key = 1
)"""

CHECKED = DEDUP + f""",
typed AS (
  SELECT order_id, carrier, mode, origin, dest, {date('ship_ts')} AS ship_ts,
    {date('plan_arrival_ts')} AS plan_arrival_ts, {date('actual_arrival_ts')} AS actual_arrival_ts,
    {number('weight_t')} AS weight_t, {number('freight_usd')} AS freight_usd,
    {number('planned_days')} AS given_planned, {number('delay_days')} AS given_delay, coalesce({norm('cargo_type')}, 'unspecified') AS cargo_type, src_ord, cp
  FROM kept
),
dayed AS (
  SELECT *, {days('ship_ts', 'plan_arrival_ts')} AS planned_days,
    {days('plan_arrival_ts', 'actual_arrival_ts')} AS delay_days FROM typed
),
checked AS (
  SELECT *,
    (order_id IS NULL OR carrier IS NULL OR mode IS NULL OR origin IS NULL OR dest IS NULL) AS missing_text,
    (ship_ts IS NULL OR plan_arrival_ts IS NULL OR actual_arrival_ts IS NULL) AS invalid_date,
    (weight_t IS NULL OR freight_usd IS NULL) AS invalid_numeric,
    (coalesce(weight_t <= 0, false) OR coalesce(freight_usd <= 0, false)) AS nonpositive,
    (coalesce(plan_arrival_ts < ship_ts, false) OR coalesce(actual_arrival_ts < ship_ts, false)) AS bad_sequence,
    coalesce(planned_days <= 0, false) AS zero_plan,
    coalesce(abs(given_planned - planned_days) > 0.01, false) AS corrected_plan,
    coalesce(abs(given_delay - delay_days) > 0.01, false) AS corrected_delay
  FROM dayed
),
valid AS (
  SELECT * FROM checked WHERE NOT (missing_text OR invalid_date OR invalid_numeric OR nonpositive OR bad_sequence OR zero_plan)
)"""

QUALITY = CHECKED + """,
quality AS (
  SELECT r.n AS raw_rows, v.n AS valid_rows, r.n - v.n AS dropped_rows, r.n - e.n AS exact_duplicates_removed,
    e.n - k.n AS duplicate_order_ids_removed, k.mt AS missing_required_value_rows, k.idt AS invalid_date_rows,
    k.inum AS invalid_numeric_rows, k.np AS nonpositive_numeric_rows, k.bs AS invalid_date_sequence_rows,
    k.cpl AS corrected_plan_days_rows, k.cdl AS corrected_delay_days_rows
  FROM (SELECT count(*) AS n FROM raw) r, (SELECT count(*) AS n FROM exact) e, (SELECT count(*) AS n FROM valid) v,
    (SELECT count(*) AS n, count(*) FILTER (missing_text) AS mt, count(*) FILTER (invalid_date) AS idt,
      count(*) FILTER (invalid_numeric) AS inum, count(*) FILTER (nonpositive) AS np,
      count(*) FILTER (bad_sequence) AS bs, count(*) FILTER (corrected_plan) AS cpl,
      count(*) FILTER (corrected_delay) AS cdl FROM checked) k
),
metrics AS (
  SELECT 'delay_days' AS metric, delay_days AS value FROM valid
  UNION ALL SELECT 'planned_days', planned_days FROM valid
  UNION ALL SELECT 'weight_t', weight_t FROM valid
  UNION ALL SELECT 'freight_usd', freight_usd FROM valid
),
bounds AS (
  SELECT metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS n FROM metrics GROUP BY metric
),
extremes AS (
  SELECT m.metric, count(*) FILTER (n >= 8 AND b <> a AND (value < a - 3 * (b - a) OR value > b + 3 * (b - a))) AS extreme_rows
  FROM metrics m JOIN bounds USING (metric) GROUP BY m.metric
)"""

BASE = SHIPMENTS + """,
base AS (
  SELECT *, delay_days / greatest(planned_days, 1.0) AS deviation_ratio,
    CAST(month(ship_ts) AS INTEGER) AS ship_month, CAST(year(ship_ts) AS INTEGER) AS ship_year,
    concat(origin, '→', dest) AS route, freight_usd / greatest(weight_t, 0.01) AS unit_freight
  FROM shipments
)"""

RULES = BASE + """,
floors AS (SELECT mode, count(*) AS mode_rows, quantile_cont(unit_freight, 0.01) AS floor FROM base GROUP BY mode),
ruled AS (
  SELECT b.*, deviation_ratio > 0.5 AS r1, delay_days > 7 AS r2, delay_days > 14 AS critical_rule,
    coalesce(mode_rows >= 20 AND unit_freight < floor, false) AS r4
  FROM base b LEFT JOIN floors f ON b.mode = f.mode
),
rules AS (
  SELECT *, CAST(r1 OR r2 OR r4 AS INTEGER) AS rule_anomaly,
    concat_ws('; ', CASE WHEN r1 THEN 'delay_over_half_plan' END, CASE WHEN r2 THEN 'delay_over_7d' END,
      CASE WHEN critical_rule THEN 'delay_over_14d' END, CASE WHEN r4 THEN 'low_unit_freight' END) AS rule_reason
  FROM ruled
)"""

ZSUMS = """
sums AS (
  SELECT route, count(*) AS n, CAST(sum(CAST(delay_days AS DECIMAL(14,4))) AS DOUBLE) AS sx,
    CAST(sum(CAST(delay_days AS DECIMAL(14,4)) * CAST(delay_days AS DECIMAL(14,4))) AS DOUBLE) AS sxx
  FROM base GROUP BY route
)"""


def zscored(source: str) -> str:
    return f"""
zparts AS (
  SELECT r.*, n, CAST(n - 1 AS DOUBLE) AS m, (sx - delay_days) / CAST(n - 1 AS DOUBLE) AS loo_mean, sxx
  FROM {source} r JOIN sums s ON r.route = s.route
),
zraw AS (
  SELECT *, CASE WHEN n < 5 THEN 0.0 ELSE (delay_days - loo_mean) / greatest(sqrt(
    greatest((sxx - delay_days * delay_days) - m * loo_mean * loo_mean, 0.0) / greatest(m - 1, 1.0)), 0.5) END AS z
  FROM zparts
),
zscored AS (
  SELECT *, CAST(abs(z) > 2.5 AS INTEGER) AS zscore_anomaly, round_even(z, 3) AS z_score, n < 5 AS zscore_skipped FROM zraw
)"""


FOREST_FEATURES = ["delay_days", "deviation_ratio", "weight_t", "freight_usd", "planned_days"]
FOREST_LEVELS = 8  # a bag has 256 rows


def _hashed(*of: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(of)})), 1, 13))::BIGINT"


def forest(trees: int, digits: int, seed: int = 42, contamination: str = "0.05") -> str:
    """CTEs up to ``forest`` (rid, iforest_anomaly, iforest_score) over ``base``, whose rows have a ``rid``.

    Bags, then all trees level by level: each level groups its rows by node, cuts, and joins the cuts back. At last every row
    walks all trees, a join a level.
    """
    k = range(1, len(FOREST_FEATURES) + 1)
    xs = ", ".join(f"coalesce({f}, 0.0)::DOUBLE AS x{i}" for i, f in zip(k, FOREST_FEATURES))
    x = ", ".join(f"x{i}" for i in k)
    of = lambda f: "CASE " + f + " " + " ".join(f"WHEN {i} THEN x{i}" for i in k) + " END"
    mean = "-2 * (n - 1) / n::DOUBLE"
    length = f"CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1) + 0.5772156649015329) {mean} END"
    parts = [f"""
frows AS MATERIALIZED (SELECT rid, coalesce(order_id, '') AS id, {xs} FROM base),
fsize AS MATERIALIZED (
  SELECT count(*) AS rows, least(256, count(*)) AS bag, greatest(1, ceil(log2(least(256, count(*))))) AS height,
    -{trees} * ln(1 - least(2.0 * least(256, count(*)) / count(*), 1 - 1e-9)) AS mean FROM frows
),
fsteps AS MATERIALIZED (
  SELECT list(step ORDER BY i) AS steps FROM (
    SELECT i, sum(term) OVER (ORDER BY i) AS step FROM (
      SELECT i, exp(-mean + i * ln(mean) - lgamma(i + 1)) AS term FROM fsize, range(0, 400) AS t(i)))
),
fpicked AS (
  SELECT rid, id, {x}, unnest(list_distinct(list_transform(
    range(1, len(list_filter(steps, lambda s: s < {_hashed(str(seed), 'id', '0')} / 4503599627370496.0)) + 1),
    lambda j: {_hashed(str(seed), 'id', 'j')} % {trees}))) AS tree
  FROM frows, fsteps
),
flevel0 AS MATERIALIZED (
  SELECT tree, 0 AS node, {x} FROM (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY {_hashed("'bag'", str(seed), 'id', 'tree')}, id) AS rank FROM fpicked
  ) WHERE rank <= (SELECT bag FROM fsize)
)"""]
    for level in range(FOREST_LEVELS + 1):
        ends = ", ".join(f"min(x{i}) AS a{i}, max(x{i}) AS b{i}" for i in k)
        varied = "list_filter([" + ", ".join(f"CASE WHEN b{i} > a{i} THEN {i} END" for i in k) + "], lambda f: f IS NOT NULL)"
        low = "CASE f " + " ".join(f"WHEN {i} THEN a{i}" for i in k) + " END"
        high = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in k) + " END"
        digest = f"md5(concat_ws(':', {seed}, tree, node))"
        parts.append(f"""
fnodes{level} AS MATERIALIZED (
  SELECT tree, node, n, f, CASE WHEN cut < high THEN cut ELSE low END AS cut,
    CASE WHEN f IS NULL THEN round(({level} + {length}) * 1e9)::BIGINT END AS path
  FROM (
    SELECT *, low + (high - low) * (('0x' || substr({digest}, 14, 13))::BIGINT / 4503599627370496.0) AS cut FROM (
      SELECT *, {low} AS low, {high} AS high FROM (
        SELECT *, CASE WHEN {level} < (SELECT height FROM fsize) AND n > 1 AND len(varied) > 0 THEN
          varied[(floor(('0x' || substr({digest}, 1, 13))::BIGINT / 4503599627370496.0 * len(varied)) + 1)::BIGINT] END AS f
        FROM (SELECT *, {varied} AS varied FROM (SELECT tree, node, count(*) AS n, {ends} FROM flevel{level} GROUP BY tree, node))
      )))
)""")
        if level < FOREST_LEVELS:
            parts.append(f"""
flevel{level + 1} AS MATERIALIZED (
  SELECT l.tree, 2 * l.node + CASE WHEN {of('f')} > cut THEN 2 ELSE 1 END AS node, {x}
  FROM flevel{level} l JOIN fnodes{level} d ON l.tree = d.tree AND l.node = d.node WHERE f IS NOT NULL
)""")
    walk = f"SELECT rid, {x}, t.tree, 0 AS node, NULL::BIGINT AS path FROM frows, (SELECT unnest(range(0, {trees})) AS tree) t"
    for level in range(FOREST_LEVELS + 1):
        walk = f"""SELECT rid, {x}, w.tree, CASE WHEN f IS NOT NULL THEN 2 * w.node + CASE WHEN {of('f')} > cut THEN 2 ELSE 1 END END AS node,
    coalesce(w.path, d.path) AS path FROM ({walk}) w LEFT JOIN fnodes{level} d ON w.tree = d.tree AND w.node = d.node"""
    bag = "(SELECT 2.0 * (ln(bag - 1) + 0.5772156649015329) - 2 * (bag - 1) / bag::DOUBLE FROM fsize)"
    parts.append(f"""
fraw AS MATERIALIZED (
  SELECT rid, pow(2.0, -(sum(path)::BIGINT / {float(trees)} / 1e9) / {bag}) AS raw FROM ({walk}) GROUP BY rid
),
forest AS (
  SELECT rid, CAST(raw > cut AS INTEGER) AS iforest_anomaly, round_even(raw - cut, {digits}) AS iforest_score
  FROM fraw, (SELECT quantile_cont(raw, 1 - {contamination}) AS cut FROM fraw)
)""")
    return ",".join(parts)


def numbered(sql: str) -> str:
    """The same CTEs with a row number, ``rid``, in ``base``."""
    return sql.replace("base AS (\n  SELECT *,", "base AS MATERIALIZED (\n  SELECT row_number() OVER () AS rid, *,")


def detected(trees: int | None = None) -> str:
    """CTEs up to ``detected``: two layers, or three with a forest of so many trees."""
    if trees is None:
        head, source = RULES + "," + ZSUMS + "," + zscored("rules"), "zscored"
        layer = "0 AS iforest_anomaly, CAST(0.0 AS DOUBLE) AS iforest_score, true AS iforest_skipped"
        text = "'isolation forest: switched off'"
    else:
        head, source = numbered(RULES) + "," + forest(trees, 5) + "," + ZSUMS + "," + zscored("rules"), "zscored JOIN forest USING (rid)"
        layer = "false AS iforest_skipped"
        text = f"""CASE WHEN iforest_anomaly = 1 THEN concat('isolation forest: unusual feature combination (model score ',
      {fixed('iforest_score', 4)}, ')') END"""
    return head + f""",
voted AS (
  SELECT *, {layer} FROM {source}
),
counted AS (SELECT *, rule_anomaly + zscore_anomaly + iforest_anomaly AS anomaly_votes FROM voted),
final AS (
  SELECT *, CAST(rule_anomaly = 1 OR anomaly_votes >= 2 AS INTEGER) AS final_anomaly,
    round_even(least(greatest(anomaly_votes / 3.0 * 75 + least(greatest(delay_days, 0.0), 14.0) / 14 * 25, 0.0), 100.0), 1) AS anomaly_score,
    CASE WHEN rule_anomaly + zscore_anomaly + iforest_anomaly = 0 THEN 'none' ELSE
      concat_ws(', ', CASE WHEN rule_anomaly = 1 THEN 'rules' END, CASE WHEN zscore_anomaly = 1 THEN 'route_zscore' END,
        CASE WHEN iforest_anomaly = 1 THEN 'iforest' END) END AS anomaly_methods
  FROM counted
),
graded AS (
  SELECT *, CASE WHEN final_anomaly <> 1 THEN 'normal' WHEN critical_rule OR anomaly_votes = 3 THEN 'critical'
    WHEN delay_days > 7 OR anomaly_votes = 2 THEN 'moderate' ELSE 'minor' END AS severity FROM final
),
detected AS (
  SELECT *, concat_ws('; ',
    CASE WHEN rule_anomaly = 1 THEN concat('rules: ', rule_reason) END,
    CASE WHEN zscore_anomaly = 1 THEN concat('route z-score: z=', {fixed('z_score', 2)}, ' against the route baseline exceeds the threshold 2.50')
      WHEN zscore_skipped THEN 'route z-score: too few orders on the route, not judged' END,
    {text},
    concat('overall: ', anomaly_votes, CASE WHEN final_anomaly = 1 THEN ' of 3 methods hit, judged anomalous, severity '
      ELSE ' of 3 methods hit, not judged anomalous, severity ' END, severity)) AS reason
  FROM graded
)"""


DETECTED = detected()

ROLLUPS = DETECTED + f""",
overall AS (SELECT {share('sum(final_anomaly)', 'count(*)')} AS global_rate FROM detected),
kpis AS (
  SELECT count(*) AS total_orders, CAST(sum(final_anomaly) AS BIGINT) AS total_anomalies,
    round_even({share('sum(final_anomaly)', 'count(*)')}, 6) AS anomaly_rate,
    round_even({exact_mean('delay_days')}, 2) AS avg_delay, round_even({exact_mean('planned_days')}, 2) AS avg_planned_transit,
    round_even(max(delay_days), 2) AS max_delay, strftime(min(ship_ts), '%Y-%m-%d') AS start_date,
    strftime(max(ship_ts), '%Y-%m-%d') AS end_date
  FROM detected
),
levels AS (
  SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'moderate') AS moderate,
    count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'normal') AS normal FROM detected
),
severity_counts AS (
  SELECT 1 AS rank, 'critical' AS severity, critical AS orders FROM levels
  UNION ALL SELECT 2, 'moderate', moderate FROM levels UNION ALL SELECT 3, 'minor', minor FROM levels
  UNION ALL SELECT 4, 'normal', normal FROM levels
),
carriers AS (
  SELECT carrier, total_orders, avg_delay, late_rate, anomaly_orders, critical_orders,
    round_even({share('anomaly_orders', 'total_orders')}, 4) AS anomaly_rate,
    round_even((anomaly_orders + global_rate * 10.0) / (total_orders + 10.0), 4) AS smoothed_rate,
    CASE WHEN total_orders < 5 THEN 'small_sample' ELSE 'enough_sample' END AS sample_note
  FROM (
    SELECT carrier, count(order_id) AS total_orders, round_even({exact_mean('delay_days')}, 4) AS avg_delay,
      round_even({share('count(*) FILTER (delay_days > 0)', 'count(*)')}, 4) AS late_rate,
      CAST(sum(final_anomaly) AS BIGINT) AS anomaly_orders, count(*) FILTER (severity = 'critical') AS critical_orders
    FROM detected GROUP BY carrier
  ), overall
),
carriers_ranked AS (
  SELECT *, row_number() OVER (ORDER BY smoothed_rate DESC, total_orders DESC, carrier) AS position FROM carriers
),
routes AS (
  SELECT route, orders, avg_delay, max_delay, anomalies, critical_orders,
    round_even({share('anomalies', 'orders')}, 4) AS anomaly_rate,
    round_even((anomalies + global_rate * 10.0) / (orders + 10.0), 4) AS smoothed_rate,
    CASE WHEN orders < 5 THEN 'small_sample' ELSE 'enough_sample' END AS sample_note
  FROM (
    SELECT route, count(order_id) AS orders, round_even({exact_mean('delay_days')}, 4) AS avg_delay,
      round_even(max(delay_days), 4) AS max_delay, CAST(sum(final_anomaly) AS BIGINT) AS anomalies,
      count(*) FILTER (severity = 'critical') AS critical_orders
    FROM detected GROUP BY route
  ), overall
),
routes_ranked AS (
  SELECT *, row_number() OVER (ORDER BY smoothed_rate DESC, orders DESC, avg_delay DESC, route) AS position FROM routes
),
reasons AS (
  SELECT rule, count(*) AS orders FROM (
    SELECT unnest(string_split(rule_reason, '; ')) AS rule FROM detected WHERE final_anomaly = 1 AND rule_reason <> ''
  ) WHERE rule <> '' GROUP BY rule
),
top10 AS (
  SELECT order_id, carrier, route, mode, delay_days, anomaly_methods, anomaly_score, severity, reason,
    row_number() OVER (ORDER BY anomaly_score DESC, delay_days DESC, order_id) AS position
  FROM detected WHERE final_anomaly = 1 QUALIFY position <= 10
)"""

CARRIER_FACT = (
    "concat('- ', carrier, ': orders ', total_orders, ', anomalies ', anomaly_orders, ', anomaly rate ', "
    f"{percent('anomaly_rate')}, ', average delay ', {fixed('avg_delay', 1)}, ' days, sample ', sample_note)"
)
ROUTE_FACT = (
    "concat('- ', route, ': orders ', orders, ', anomalies ', anomalies, ', anomaly rate ', "
    f"{percent('anomaly_rate')}, ', longest delay ', {fixed('max_delay', 1)}, ' days, sample ', sample_note)"
)

PORTS = """
throughput AS (
  SELECT n_name AS port, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS cargo_10kt
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3
),
top_ports AS (
  SELECT port, CAST(sum(CAST(cargo_10kt AS DECIMAL(28,4))) AS DOUBLE) AS total_cargo FROM throughput
  GROUP BY port ORDER BY total_cargo DESC, port LIMIT 5
)"""

THROUGHPUT_RAW = PORTS + """,
traw AS (
  SELECT CASE WHEN month = 4 AND year % 3 = 0 THEN 'nan' ELSE concat(' ', port, ' ') END AS port,
    CASE WHEN month = 5 AND year % 3 = 0 THEN 'unknown' ELSE CAST(year AS VARCHAR) END AS year,
    CASE WHEN month = 1 AND year % 2 = 0 THEN '13' ELSE CAST(month AS VARCHAR) END AS month,
    CASE WHEN month = 2 AND year % 2 = 0 THEN '-5' WHEN month = 6 AND year % 2 = 0 THEN 'inf'
      ELSE CAST(CAST(cargo_10kt AS DECIMAL(18,2)) AS VARCHAR) END AS cargo_10kt,
    unnest(CASE WHEN month = 3 THEN [0, 1] ELSE [0] END) AS cp
  FROM throughput
),
tclean AS (
  SELECT DISTINCT port, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, cargo_10kt FROM (
    SELECT CASE WHEN trim(port) NOT IN ('', 'nan', 'NaN', 'None', 'null') THEN trim(port) END AS port,
      TRY_CAST(year AS DOUBLE) AS year, TRY_CAST(month AS DOUBLE) AS month,
      CASE WHEN isfinite(TRY_CAST(cargo_10kt AS DOUBLE)) THEN TRY_CAST(cargo_10kt AS DOUBLE) END AS cargo_10kt
    FROM traw
  ) WHERE port IS NOT NULL AND year IS NOT NULL AND month BETWEEN 1 AND 12 AND year BETWEEN 1900 AND 2100 AND cargo_10kt >= 0
)"""

V1 = BASE + """,
floor1 AS (SELECT quantile_cont(freight_usd, 0.02) AS floor FROM base WHERE mode = 'R'),
rules1 AS (
  SELECT base.*, deviation_ratio > 0.5 AS r1, delay_days > 7 AS r2,
    coalesce(mode = 'R' AND freight_usd < floor, false) AS r3 FROM base, floor1
),
v1rules AS (
  SELECT *, CAST(r1 OR r2 OR r3 AS INTEGER) AS rule_anomaly,
    concat(CASE WHEN r1 THEN 'delay_over_half;' ELSE '' END, CASE WHEN r2 THEN 'delay_over_7d;' ELSE '' END,
      CASE WHEN r3 THEN 'low_freight;' ELSE '' END) AS rule_reason FROM rules1
),""" + ZSUMS + """,
v1z AS (
  SELECT r.*, CASE WHEN n >= 5 THEN (delay_days - sx / n) / greatest(sqrt(
    greatest(sxx - n * (sx / n) * (sx / n), 0.0) / greatest(n - 1, 1)), 0.1) ELSE 0.0 END AS z
  FROM v1rules r JOIN sums s ON r.route = s.route
),
v1votes AS (
  SELECT *, round_even(z, 2) AS z_score, CAST(abs(z) > 2.5 AS INTEGER) AS zscore_anomaly,
    rule_anomaly + CAST(abs(z) > 2.5 AS INTEGER) AS anomaly_votes FROM v1z
),
v1 AS (
  SELECT *, CAST(anomaly_votes >= 2 AS INTEGER) AS final_anomaly,
    CASE WHEN delay_days > 14 THEN 'critical' WHEN delay_days > 7 THEN 'moderate'
      WHEN anomaly_votes >= 2 THEN 'minor' ELSE 'normal' END AS severity FROM v1votes
)"""

V1ROLL = V1 + f""",
carriers1 AS (
  SELECT carrier, count(order_id) AS total_orders, round_even({exact_mean('delay_days')}, 2) AS avg_delay,
    round_even({share('count(*) FILTER (delay_days > 0)', 'count(*)')}, 2) AS late_rate,
    CAST(sum(final_anomaly) AS BIGINT) AS anomaly_orders,
    round_even({share('sum(final_anomaly)', 'count(order_id)')}, 3) AS anomaly_rate
  FROM v1 GROUP BY carrier
),
routes1 AS (
  SELECT route, count(order_id) AS orders, round_even({exact_mean('delay_days')}, 2) AS avg_delay,
    round_even(max(delay_days), 2) AS max_delay, CAST(sum(final_anomaly) AS BIGINT) AS anomalies,
    round_even({share('sum(final_anomaly)', 'count(order_id)')}, 3) AS anomaly_rate
  FROM v1 GROUP BY route
)"""

EXPORT = (
    "order_id, carrier, route, mode, ship_ts, plan_arrival_ts, actual_arrival_ts, planned_days, delay_days, "
    "rule_anomaly, zscore_anomaly, iforest_anomaly, anomaly_methods, anomaly_score, severity, final_anomaly, reason"
)
SCALES = BASE + """,
feats AS (
  SELECT 'delay_days' AS metric, delay_days AS value FROM base
  UNION ALL SELECT 'deviation_ratio', deviation_ratio FROM base UNION ALL SELECT 'weight_t', weight_t FROM base
  UNION ALL SELECT 'freight_usd', freight_usd FROM base UNION ALL SELECT 'planned_days', planned_days FROM base
),
scales AS (
  SELECT metric, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
  FROM feats GROUP BY metric
)"""


def _scaled(f: str) -> str:
    one = lambda c: f"(SELECT {c} FROM scales WHERE metric = '{f}')"
    unit = f"CASE WHEN {one('iqr')} = 0 THEN 1.0 ELSE {one('iqr')} END"
    return f"round_even((coalesce({f}, {one('median')}) - {one('median')}) / ({unit}), 6) AS {f}_scaled"


def escape(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^\\s*[=+@-]') THEN concat('''', {c}) ELSE {c} END"


def _histogram() -> str:
    edge = lambda i: f"CASE WHEN {i} = bins THEN hi ELSE lo + ({i}) * ((hi - lo) / bins) END"
    return f"""{DETECTED},
classes AS (
  SELECT final_anomaly, count(*) AS n, CASE WHEN final_anomaly = 1 THEN 20 ELSE 30 END AS bins,
    CASE WHEN min(delay_days) = max(delay_days) THEN min(delay_days) - 0.5 ELSE min(delay_days) END AS lo,
    CASE WHEN min(delay_days) = max(delay_days) THEN max(delay_days) + 0.5 ELSE max(delay_days) END AS hi
  FROM detected GROUP BY final_anomaly
),
grid AS (SELECT *, unnest(generate_series(0, bins - 1)) AS bin FROM classes),
edges AS (SELECT final_anomaly, n, bins, CAST(bin AS INTEGER) AS bin, {edge('bin')} AS bin_start, {edge('bin + 1')} AS bin_end FROM grid)
SELECT e.final_anomaly, e.bin, bin_start, bin_end, count(d.order_id) AS orders,
  count(d.order_id) / (e.n * (bin_end - bin_start)) AS density
FROM edges e LEFT JOIN detected d ON d.final_anomaly = e.final_anomaly AND d.delay_days >= bin_start
  AND (d.delay_days < bin_end OR (e.bin = bins - 1 AND d.delay_days <= bin_end))
GROUP BY e.final_anomaly, e.bin, bin_start, bin_end, e.n"""


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, select: f"WITH {ctes} {select}"
    issue_list = ", ".join(
        f"CASE WHEN {i} THEN '{i}' END"
        for i in ["missing_text", "invalid_date", "invalid_numeric", "nonpositive", "bad_sequence", "zero_plan"]
    )
    valid_cols = (
        "order_id, carrier, mode, origin, dest, ship_ts, plan_arrival_ts, actual_arrival_ts, weight_t, "
        "freight_usd, planned_days, delay_days, cargo_type"
    )
    carrier_cols = (
        "carrier, total_orders, avg_delay, late_rate, anomaly_orders, critical_orders, anomaly_rate, smoothed_rate, sample_note"
    )
    route_cols = "route, orders, avg_delay, max_delay, anomalies, critical_orders, anomaly_rate, smoothed_rate, sample_note"
    reason_top = (
        "(SELECT string_agg(concat(rule, ' (', orders, ')'), ', ' ORDER BY orders DESC, rule) FROM "
        "(SELECT * FROM reasons ORDER BY orders DESC, rule LIMIT 3))"
    )
    out: dict[str, str] = {}
    # adapters, cells and rows
    out["shipments"] = w(SHIPMENTS, "SELECT * FROM shipments")
    out["text_normalise"] = w(NORMAL, "SELECT src_ord, cp, order_id, carrier, mode, origin, dest FROM normal")
    out["date_parse"] = w(RAW, f"SELECT src_ord, cp, ship_ts AS ship_text, {date('ship_ts')} AS ship_ts, {date('plan_arrival_ts')} AS plan_arrival_ts, {date('actual_arrival_ts')} AS actual_arrival_ts FROM raw")
    out["numeric_coerce"] = w(RAW, f"SELECT src_ord, cp, weight_t AS weight_text, {number('weight_t')} AS weight_t, {number('freight_usd')} AS freight_usd FROM raw")
    out["derive_days"] = w(RAW, f"SELECT src_ord, cp, {days(date('ship_ts'), date('plan_arrival_ts'))} AS planned_days, {days(date('plan_arrival_ts'), date('actual_arrival_ts'))} AS delay_days FROM raw")
    out["formula_escape"] = w(RAW, f"SELECT src_ord, cp, {escape('order_id')} AS order_id, {escape('weight_t')} AS weight_t, {escape('carrier')} AS carrier FROM raw")
    packed = ", ".join(f"{c.strip()} := {c.strip()}" for c in CONTENT.split(","))
    out["row_fingerprint"] = w(RAW, f"SELECT order_id, substring(sha256(CAST(to_json(struct_pack({packed})) AS VARCHAR)), 1, 16) AS fingerprint FROM raw")
    line_end = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    blanks = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(12288)"
    out["markdown_lines"] = f"""
WITH pieces AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{line_end}'), lambda s: trim(s, {blanks})), lambda s: s <> '') AS lines
  FROM documents
),
flat AS (SELECT doc_id, unnest(lines) AS raw_line, unnest(generate_series(1, len(lines))) AS line_no FROM pieces WHERE len(lines) > 0)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
  replace(regexp_replace(regexp_replace(regexp_replace(raw_line, '^#{{1,6}}\\s*', ''), '^[-*>]\\s*', ''), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '`', '') AS line
FROM flat"""
    # validation
    out["dedup_exact"] = w(DEDUP, f"SELECT {CONTENT}, src_ord, cp FROM exact")
    out["dedup_key"] = w(DEDUP, f"SELECT {CONTENT}, src_ord, cp FROM kept")
    out["row_issues"] = w(CHECKED, "SELECT src_ord, cp, order_id, missing_text, invalid_date, invalid_numeric, nonpositive, bad_sequence, zero_plan, corrected_plan, corrected_delay FROM checked")
    out["validate_orders"] = w(CHECKED, f"SELECT {valid_cols} FROM valid")
    out["quarantine"] = w(CHECKED, f"SELECT src_ord, cp, order_id, concat_ws(',', {issue_list}) AS issues FROM checked WHERE missing_text OR invalid_date OR invalid_numeric OR nonpositive OR bad_sequence OR zero_plan")
    out["quality_summary"] = w(QUALITY, "SELECT * FROM quality")
    out["extreme_counts"] = w(QUALITY, "SELECT * FROM extremes")
    out["quality_cards"] = w(QUALITY, "SELECT raw_rows, valid_rows, missing_required_value_rows AS missing_rows, exact_duplicates_removed + duplicate_order_ids_removed AS duplicate_rows, CAST(dropped_rows + (SELECT sum(extreme_rows) FROM extremes) AS BIGINT) AS issue_count FROM quality")
    out["quality_warnings"] = w(QUALITY + "," + THROUGHPUT_RAW, """
SELECT * FROM (
  SELECT 1 AS position, 'orders' AS source, 'extreme_values_kept' AS warning, CAST((SELECT sum(extreme_rows) FROM extremes) AS BIGINT) AS affected
  UNION ALL SELECT 2, 'orders', 'day_fields_recomputed', corrected_plan_days_rows + corrected_delay_days_rows FROM quality
  UNION ALL SELECT 3, 'orders', 'invalid_dates_dropped', invalid_date_rows FROM quality
  UNION ALL SELECT 4, 'orders', 'bad_sequences_dropped', invalid_date_sequence_rows FROM quality
  UNION ALL SELECT 1, 'throughput', 'invalid_or_duplicate_dropped', (SELECT count(*) FROM traw) - (SELECT count(*) FROM tclean)
) WHERE affected > 0""")
    out["union_sources"] = w(DEDUP, f"SELECT {CONTENT}, src_ord, cp FROM exact UNION ALL SELECT {CONTENT}, src_ord, cp FROM kept")
    # throughput
    out["throughput_clean"] = w(THROUGHPUT_RAW, "SELECT port, year, month, cargo_10kt FROM tclean")
    out["throughput_quality"] = w(THROUGHPUT_RAW, "SELECT (SELECT count(*) FROM traw) AS raw_rows, (SELECT count(*) FROM tclean) AS valid_rows, (SELECT count(*) FROM traw) - (SELECT count(*) FROM tclean) AS dropped_rows")
    out["top_ports"] = w(PORTS, "SELECT * FROM top_ports")
    out["port_annual"] = w(PORTS, "SELECT port, year, CAST(sum(CAST(cargo_10kt AS DECIMAL(28,4))) AS DOUBLE) AS cargo_10kt, CAST(sum(CAST(cargo_10kt AS DECIMAL(28,4))) AS DOUBLE) / 10000 AS cargo_100mt FROM throughput WHERE port IN (SELECT port FROM top_ports) GROUP BY port, year")
    out["port_annual_fixed"] = w(PORTS, "SELECT port, year, CAST(sum(CAST(cargo_10kt AS DECIMAL(28,4))) AS DOUBLE) AS cargo_10kt, CAST(sum(CAST(cargo_10kt AS DECIMAL(28,4))) AS DOUBLE) / 10000 AS cargo_100mt FROM throughput WHERE port IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5') GROUP BY port, year")
    out["port_seasonality"] = w(PORTS, """, means AS (
  SELECT port, month, CAST(sum(CAST(cargo_10kt AS DECIMAL(28,4))) AS DOUBLE) / count(cargo_10kt) AS mean_cargo
  FROM throughput WHERE port IN (SELECT port FROM top_ports) GROUP BY port, month
),
grid AS (SELECT port, CAST(unnest(generate_series(1, 12)) AS INTEGER) AS month FROM top_ports),
filled AS (
  SELECT g.port, g.month, coalesce(mean_cargo, avg(mean_cargo) OVER (PARTITION BY g.port), 0.0) AS mean_cargo
  FROM grid g LEFT JOIN means m ON g.port = m.port AND g.month = m.month
)
SELECT port, month, round_even(mean_cargo, 6) AS mean_cargo,
  round_even(mean_cargo / CASE WHEN avg(mean_cargo) OVER (PARTITION BY port) = 0 THEN 1.0 ELSE avg(mean_cargo) OVER (PARTITION BY port) END, 6) AS relative
FROM filled""")
    # layers and verdict
    out["preprocess"] = w(BASE, "SELECT order_id, deviation_ratio, ship_month, ship_year, route, unit_freight FROM base")
    out["feature_scales"] = w(SCALES, "SELECT * FROM scales")
    out["feature_scaling"] = w(SCALES, "SELECT order_id, " + ", ".join(_scaled(f) for f in ["delay_days", "deviation_ratio", "weight_t", "freight_usd", "planned_days"]) + " FROM base")
    out["rule_layer"] = w(RULES, "SELECT order_id, rule_anomaly, critical_rule, rule_reason FROM rules")
    out["zscore_layer"] = w(BASE + "," + ZSUMS + "," + zscored("base"), "SELECT order_id, zscore_anomaly, z_score, zscore_skipped FROM zscored")
    out["layer_join"] = w(DETECTED, "SELECT order_id, rule_anomaly, critical_rule, rule_reason, zscore_anomaly, z_score, zscore_skipped FROM detected")
    out["ensemble"] = w(DETECTED, "SELECT order_id, anomaly_votes, final_anomaly, anomaly_score, anomaly_methods FROM detected")
    out["severity"] = w(DETECTED, "SELECT order_id, severity FROM detected")
    out["explain"] = w(DETECTED, "SELECT order_id, reason FROM detected")
    out["two_layer_detection"] = w(DETECTED, f"SELECT {EXPORT}, deviation_ratio, ship_month, ship_year, unit_freight, critical_rule, rule_reason, z_score, zscore_skipped, iforest_score, iforest_skipped, anomaly_votes FROM detected")
    verdicts = "SELECT order_id, z_score, zscore_skipped, rule_reason, anomaly_votes, anomaly_score, severity, reason FROM detected"
    out["small_groups"] = w(DETECTED.replace("n < 5", "n < 20"), verdicts)
    late = f"CAST({DELAY} AS DOUBLE) AS delay_days"
    out["early_arrivals"] = w(DETECTED.replace(late, late.replace("AS DOUBLE)", "AS DOUBLE) - 3.0")), verdicts)
    fine = ROLLUPS.replace("FROM detected GROUP BY carrier", "FROM (SELECT * REPLACE (concat_ws('/', carrier, route) AS carrier) FROM detected) GROUP BY carrier")
    out["fine_carriers"] = w(fine, f"SELECT {carrier_cols} FROM carriers")
    day, note = "CAST(planned_days AS INTEGER)", """CASE CAST(planned_days AS INTEGER) % 5 WHEN 0 THEN 'plain' WHEN 1 THEN '=1+1'
      WHEN 2 THEN 'say "hi", ok' WHEN 3 THEN concat('two', chr(10), 'lines') END"""
    freight = "CAST(CAST(freight_usd AS DECIMAL(18,2)) AS VARCHAR)"
    out["csv_round_trip"] = w(SHIPMENTS, f"""
SELECT 'row' AS kind, order_id, carrier, mode, origin, dest, {freight} AS freight_usd,
  CASE {day} % 3 WHEN 0 THEN {escape(f'({note})')} WHEN 1 THEN {note} END AS note, NULL AS line
FROM shipments WHERE {day} % 3 <> 2 OR {day} % 7 <> 0
UNION ALL SELECT 'line', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  concat_ws(',', {freight}, order_id, dest, origin, mode, carrier, 'surplus') FROM shipments WHERE {day} % 3 = 2 AND {day} % 7 = 0
UNION ALL SELECT 'file', NULL, NULL, NULL, NULL, NULL, NULL, NULL, unnest(['binary content', 'empty file'])""")
    out["full_detection"] = w(detected(200), f"SELECT {EXPORT}, z_score, iforest_score, anomaly_votes FROM detected")
    out["iforest_scores"] = w(numbered(BASE) + "," + forest(200, 5), "SELECT order_id, iforest_anomaly, iforest_score, false AS iforest_skipped FROM base JOIN forest USING (rid)")
    # rollups
    out["kpis"] = w(ROLLUPS, "SELECT * FROM kpis")
    out["severity_counts"] = w(ROLLUPS, "SELECT * FROM severity_counts")
    out["severity_share"] = w(ROLLUPS, "SELECT rank, severity, orders, " + share("orders", "(SELECT greatest(sum(orders), 1) FROM severity_counts)") + " AS share FROM severity_counts")
    out["carrier_stats"] = w(ROLLUPS, f"SELECT {carrier_cols} FROM carriers")
    out["route_stats"] = w(ROLLUPS, f"SELECT {route_cols} FROM routes")
    out["smoothed_rate"] = w(ROLLUPS, f"SELECT mode, count(*) AS orders, CAST(sum(final_anomaly) AS BIGINT) AS anomalies, round_even((sum(final_anomaly) + (SELECT global_rate FROM overall) * 25.0) / (count(*) + 25.0), 4) AS smoothed_rate FROM detected GROUP BY mode")
    out["monthly_trend"] = w(ROLLUPS, f"SELECT ship_year, ship_month, count(order_id) AS orders, CAST(sum(final_anomaly) AS BIGINT) AS anomalies, round_even({exact_mean('delay_days')}, 2) AS avg_delay, round_even({share('sum(final_anomaly)', 'count(order_id)')}, 4) AS anomaly_rate, concat(ship_year, '-', lpad(CAST(ship_month AS VARCHAR), 2, '0')) AS month_label FROM detected GROUP BY ship_year, ship_month")
    out["method_counts"] = w(DETECTED, "SELECT 'rules' AS method, CAST(sum(rule_anomaly) AS BIGINT) AS hits FROM detected UNION ALL SELECT 'route_zscore', CAST(sum(zscore_anomaly) AS BIGINT) FROM detected UNION ALL SELECT 'iforest', CAST(sum(iforest_anomaly) AS BIGINT) FROM detected")
    out["reason_counts"] = w(ROLLUPS, "SELECT rule, orders FROM reasons ORDER BY orders DESC, rule LIMIT 8")
    out["top_anomalies"] = w(ROLLUPS, "SELECT * EXCLUDE (position) FROM top10")
    out["carrier_display"] = w(ROLLUPS, "SELECT carrier, total_orders, avg_delay, late_rate * 100.0 AS late_rate, anomaly_orders, critical_orders, anomaly_rate * 100.0 AS anomaly_rate, smoothed_rate * 100.0 AS smoothed_rate, sample_note FROM carriers")
    out["route_display"] = w(ROLLUPS, "SELECT route, orders, avg_delay, max_delay, anomalies, critical_orders, anomaly_rate * 100.0 AS anomaly_rate, smoothed_rate * 100.0 AS smoothed_rate, sample_note FROM routes")
    out["carrier_top3"] = w(ROLLUPS, f"SELECT CAST(position AS INTEGER) AS position, carrier AS entity, {percent('smoothed_rate')} AS adjusted_rate, total_orders AS orders, anomaly_orders AS anomalies FROM carriers_ranked WHERE position <= 3")
    out["route_top3"] = w(ROLLUPS, f"SELECT CAST(position AS INTEGER) AS position, route AS entity, {percent('smoothed_rate')} AS adjusted_rate, orders, anomalies FROM routes_ranked WHERE position <= 3")
    # charts
    out["delay_histogram"] = "WITH " + _histogram()
    out["delay_box"] = w(DETECTED, """, q AS (
  SELECT mode, quantile_cont(delay_days, 0.25) AS q1, quantile_cont(delay_days, 0.5) AS median, quantile_cont(delay_days, 0.75) AS q3 FROM detected GROUP BY mode
)
SELECT d.mode, count(*) AS orders, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
  least(coalesce(min(delay_days) FILTER (delay_days >= q1 - 1.5 * (q3 - q1)), any_value(q1)), any_value(q1)) AS whisker_low,
  greatest(coalesce(max(delay_days) FILTER (delay_days <= q3 + 1.5 * (q3 - q1)), any_value(q3)), any_value(q3)) AS whisker_high,
  count(*) FILTER (delay_days < q1 - 1.5 * (q3 - q1) OR delay_days > q3 + 1.5 * (q3 - q1)) AS outliers
FROM detected d JOIN q ON d.mode = q.mode GROUP BY d.mode""")
    out["carrier_chart"] = w(ROLLUPS, f""", m AS (SELECT {exact_mean('anomaly_rate')} AS mean_rate, {exact_mean('avg_delay')} AS mean_delay, max(total_orders) AS largest FROM carriers)
SELECT carrier, total_orders, anomaly_rate, {percent('anomaly_rate')} AS rate_text, mean_rate, anomaly_rate > 0.1 AS rate_marked,
  avg_delay, mean_delay, avg_delay > mean_delay AS delay_marked, CAST(total_orders AS DOUBLE) / greatest(CAST(largest AS DOUBLE), 1.0) * 400 + 100 AS bubble_size
FROM carriers, m""")
    # drill-down and exports
    out["anomaly_detail"] = w(DETECTED, "SELECT order_id, carrier, route, severity, anomaly_methods AS methods, reason AS explanation, anomaly_score AS score, mode, delay_days FROM detected WHERE final_anomaly = 1")
    out["filtered_anomalies"] = w(DETECTED, f"SELECT {EXPORT} FROM detected WHERE final_anomaly = 1 AND severity IN ('critical', 'moderate') AND route IN ('NATION_1→NATION_2', 'NATION_7→NATION_19', 'NATION_19→NATION_12')")
    out["order_explain"] = w(ROLLUPS, "SELECT order_id, severity, anomaly_methods, anomaly_score, reason FROM top10 WHERE position = 1")
    out["category_options"] = w(DETECTED, """, c AS (SELECT route AS value, count(*) AS orders FROM detected WHERE final_anomaly = 1 GROUP BY route)
SELECT value, orders, CAST(row_number() OVER (ORDER BY orders DESC, value) AS INTEGER) AS position, (SELECT count(*) FROM c) > 200 AS truncated
FROM c QUALIFY position <= 200""")
    out["distinct_modes"] = w(SHIPMENTS, "SELECT DISTINCT mode FROM shipments")
    out["present_severities"] = w(DETECTED, "SELECT DISTINCT severity, list_position(['critical', 'moderate', 'minor', 'normal'], severity) AS rank FROM detected WHERE final_anomaly = 1")
    out["export_anomalies"] = w(DETECTED, f"SELECT {EXPORT} FROM detected WHERE final_anomaly = 1")
    out["export_all"] = w(DETECTED, f"SELECT {EXPORT} FROM detected")
    # insight and report tables
    out["risk_band"] = w(ROLLUPS, "SELECT carrier, anomaly_rate, CASE WHEN anomaly_rate >= 0.15 THEN 'high' WHEN anomaly_rate >= 0.05 THEN 'watch' ELSE 'low' END AS risk FROM carriers")
    out["summary_row"] = w(ROLLUPS, f""", facts AS (
  SELECT k.total_orders, k.total_anomalies, k.anomaly_rate,
    CASE WHEN k.anomaly_rate >= 0.15 THEN 'high' WHEN k.anomaly_rate >= 0.05 THEN 'watch' ELSE 'low' END AS risk,
    critical AS critical_orders, moderate AS moderate_orders, c.carrier AS top_carrier, c.total_orders AS top_carrier_orders,
    c.anomaly_orders AS top_carrier_anomalies, c.anomaly_rate AS top_carrier_rate, c.sample_note AS top_carrier_sample,
    r.route AS top_route, r.orders AS top_route_orders, r.anomaly_rate AS top_route_rate, r.sample_note AS top_route_sample,
    coalesce({reason_top}, 'none') AS top_reasons
  FROM kpis k, levels, (SELECT * FROM carriers_ranked WHERE position = 1) c, (SELECT * FROM routes_ranked WHERE position = 1) r
)
SELECT *, concat('Analysed ', {grouped('total_orders')}, ' orders, found ', {grouped('total_anomalies')}, ' anomalies (', {percent('anomaly_rate')},
  '), risk level ', risk, '; critical ', critical_orders, ', moderate ', moderate_orders, '. Leading carrier after sample adjustment: ', top_carrier,
  ' (', top_carrier_orders, ' orders, ', top_carrier_anomalies, ' anomalies, rate ', {percent('top_carrier_rate')}, ')',
  CASE WHEN top_carrier_sample = 'small_sample' THEN ', a small sample that should not be judged alone' ELSE '' END,
  '; leading route: ', top_route, ' (', top_route_orders, ' orders, rate ', {percent('top_route_rate')}, ')',
  CASE WHEN top_route_sample = 'small_sample' THEN ', to be reviewed with more data' ELSE '' END,
  '. Main rule reasons: ', top_reasons, '.') AS summary FROM facts""")
    out["carrier_insight"] = w(ROLLUPS, f"SELECT carrier, concat(carrier, ': ', total_orders, ' orders, ', anomaly_orders, ' anomalies (', {percent('anomaly_rate')}, '), average delay ', {fixed('avg_delay', 1)}, ' days. ', CASE WHEN total_orders < 5 THEN 'Small sample: a first observation only.' ELSE 'The sample allows comparison within this data set.' END, ' Review together with routes and reasons.') AS insight FROM carriers")
    out["carrier_explain"] = w(ROLLUPS, f"""SELECT c.carrier, total_orders, anomaly_orders, sample_note,
  concat(c.carrier, ': ', total_orders, ' orders, ', anomaly_orders, ' anomalies (', {percent('anomaly_rate')}, '), average delay ', {fixed('avg_delay', 1)}, ' days. ', CASE WHEN total_orders < 5 THEN 'Small sample: a first observation only.' ELSE 'The sample allows comparison within this data set.' END, ' Review together with routes and reasons.') AS insight
  FROM carriers_ranked c WHERE position = 1""")
    out["insight_lines"] = w(ROLLUPS, f"SELECT 'carrier' AS kind, CAST(position AS INTEGER) AS position, {CARRIER_FACT} AS line FROM carriers_ranked WHERE position <= 5 UNION ALL SELECT 'route', CAST(position AS INTEGER), {ROUTE_FACT} FROM routes_ranked WHERE position <= 5")
    out["carrier_prompts"] = w(ROLLUPS, f"""SELECT carrier, concat_ws(chr(10), concat('Statistics of carrier ', carrier, ' in this data set:'), concat('- orders: ', total_orders),
  concat('- average delay: ', {fixed('avg_delay', 2)}, ' days'), concat('- late rate: ', {fixed('late_rate * 100.0', 2)}, '%'), concat('- anomalies: ', anomaly_orders),
  concat('- anomaly rate: ', {fixed('anomaly_rate * 100.0', 2)}, '%'), concat('- sample: ', sample_note),
  'Give two or three sentences on performance and next steps. Use only these numbers; state the uncertainty of a small sample.') AS prompt FROM carriers""")
    out["analysis_prompt"] = w(ROLLUPS, f"""SELECT concat_ws(chr(10), 'Write a business analysis of this detection summary.',
  concat('Range: ', start_date, ' to ', end_date),
  concat('Orders: ', total_orders, '; anomalies: ', total_anomalies, '; rate: ', {fixed('anomaly_rate * 100.0', 2)}, '%'),
  concat('Average delay: ', {fixed('avg_delay', 2)}, ' days; longest: ', {fixed('max_delay', 2)}, ' days'),
  concat('Critical/moderate/minor: ', critical, '/', moderate, '/', minor),
  'Riskiest carriers (sample-adjusted):', (SELECT string_agg({CARRIER_FACT}, chr(10) ORDER BY position) FROM carriers_ranked WHERE position <= 5),
  'Riskiest routes (sample-adjusted):', (SELECT string_agg({ROUTE_FACT}, chr(10) ORDER BY position) FROM routes_ranked WHERE position <= 5),
  'Main rule reasons:', coalesce((SELECT string_agg(concat('- ', rule, ': ', orders), chr(10) ORDER BY orders DESC, rule) FROM (SELECT * FROM reasons ORDER BY orders DESC, rule LIMIT 6)), '- none'),
  'Typical cases:', coalesce((SELECT string_agg(concat('- ', concat_ws(' | ', order_id, carrier, route, severity, concat('score ', {fixed('anomaly_score', 1)}), anomaly_methods)), chr(10) ORDER BY position) FROM top10 WHERE position <= 5), '- none'),
  'Do not invent numbers; separate findings from possible causes; state small-sample uncertainty.') AS prompt FROM kpis, levels""")
    out["kpi_cards"] = w(ROLLUPS, f"""SELECT 1 AS position, 'total_orders' AS card, {grouped('total_orders')} AS value FROM kpis
UNION ALL SELECT 2, 'anomalies', {grouped('total_anomalies')} FROM kpis UNION ALL SELECT 3, 'anomaly_rate', {percent('anomaly_rate')} FROM kpis
UNION ALL SELECT 4, 'average_delay', concat({fixed('avg_delay', 1)}, ' days') FROM kpis UNION ALL SELECT 5, 'critical', {grouped('critical')} FROM levels""")
    out["report_carriers"] = w(ROLLUPS, "SELECT CAST(position AS INTEGER) AS position, carrier, total_orders, anomaly_orders, anomaly_rate, avg_delay, sample_note FROM carriers_ranked WHERE position <= 10")
    out["report_routes"] = w(ROLLUPS, "SELECT CAST(position AS INTEGER) AS position, route, orders, anomalies, anomaly_rate, avg_delay, sample_note FROM routes_ranked WHERE position <= 10")
    out["report_cells"] = w(ROLLUPS, f"SELECT CAST(position AS INTEGER) AS position, carrier, CAST(total_orders AS VARCHAR) AS total_orders, CAST(anomaly_orders AS VARCHAR) AS anomaly_orders, {percent('anomaly_rate')} AS anomaly_rate, regexp_replace({fixed('avg_delay', 2)}, '\\.?0+$', '') AS avg_delay, sample_note FROM carriers_ranked WHERE position <= 10")
    out["report_cases"] = w(ROLLUPS, f"SELECT CAST(position AS INTEGER) AS position, concat_ws(' | ', order_id, severity, concat('risk score ', {fixed('anomaly_score', 1)})) AS heading, concat('carrier: ', carrier, '; route: ', route, '; methods: ', anomaly_methods, '; delay: ', {fixed('delay_days', 1)}, ' days') AS facts, concat('reason: ', reason) AS why FROM top10")
    out["report_overview"] = w(ROLLUPS, f"""SELECT 1 AS position, 'summary' AS section, concat('Covers ', {grouped('total_orders')}, ' orders with ', {grouped('total_anomalies')}, ' anomalies (', {percent('anomaly_rate')}, '), ', critical, ' of them critical.') AS text FROM kpis, levels
UNION ALL SELECT 2, 'data', concat('From ', start_date, ' to ', end_date, '; average planned transit ', {fixed('avg_planned_transit', 1)}, ' days; average delay ', {fixed('avg_delay', 1)}, ' days; longest delay ', {fixed('max_delay', 1)}, ' days.') FROM kpis
UNION ALL SELECT 3, 'hits', (SELECT concat('Rules hit ', CAST(sum(rule_anomaly) AS BIGINT), ' orders, route z-score ', CAST(sum(zscore_anomaly) AS BIGINT), ', isolation forest ', CAST(sum(iforest_anomaly) AS BIGINT), '. Rules stand alone; otherwise two methods must agree.') FROM detected)
UNION ALL SELECT 4, 'method', 'z-score threshold 2.5, contamination 0.05; small routes are not judged; severity follows verdict, votes and the critical rule.'""")
    out["recommendations"] = w(ROLLUPS, f""", c AS (SELECT * FROM carriers_ranked WHERE position = 1), r AS (SELECT * FROM routes_ranked WHERE position = 1),
t AS (
  SELECT 1 AS k, concat('Review ', critical, ' critical anomalies first and record their causes.') AS recommendation FROM levels WHERE critical > 0
  UNION ALL SELECT 2, concat('For ', carrier, ' review together orders ', total_orders, ', anomalies ', anomaly_orders, ' and anomaly rate ', {percent('anomaly_rate')}, CASE WHEN sample_note = 'small_sample' THEN ' (small sample, observe first)' ELSE '' END, '.') FROM c
  UNION ALL SELECT 3, concat('Check planned transit and handovers of route ', route, ' and follow its adjusted rank by month.') FROM r
  UNION ALL SELECT 4, 'Feed reviewed causes back into operations and recalibrate the thresholds regularly.'
)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, recommendation FROM t""")
    # first-generation variants
    out["v1_rules"] = w(V1, "SELECT order_id, rule_anomaly, rule_reason FROM v1rules")
    out["v1_zscore"] = w(V1, "SELECT order_id, zscore_anomaly, z_score FROM v1votes")
    out["v1_iforest"] = w(numbered(BASE) + "," + forest(100, 4), "SELECT order_id, iforest_anomaly, iforest_score FROM base JOIN forest USING (rid)")
    out["v1_ensemble"] = w(V1, "SELECT order_id, anomaly_votes, final_anomaly, severity FROM v1")
    out["v1_kpis"] = w(V1, f"SELECT count(*) AS total_orders, CAST(sum(final_anomaly) AS BIGINT) AS total_anomalies, round_even({share('sum(final_anomaly)', 'count(*)')}, 4) AS anomaly_rate, round_even({exact_mean('delay_days')}, 2) AS avg_delay, CAST(max(delay_days) AS BIGINT) AS max_delay FROM v1")
    out["v1_carrier_stats"] = w(V1ROLL, "SELECT * FROM carriers1")
    out["v1_route_stats"] = w(V1ROLL, "SELECT * FROM routes1")
    out["v1_monthly"] = w(V1, f"SELECT ship_year, ship_month, count(order_id) AS orders, CAST(sum(final_anomaly) AS BIGINT) AS anomalies, round_even({exact_mean('delay_days')}, 2) AS avg_delay, round_even({share('sum(final_anomaly)', 'count(order_id)')}, 3) AS anomaly_rate FROM v1 GROUP BY ship_year, ship_month")
    out["v1_severity_counts"] = w(V1, "SELECT severity, count(*) AS orders FROM v1 GROUP BY severity")
    out["v1_top"] = w(V1, "SELECT order_id, carrier, route, mode, delay_days, severity, rule_reason FROM v1 WHERE final_anomaly = 1 ORDER BY delay_days DESC, order_id LIMIT 10")
    out["v1_best_worst"] = w(V1ROLL, "SELECT (SELECT carrier FROM carriers1 ORDER BY anomaly_rate DESC, carrier LIMIT 1) AS worst_carrier, (SELECT carrier FROM carriers1 ORDER BY anomaly_rate, carrier DESC LIMIT 1) AS best_carrier")
    out["v1_report"] = w(V1ROLL, f"SELECT carrier, total_orders, avg_delay, {percent('late_rate')} AS late_rate, anomaly_orders, {percent('anomaly_rate')} AS anomaly_rate FROM carriers1")
    out["v1_report_routes"] = w(V1ROLL, f"SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY avg_delay DESC, route) AS INTEGER) AS position, route, orders, round_even(avg_delay, 1) AS avg_delay, max_delay, anomalies, {percent('anomaly_rate')} AS anomaly_rate FROM routes1) WHERE position <= 8")
    out["v1_prompt_lines"] = w(V1ROLL, f"SELECT 'carrier' AS kind, concat('- ', carrier, ': anomaly rate ', {percent('anomaly_rate')}, ', average delay ', {fixed('avg_delay', 1)}, ' days, ', total_orders, ' orders') AS line FROM carriers1 UNION ALL SELECT 'route', line FROM (SELECT concat('- ', route, ': average delay ', {fixed('avg_delay', 1)}, ' days, longest delay ', {fixed('max_delay', 1)}, ' days, anomaly rate ', {percent('anomaly_rate')}) AS line FROM routes1 ORDER BY avg_delay DESC, route LIMIT 5)")
    return {k: v.strip() for k, v in out.items()}
