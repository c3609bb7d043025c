"""The registered queries again as plain DuckDB SQL, for the side-by-side check."""

from fenceline.operators.profile import BLANK_TEXTS, BOOLEAN_TEXTS, DATE_WORDS, ID_WORDS, METRIC_WORDS

RAW = """
raw_daily AS (
  SELECT date, store_id, sku_id, on_hand, sold, delivered, returned,
         CAST(cents // units AS DOUBLE) / 100 AS price, promo_flag
  FROM (
    SELECT CAST(l_shipdate AS DATE) AS date,
           'ST-' || lpad(CAST(l_suppkey % 5 AS VARCHAR), 3, '0') AS store_id,
           'SKU-' || lpad(CAST(l_partkey % 5 AS VARCHAR), 3, '0') AS sku_id,
           CAST(500 + sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END) AS BIGINT) AS on_hand,
           CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS sold,
           CAST(sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS BIGINT) AS delivered,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS returned,
           CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents,
           CAST(sum(l_quantity) AS BIGINT) AS units,
           max(l_discount) >= 0.08 AS promo_flag
    FROM lineitem GROUP BY 1, 2, 3
  )
)"""

FEATURES = (
    RAW
    + """,
features AS (
  SELECT *, on_hand - lag(on_hand) OVER p AS delta_on_hand,
         lag(date) OVER p AS prev_date,
         isodow(date) - 1 AS day_of_week,
         avg(sold) OVER r AS sold_rolling_mean, stddev_pop(sold) OVER r AS sold_rolling_std,
         avg(on_hand) OVER r AS on_hand_rolling_mean, stddev_pop(on_hand) OVER r AS on_hand_rolling_std
  FROM raw_daily
  WINDOW p AS (PARTITION BY store_id, sku_id ORDER BY date),
         r AS (PARTITION BY store_id, sku_id ORDER BY date
               RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)
)"""
)

TUKEY = (
    FEATURES
    + """,
observed AS (
  SELECT 'sold' AS metric_name, date, store_id, sku_id, sold AS value,
         date + 1 AS t0, date + 28 AS t1, true AS is_target FROM features
  UNION ALL
  SELECT 'delta_on_hand', date, store_id, sku_id, delta_on_hand,
         date + 1, least(date + 28, prev_date + 29), prev_date = date - 1
  FROM features WHERE delta_on_hand IS NOT NULL
),
base_pair AS (
  SELECT t.metric_name, t.store_id, t.sku_id, t.date, count(*) AS n,
         quantile_cont(o.value, 0.25) AS q1, quantile_cont(o.value, 0.75) AS q3
  FROM (SELECT DISTINCT metric_name, store_id, sku_id, date FROM observed WHERE is_target) t
  JOIN observed o ON o.metric_name = t.metric_name AND o.store_id = t.store_id AND o.sku_id = t.sku_id
                 AND t.date BETWEEN o.t0 AND o.t1
  GROUP BY ALL
),
short AS (
  SELECT o.* FROM observed o LEFT JOIN base_pair b USING (metric_name, store_id, sku_id, date)
  WHERE o.is_target AND coalesce(b.n, 0) < 10
),
base_store AS (
  SELECT t.metric_name, t.store_id, t.date, count(*) AS n,
         quantile_cont(o.value, 0.25) AS q1, quantile_cont(o.value, 0.75) AS q3
  FROM (SELECT DISTINCT metric_name, store_id, date FROM short) t
  JOIN observed o ON o.metric_name = t.metric_name AND o.store_id = t.store_id AND t.date BETWEEN o.t0 AND o.t1
  GROUP BY ALL
),
base_sku AS (
  SELECT t.metric_name, t.sku_id, t.date, count(*) AS n,
         quantile_cont(o.value, 0.25) AS q1, quantile_cont(o.value, 0.75) AS q3
  FROM (SELECT DISTINCT metric_name, sku_id, date FROM short) t
  JOIN observed o ON o.metric_name = t.metric_name AND o.sku_id = t.sku_id AND t.date BETWEEN o.t0 AND o.t1
  GROUP BY ALL
),
base_global AS (
  SELECT t.metric_name, t.date, count(*) AS n,
         quantile_cont(o.value, 0.25) AS q1, quantile_cont(o.value, 0.75) AS q3
  FROM (SELECT DISTINCT metric_name, date FROM short) t
  JOIN observed o ON o.metric_name = t.metric_name AND t.date BETWEEN o.t0 AND o.t1
  GROUP BY ALL
),
leveled AS (
  SELECT o.metric_name, o.date, o.store_id, o.sku_id, CAST(o.value AS DOUBLE) AS actual_value,
         CASE WHEN p.n >= 10 THEN 0 WHEN s.n >= 10 THEN 1 WHEN k.n >= 10 THEN 2 WHEN g.n >= 10 THEN 3 END AS level,
         coalesce(CASE WHEN p.n >= 10 THEN p.n WHEN s.n >= 10 THEN s.n WHEN k.n >= 10 THEN k.n ELSE g.n END, 0) AS n,
         CASE WHEN p.n >= 10 THEN p.q1 WHEN s.n >= 10 THEN s.q1 WHEN k.n >= 10 THEN k.q1 WHEN g.n >= 10 THEN g.q1 ELSE 0 END AS q1,
         CASE WHEN p.n >= 10 THEN p.q3 WHEN s.n >= 10 THEN s.q3 WHEN k.n >= 10 THEN k.q3 WHEN g.n >= 10 THEN g.q3 ELSE 0 END AS q3
  FROM observed o
  LEFT JOIN base_pair p USING (metric_name, store_id, sku_id, date)
  LEFT JOIN base_store s USING (metric_name, store_id, date)
  LEFT JOIN base_sku k USING (metric_name, sku_id, date)
  LEFT JOIN base_global g USING (metric_name, date)
  WHERE o.is_target
),
tukey AS (
  SELECT *, CASE WHEN level IS NOT NULL AND actual_value < lower_fence THEN actual_value - lower_fence
                 WHEN level IS NOT NULL AND actual_value > upper_fence THEN actual_value - upper_fence ELSE 0 END AS outlier_distance,
         level IS NOT NULL AND (actual_value < lower_fence OR actual_value > upper_fence) AS is_outlier
  FROM (
    SELECT metric_name, date, store_id, sku_id, actual_value, n AS sample_size, q1, q3, q3 - q1 AS iqr,
           q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence, level,
           CASE level WHEN 0 THEN 'pair' WHEN 1 THEN 'store' WHEN 2 THEN 'sku' WHEN 3 THEN 'global'
                ELSE 'insufficient_data' END AS fallback_used
    FROM leveled
  )
)"""
)


FLAGGED = (
    TUKEY
    + """,
flagged AS (
  SELECT t.*, greatest(abs(coalesce(f.sold, 0) * f.price), abs(coalesce(f.delta_on_hand, 0) * f.price)) AS impact
  FROM (
    SELECT date, store_id, sku_id,
           max(CASE WHEN metric_name = 'sold' THEN outlier_distance END) AS sold_distance,
           max(CASE WHEN metric_name = 'delta_on_hand' THEN outlier_distance END) AS delta_distance,
           sum(least(abs(outlier_distance) / 50, 1)) AS closeness, count(*) AS flags
    FROM tukey WHERE is_outlier GROUP BY ALL
  ) t JOIN features f USING (date, store_id, sku_id)
),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY date, store_id ORDER BY sku_id) AS rank,
         CASE WHEN sold_distance IS NOT NULL THEN 'Unusual sales for ' || sku_id
              ELSE 'Inventory anomaly for ' || sku_id END AS headline,
         '• ' || sku_id || ': ' || concat_ws('; ',
            CASE WHEN sold_distance IS NOT NULL THEN 'sold ' || printf('%.1f', abs(sold_distance))
                 || CASE WHEN sold_distance > 0 THEN ' above' ELSE ' below' END || ' normal range' END,
            CASE WHEN delta_distance IS NOT NULL THEN 'delta_on_hand ' || printf('%.1f', abs(delta_distance))
                 || CASE WHEN delta_distance > 0 THEN ' above' ELSE ' below' END || ' normal range' END) AS line
  FROM flagged
),
incident_group AS (
  SELECT date, store_id, n AS sku_count, impact AS estimated_impact,
         least(20 + least(n * 5, 20) + CASE WHEN impact > 0 THEN least(log10(impact + 1) * 5, 30) ELSE 0 END
               + closeness * 10, 100) AS severity_score,
         CASE WHEN n = 1 THEN headline1 ELSE n || ' SKUs with anomalies in store ' || store_id END AS headline,
         told || CASE WHEN n > 5 THEN chr(10) || '• ...and ' || (n - 5) || ' more SKUs' ELSE '' END AS description,
         left(sha256(CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) || '_' || store_id || '_' || n || '_' || skus), 32) AS dedup_key
  FROM (
    SELECT date, store_id, count(*) AS n, sum(impact) AS impact, sum(closeness) / sum(flags) AS closeness,
           max(CASE WHEN rank = 1 THEN headline END) AS headline1,
           string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 5) AS told,
           bit_xor(CAST('0x' || left(sha256(sku_id), 15) AS BIGINT)) AS skus
    FROM lines GROUP BY ALL
  )
),
run AS (
  SELECT dedup_key, min(date) AS date, any_value(store_id) AS store_id,
         arg_min(headline, date) AS headline, arg_min(description, date) AS description,
         arg_max(severity_score, date) AS severity_score, arg_max(estimated_impact, date) AS estimated_impact,
         arg_max(sku_count, date) AS sku_count, arg_min(estimated_impact, date) AS first_impact, count(*) AS groups
  FROM incident_group GROUP BY dedup_key
),
incident AS (
  SELECT *, CASE WHEN dedup_key[1] IN ('a', 'b', 'c', 'd') THEN 'investigating'
                 WHEN dedup_key[1] IN ('e', 'f') THEN 'resolved' ELSE 'open' END AS status
  FROM run
),
detection AS (
  SELECT *, left(sha256(concat_ws('|', CAST(date AS VARCHAR), store_id, sku_id, 'tukey', metric_name)), 32) AS detection_id
  FROM tukey
),
items AS (
  SELECT r.dedup_key AS incident_id, f.date, f.store_id, f.sku_id,
         CASE WHEN r.first_impact = 0 THEN 0 ELSE f.impact / r.first_impact END AS contribution_score,
         (SELECT string_agg(d.detection_id, ',' ORDER BY d.detection_id) FROM detection d
          WHERE d.date = f.date AND d.store_id = f.store_id AND d.sku_id = f.sku_id) AS detection_result_ids
  FROM run r JOIN flagged f USING (date, store_id)
)"""
)

BASELINE = (
    FEATURES
    + """,
windowed AS (
  SELECT *, count(*) OVER r AS pair_rows, count(*) OVER s AS store_rows
         {columns}
  FROM features
  WINDOW r AS (PARTITION BY store_id, sku_id ORDER BY date
               RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
         s AS (PARTITION BY store_id ORDER BY date
               RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)
),
baseline AS (
  SELECT date, store_id, sku_id, sold, delivered, returned, delta_on_hand, price,
         CASE WHEN pair_rows >= 5 THEN pair_rows ELSE store_rows END AS baseline_rows {stats}
  FROM windowed
)"""
)
_REASON_FEATURES = ("sold", "delivered", "returned", "delta_on_hand", "price")
BASELINE = BASELINE.replace(
    "{columns}",
    "".join(
        f", count({c}) OVER {w} AS {c}_{w}_n, avg({c}) OVER {w} AS {c}_{w}_mean, stddev_pop({c}) OVER {w} AS {c}_{w}_std\n"
        for c in _REASON_FEATURES
        for w in "rs"
    ),
).replace(
    "{stats}",
    "".join(
        f""",
         CASE WHEN baseline_rows = 0 THEN NULL WHEN pair_rows >= 5 AND {c}_r_n > 0 THEN {c}_r_mean
              WHEN pair_rows < 5 AND {c}_s_n > 0 THEN {c}_s_mean ELSE 0 END AS {c}_mean,
         CASE WHEN baseline_rows = 0 THEN NULL WHEN pair_rows >= 5 AND {c}_r_n > 1 THEN {c}_r_std
              WHEN pair_rows < 5 AND {c}_s_n > 1 THEN {c}_s_std ELSE 1 END AS {c}_std"""
        for c in _REASON_FEATURES
    ),
)

SCOPES = (
    FEATURES
    + """,
scope_day AS (
  SELECT 'store:' || store_id AS scope, date, count(*) AS n FROM features GROUP BY ALL
  UNION ALL SELECT 'global', date, count(*) FROM features GROUP BY ALL
),
training AS (
  SELECT scope, date, coalesce(sum(n) OVER (PARTITION BY scope ORDER BY date
           RANGE BETWEEN INTERVAL 91 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0)::BIGINT AS training_rows
  FROM scope_day
),
cutoff AS (SELECT scope, min(date) AS cutoff FROM training WHERE training_rows >= 100 GROUP BY scope)"""
)

# The interpolation is spelled out from the ordered values, so that both sides do the same arithmetic.
EVENTS = """
event AS (
  SELECT event_id AS row_id, CAST(ts AS DATE) AS date, event_type, CAST(user_id AS VARCHAR) AS user_id, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, props,
         left(sha256('event_type=' || event_type || '|user_id=' || CAST(user_id AS VARCHAR)), 32) AS identifier_key,
         'event_type=' || event_type || ', user_id=' || CAST(user_id AS VARCHAR) AS label
  FROM events
),
metric AS (
  SELECT row_id, date, identifier_key, label, 0 AS metric_order, 'value' AS metric_name, value AS actual_value FROM event WHERE value IS NOT NULL
  UNION ALL SELECT row_id, date, identifier_key, label, 1, 'k', k FROM event WHERE k IS NOT NULL
),
ordered AS (SELECT metric_name, count(*) AS n, list(actual_value ORDER BY actual_value) AS v FROM metric GROUP BY ALL),
neighbour AS (
  SELECT metric_name, n, (n - 1) * 0.25 - floor((n - 1) * 0.25) AS f1, (n - 1) * 0.75 - floor((n - 1) * 0.75) AS f3,
         v[floor((n - 1) * 0.25)::BIGINT + 1] AS a1, v[least(floor((n - 1) * 0.25)::BIGINT + 2, n)] AS b1,
         v[floor((n - 1) * 0.75)::BIGINT + 1] AS a3, v[least(floor((n - 1) * 0.75)::BIGINT + 2, n)] AS b3
  FROM ordered WHERE n >= 10
),
quartile AS (
  SELECT metric_name, CASE WHEN f1 < 0.5 THEN a1 + (b1 - a1) * f1 ELSE b1 - (b1 - a1) * (1 - f1) END AS q1,
         CASE WHEN f3 < 0.5 THEN a3 + (b3 - a3) * f3 ELSE b3 - (b3 - a3) * (1 - f3) END AS q3
  FROM neighbour
),
flex AS (
  SELECT *, actual_value < lower_fence OR actual_value > upper_fence AS is_outlier,
         CASE WHEN actual_value < lower_fence THEN actual_value - lower_fence
              WHEN actual_value > upper_fence THEN actual_value - upper_fence ELSE 0 END AS outlier_distance
  FROM (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
        FROM metric JOIN quartile USING (metric_name))
)"""

ORDERS = """
dirty AS (
  SELECT o_orderkey AS row_index,
         CASE WHEN o_orderkey % 19 = 5 THEN 'not a date'
              WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
              ELSE CAST(epoch(o_orderdate)::BIGINT AS VARCHAR) END AS order_date,
         CASE WHEN o_orderkey % 17 = 3 THEN NULL WHEN o_orderkey % 17 = 4 THEN '  '
              ELSE ' C' || o_custkey || ' ' END AS customer,
         CASE WHEN o_orderkey % 17 = 5 THEN NULL ELSE 'P' || o_orderpriority[1] END AS priority,
         CASE WHEN o_orderkey % 17 = 3 THEN 'not a number' WHEN o_orderkey % 17 = 6 THEN NULL
              ELSE '$' || cents // 100000 || ',' || lpad(CAST(cents // 100 % 1000 AS VARCHAR), 3, '0')
                   || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS total,
         o_orderstatus AS status
  FROM (SELECT *, floor(o_totalprice * 100 + 0.5)::BIGINT AS cents FROM orders)
),
parsed AS (
  SELECT row_index,
         CASE WHEN regexp_full_match(order_date, '\\d+') THEN DATE '1970-01-01' + (CAST(order_date AS BIGINT) // 86400)::INTEGER
              ELSE CAST(coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%d/%m/%Y')) AS DATE) END AS date,
         trim(customer) AS customer, trim(priority) AS priority,
         TRY_CAST(regexp_replace(total, '[$,]', '', 'g') AS DOUBLE) AS total, status
  FROM dirty
),
keyed AS (
  SELECT *, coalesce(customer, priority) IS NULL AS no_id, total IS NULL AS no_metric,
         CASE WHEN coalesce(customer, priority) IS NOT NULL
              THEN left(sha256(concat_ws('|', 'customer=' || customer, 'priority=' || priority)), 32) END AS identifier_key
  FROM parsed
)"""


# Both detectors: planted forest flags beside the fences.
BOTH = (
    TUKEY
    + """,
planted AS (
  SELECT date, store_id, sku_id, CASE WHEN sold % 2 = 0 THEN 'price is 2.0 std above average' END AS told
  FROM features WHERE (sold + (date - DATE '1970-01-01')) % 50 = 0
),
fenced AS (
  SELECT date, store_id, sku_id,
         max(CASE WHEN metric_name = 'sold' THEN outlier_distance END) AS sold_distance,
         max(CASE WHEN metric_name = 'delta_on_hand' THEN outlier_distance END) AS delta_distance,
         sum(least(abs(outlier_distance) / 50, 1)) AS closeness, count(*) AS flags
  FROM tukey WHERE is_outlier GROUP BY ALL
),
flagged AS (
  SELECT date, store_id, sku_id, sold_distance, delta_distance, coalesce(closeness, 0) AS closeness,
         coalesce(flags, 0) AS flags, flags IS NOT NULL AS by_tukey, p.date IS NOT NULL AS by_forest, told,
         greatest(abs(coalesce(f.sold, 0) * f.price), abs(coalesce(f.delta_on_hand, 0) * f.price)) AS impact
  FROM fenced FULL JOIN planted p USING (date, store_id, sku_id) JOIN features f USING (date, store_id, sku_id)
),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY date, store_id ORDER BY sku_id) AS rank,
         CASE WHEN sold_distance IS NOT NULL THEN 'Unusual sales for ' WHEN delta_distance IS NOT NULL THEN 'Inventory anomaly for '
              WHEN told IS NOT NULL THEN 'price anomaly for ' ELSE 'Anomaly detected for ' END || sku_id AS headline,
         CASE WHEN coalesce(sold_distance, delta_distance) IS NOT NULL OR told IS NOT NULL THEN
         '• ' || sku_id || ': ' || concat_ws('; ',
            CASE WHEN sold_distance IS NOT NULL THEN 'sold ' || printf('%.1f', abs(sold_distance))
                 || CASE WHEN sold_distance > 0 THEN ' above' ELSE ' below' END || ' normal range' END,
            CASE WHEN delta_distance IS NOT NULL THEN 'delta_on_hand ' || printf('%.1f', abs(delta_distance))
                 || CASE WHEN delta_distance > 0 THEN ' above' ELSE ' below' END || ' normal range' END, told) END AS line
  FROM flagged
),
incident_group AS (
  SELECT date, store_id, n AS sku_count, impact AS estimated_impact,
         concat_ws(',', CASE WHEN by_forest THEN 'isolation_forest' END, CASE WHEN by_tukey THEN 'tukey' END) AS detectors,
         least(20 * (by_forest::INT + by_tukey::INT) + least(n * 5, 20)
               + CASE WHEN impact > 0 THEN least(log10(impact + 1) * 5, 30) ELSE 0 END + coalesce(closeness, 0) * 10, 100) AS severity_score,
         CASE WHEN n = 1 THEN headline1 ELSE n || ' SKUs with anomalies in store ' || store_id END AS headline,
         coalesce(nullif(concat_ws(chr(10), told, CASE WHEN n > 5 THEN '• ...and ' || (n - 5) || ' more SKUs' END), ''),
                  'Multiple anomalies detected') AS description,
         left(sha256(CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) || '_' || store_id || '_' || n || '_' || skus), 32) AS dedup_key
  FROM (
    SELECT date, store_id, count(*) AS n, sum(impact) AS impact, sum(closeness) / nullif(sum(flags), 0) AS closeness,
           bool_or(by_tukey) AS by_tukey, bool_or(by_forest) AS by_forest,
           max(CASE WHEN rank = 1 THEN headline END) AS headline1,
           string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 5) AS told,
           bit_xor(CAST('0x' || left(sha256(sku_id), 15) AS BIGINT)) AS skus
    FROM lines GROUP BY ALL
  )
),
run AS (
  SELECT dedup_key, min(date) AS date, any_value(store_id) AS store_id,
         arg_min(headline, date) AS headline, arg_min(description, date) AS description,
         arg_max(severity_score, date) AS severity_score, arg_max(estimated_impact, date) AS estimated_impact,
         arg_max(sku_count, date) AS sku_count, arg_max(detectors, date) AS detectors
  FROM incident_group GROUP BY dedup_key
),
item AS (
  SELECT r.dedup_key, count(DISTINCT f.sku_id) AS items, count(*) AS item_detections
  FROM run r JOIN flagged f USING (date, store_id)
  JOIN (SELECT date, store_id, sku_id FROM tukey UNION ALL SELECT date, store_id, sku_id FROM planted) d
    ON d.date = f.date AND d.store_id = f.store_id AND d.sku_id = f.sku_id
  GROUP BY ALL
)"""
)

# A span that ran again on rows without two days of each month.
RERUN = "BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'"
AGAIN = TUKEY.replace(
    "FROM lineitem GROUP BY 1, 2, 3",
    f"""FROM lineitem WHERE NOT (CAST(l_shipdate AS DATE) {RERUN} AND day(CAST(l_shipdate AS DATE)) IN (7, 8))
    GROUP BY 1, 2, 3""",
)


def _cells(select: str, columns: list[str], order: str) -> str:
    """(ordinal, column_name, value, pos) of the text of some columns."""
    parts = [
        f"SELECT {i} AS ordinal, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, {order} AS pos FROM {select}"
        for i, c in enumerate(columns)
    ]
    return "cell AS (" + " UNION ALL ".join(parts) + ")"


def _contains(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(column_name), '{w}')" for w in words) + ")"


ID_HINT, METRIC_HINT, DATE_HINT = map(_contains, (ID_WORDS, METRIC_WORDS, DATE_WORDS))
BOOLEANS = ", ".join(f"'{w}'" for w in BOOLEAN_TEXTS)
BLANKS = ", ".join(f"'{w}'" for w in BLANK_TEXTS)

COUNTED = """,
counted AS (
  SELECT ordinal, column_name, count(*) AS total, count(*) - count(value) AS nulls, count(DISTINCT value) AS uniques
  FROM cell GROUP BY ALL
)"""

ROLES = """,
typed AS (
  SELECT ordinal, column_name, uniques, uniques / total AS ratio,
         CASE WHEN column_name IN ({integers}) THEN 'integer' WHEN column_name IN ({floats}) THEN 'float'
              WHEN column_name IN ({times}) THEN 'datetime'
              WHEN uniques / (total - nulls) < 0.5 THEN 'categorical' ELSE 'text' END AS detected_type
  FROM counted
),
role AS (
  SELECT *, CASE WHEN detected_type = 'datetime' THEN ['date', '0.95']
       WHEN {id} AND detected_type IN ('categorical', 'text', 'integer') THEN ['identifier', '0.8']
       WHEN {metric} AND detected_type IN ('integer', 'float') THEN ['metric', '0.9']
       WHEN detected_type IN ('categorical', 'text') AND ratio < 0.1 AND uniques < 1000 THEN ['identifier', '0.7']
       WHEN detected_type IN ('categorical', 'text') AND ratio < 0.3 THEN ['identifier', '0.5']
       WHEN detected_type IN ('integer', 'float') AND ratio > 0.1 THEN ['metric', '0.7']
       WHEN detected_type IN ('integer', 'float') AND uniques < 50 THEN ['identifier', '0.5']
       WHEN detected_type IN ('integer', 'float') THEN ['metric', '0.6']
       ELSE ['attribute', '0.3'] END AS r
  FROM typed
)"""
ROLES = ROLES.format(
    integers="'p_partkey', 'p_size', 'user_id'", floats="'p_retailprice', 'value'", times="'ts'", id=ID_HINT, metric=METRIC_HINT
)
PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
EVENT_COLUMNS = ["ts", "user_id", "event_type", "value", "props"]
DIRTY_COLUMNS = ["order_date", "customer", "priority", "total", "status"]

CREATED = "'Incident created by automated detection. Triggered by: tukey'"

CHANGES = (
    FLAGGED
    + """,
request AS (
  SELECT dedup_key AS incident_id, i AS change_id, status AS start_status, 5400 * i AS asked_at,
         CASE WHEN dedup_key[i + 1] IN ('0', '1', '2', '3') THEN 'investigating'
              WHEN dedup_key[i + 1] IN ('4', '5', '6', '7') THEN 'resolved'
              WHEN dedup_key[i + 1] IN ('8', '9') THEN 'open' END AS new_status,
         CASE WHEN dedup_key[i + 4] IN ('0', '1', '2', '3') THEN 'user-' || dedup_key[i + 7]
              WHEN dedup_key[i + 4] = '4' THEN '' END AS new_assignee,
         CASE WHEN dedup_key[i + 10] = '0' THEN 'checked' END AS new_reason
  FROM incident, (VALUES (1), (2), (3)) v(i) WHERE dedup_key[i + 1] <> 'f'
),
step AS (
  SELECT *, coalesce(last_value(new_status IGNORE NULLS) OVER w, start_status) AS old_status,
         nullif(last_value(new_assignee IGNORE NULLS) OVER w, '') AS old_assignee
  FROM request
  WINDOW w AS (PARTITION BY incident_id ORDER BY change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def oracle_sql() -> dict[str, str]:
    sql = {}
    sql["features_daily"] = _with(
        FEATURES,
        """SELECT CAST(date AS VARCHAR) AS date, store_id, sku_id, on_hand, sold, delivered, returned, price, promo_flag,
               CAST(delta_on_hand AS DOUBLE) AS delta_on_hand, CAST(day_of_week AS BIGINT) AS day_of_week,
               round(sold_rolling_mean, 6) AS sold_rolling_mean, round(sold_rolling_std, 6) AS sold_rolling_std,
               round(on_hand_rolling_mean, 6) AS on_hand_rolling_mean, round(on_hand_rolling_std, 6) AS on_hand_rolling_std
        FROM features""",
    )
    sql["tukey_results"] = _with(
        TUKEY,
        """SELECT CAST(date AS VARCHAR) AS date, store_id, sku_id, metric_name, actual_value, q1, q3, iqr, lower_fence,
               upper_fence, outlier_distance, is_outlier, CAST(sample_size AS BIGINT) AS sample_size, fallback_used
        FROM tukey""",
    )
    sql["tukey_results_sparse"] = (
        sql["tukey_results"].replace("l_suppkey % 5", "l_suppkey % 400").replace("l_partkey % 5", "l_partkey % 300")
    )
    sql["tukey_levels"] = _with(
        TUKEY,
        """SELECT metric_name, fallback_used, count(*) AS results, count(*) FILTER (is_outlier) AS flagged
        FROM tukey GROUP BY ALL""",
    )
    sql["tukey_fences"] = _with(
        RAW,
        """SELECT store_id, sku_id, n AS sample_size, q1, q3, q3 - q1 AS iqr,
               q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
        FROM (SELECT store_id, sku_id, count(*) AS n, quantile_cont(sold, 0.25) AS q1, quantile_cont(sold, 0.75) AS q3
              FROM raw_daily GROUP BY ALL)""",
    )
    sql["tukey_reasons"] = _with(
        TUKEY,
        """SELECT CAST(date AS VARCHAR) AS date, store_id, sku_id, metric_name,
               CASE WHEN outlier_distance > 0 THEN 'above_upper_fence' ELSE 'below_lower_fence' END AS type,
               metric_name || ' value (' || printf('%.1f', actual_value) || ') is ' || printf('%.1f', abs(outlier_distance))
               || CASE WHEN outlier_distance > 0 THEN ' above upper fence (' || printf('%.1f', upper_fence)
                       ELSE ' below lower fence (' || printf('%.1f', lower_fence) END || ')' AS message,
               outlier_distance AS distance
        FROM tukey WHERE is_outlier""",
    )
    day = "CAST(date AS VARCHAR) AS date, store_id"
    group = "SELECT {} FROM incident_group"
    sql["incident_groups"] = _with(
        FLAGGED, group.format(f"{day}, sku_count, round(estimated_impact, 4) AS estimated_impact")
    )
    sql["incident_severity"] = _with(FLAGGED, group.format(f"{day}, round(severity_score, 6) AS severity_score"))
    sql["incident_dedup"] = _with(FLAGGED, group.format(f"{day}, dedup_key"))
    sql["incident_headline"] = _with(FLAGGED, group.format(f"{day}, headline"))
    sql["incident_description"] = _with(FLAGGED, group.format(f"{day}, description"))
    sql["incidents"] = _with(
        FLAGGED,
        f"""SELECT dedup_key AS incident_id, {day}, 'open' AS status, round(severity_score, 4) AS severity_score,
               headline, description, sku_count, round(estimated_impact, 4) AS estimated_impact,
               'tukey' AS detectors_triggered FROM run""",
    )
    sql["incidents_both_detectors"] = _with(
        BOTH,
        f"""SELECT dedup_key AS incident_id, {day}, round(severity_score, 4) AS severity_score, headline, description, sku_count,
               round(estimated_impact, 4) AS estimated_impact, detectors AS detectors_triggered, items, item_detections
        FROM run JOIN item USING (dedup_key)""",
    )
    counts = """SELECT CAST({} AS BIGINT) AS version, strftime(date, '%Y-%m') AS month, metric_name, count(*) AS results,
               count(DISTINCT date) AS dates, count(*) FILTER (is_outlier) AS flagged,
               CAST(sum(sample_size) AS BIGINT) AS sample_size FROM {} GROUP BY ALL"""
    old, new = (_with(c, "SELECT date, metric_name, is_outlier, sample_size FROM tukey") for c in (TUKEY, AGAIN))
    after = f"(SELECT * FROM ({old}) WHERE NOT date {RERUN} UNION ALL SELECT * FROM ({new}) WHERE date {RERUN})"
    sql["versioned_rerun"] = counts.format(1, f"({old})") + " UNION ALL " + counts.format(2, after)
    sql["incident_merge"] = _with(
        FLAGGED,
        """SELECT dedup_key AS incident_id, CAST(date AS VARCHAR) AS date,
               CASE WHEN old THEN status ELSE 'open' END AS status,
               CASE WHEN old AND status = 'resolved' THEN 1.0 ELSE round(severity_score, 4) END AS severity_score,
               sku_count, CASE WHEN NOT old THEN 'created' WHEN status = 'resolved' THEN 'unchanged' ELSE 'updated' END AS change
        FROM (SELECT *, date < DATE '1998-06-30' AS old FROM incident)""",
    )
    sql["incident_history"] = (
        f"SELECT incident_id, date, status, severity_score, sku_count FROM ({sql['incident_merge']})"
    )
    sql["incident_items"] = _with(
        FLAGGED,
        "SELECT incident_id, sku_id, round(contribution_score, 6) AS contribution_score, detection_result_ids FROM items",
    )
    sql["incident_notes"] = _with(
        FLAGGED,
        f"""SELECT dedup_key AS incident_id, 'system' AS author, {CREATED} AS content,
               'status_change' AS note_type FROM run""",
    )
    sql["run_stats"] = _with(
        FLAGGED,
        """SELECT (SELECT count(*) FROM features) AS features_created,
               (SELECT count(*) FROM tukey WHERE is_outlier) AS tukey_flags,
               (SELECT count(*) FROM run) AS incidents_created,
               (SELECT CAST(sum(groups - 1) AS BIGINT) FROM run) AS incidents_updated, 'full' AS mode""",
    )
    sql["incident_list"] = _with(
        FLAGGED,
        f"""SELECT dedup_key AS incident_id, {day}, status, round(severity_score, 4) AS severity_score, headline
        FROM (SELECT * FROM incident WHERE status = 'open' AND severity_score >= 40
              AND date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'
              ORDER BY severity_score DESC, date DESC, dedup_key LIMIT 20 OFFSET 20)""",
    )
    sql["incident_list_next"] = _with(
        FLAGGED,
        f"""SELECT dedup_key AS incident_id, {day}, round(severity_score, 4) AS severity_score
        FROM (SELECT * FROM incident WHERE status = 'open' AND severity_score >= 40
              ORDER BY severity_score DESC, date DESC, dedup_key LIMIT 20 OFFSET 20)""",
    )
    sql["incident_total"] = _with(
        FLAGGED,
        """SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages
        FROM incident WHERE status = 'open' AND severity_score >= 40""",
    )
    sql["status_counts"] = _with(FLAGGED, "SELECT status, count(*) AS incidents FROM incident GROUP BY ALL")
    sql["incident_summary"] = _with(
        FLAGGED,
        """SELECT count(*) FILTER (severity_score >= 70 AND status <> 'resolved') AS high_severity_count,
               count(DISTINCT store_id) FILTER (status <> 'resolved') AS affected_stores,
               CAST(coalesce(sum(sku_count) FILTER (status <> 'resolved'), 0) AS BIGINT) AS affected_skus,
               round(coalesce(sum(estimated_impact) FILTER (status <> 'resolved'), 0), 2) AS total_estimated_impact,
               count(*) FILTER (status IN ('open', 'investigating')) AS active_incidents
        FROM incident""",
    )
    sql["incidents_over_time"] = _with(
        FLAGGED,
        """SELECT CAST(date AS VARCHAR) AS date, count(*) AS incidents FROM incident
        WHERE date >= DATE '2002-01-01' - 365 GROUP BY ALL""",
    )
    sql["severity_distribution"] = _with(
        FLAGGED,
        """SELECT bucket, count(severity_score) AS incidents
        FROM (VALUES ('Low', -1, 30), ('Medium', 30, 60), ('High', 60, 80), ('Critical', 80, 1000)) b(bucket, lo, hi)
        LEFT JOIN incident ON severity_score >= lo AND severity_score < hi GROUP BY ALL""",
    )
    sql["top_stores"] = _with(
        FLAGGED,
        """SELECT store_id, count(*) AS incident_count FROM incident WHERE status <> 'resolved'
        GROUP BY ALL ORDER BY incident_count DESC, store_id LIMIT 3""",
    )
    sql["incident_detail"] = _with(
        FLAGGED,
        f"""SELECT dedup_key AS incident_id, 'incident' AS section, '' AS position, headline AS content,
               CAST(NULL AS VARCHAR) AS author, round(severity_score, 4) AS amount FROM incident
        UNION ALL
        SELECT incident_id, 'item', sku_id, detection_result_ids, NULL, round(contribution_score, 4) FROM items
        UNION ALL
        SELECT dedup_key, 'note', lpad(CAST(1000000000000 - epoch(TIMESTAMP '2002-01-01')::BIGINT AS VARCHAR), 13, '0'),
               {CREATED}, 'system', NULL FROM run""",
    )
    sql["detection_details"] = _with(
        FLAGGED,
        """SELECT i.incident_id, d.store_id, d.sku_id, 'tukey' AS detector_type, d.metric_name, d.actual_value, d.q1, d.q3,
               d.iqr, d.lower_fence, d.upper_fence, d.outlier_distance, d.sample_size, d.fallback_used
        FROM items i JOIN tukey d USING (date, store_id, sku_id)""",
    )
    sql["apply_changes"] = _with(
        CHANGES,
        """SELECT incident_id, coalesce(arg_max(new_status, change_id) FILTER (new_status IS NOT NULL), any_value(start_status)) AS status,
               nullif(arg_max(new_assignee, change_id) FILTER (new_assignee IS NOT NULL), '') AS assignee,
               max(new_reason) AS resolution_reason,
               CASE WHEN max(change_id) FILTER (new_status <> old_status) IS NULL
                    THEN CASE WHEN any_value(start_status) = 'resolved' THEN CAST(-31 * 86400 AS DOUBLE) END
                    WHEN arg_max(new_status, change_id) FILTER (new_status <> old_status) = 'resolved'
                    THEN CAST(max(asked_at) FILTER (new_status <> old_status) AS DOUBLE) END AS resolved_after
        FROM step GROUP BY incident_id""",
    )
    sql["audit_notes"] = _with(
        CHANGES,
        """SELECT incident_id, CAST(change_id AS BIGINT) AS change_id, 'system' AS author,
               'Status changed from ' || old_status || ' to ' || new_status AS content, 'status_change' AS note_type
        FROM step WHERE new_status <> old_status
        UNION ALL
        SELECT incident_id, change_id, 'system', 'Assignment changed from ' || coalesce(old_assignee, 'unassigned') || ' to '
               || coalesce(nullif(new_assignee, ''), 'unassigned'), 'assignment'
        FROM step WHERE new_assignee IS NOT NULL AND new_assignee IS DISTINCT FROM old_assignee
        UNION ALL
        SELECT incident_id, change_id, 'system', 'Resolution reason updated', 'assignment' FROM step WHERE new_reason IS NOT NULL
        UNION ALL
        SELECT dedup_key, 0, 'user', 'Looked at ' || headline, 'comment' FROM incident WHERE status = 'open'""",
    )
    series = """, changes AS (
      SELECT *, CASE WHEN true THEN on_hand - lag(on_hand) OVER (PARTITION BY store_id, sku_id ORDER BY date) END AS change
      FROM raw_daily WHERE date BETWEEN DATE '1998-06-30' - {} AND DATE '1998-06-30' {}
    )"""
    sql["timeseries"] = _with(
        TUKEY + series.format(365, "AND store_id = 'ST-001'"),
        """SELECT c.store_id, c.sku_id, CAST(c.date AS VARCHAR) AS date, p.metric, CAST(p.value AS DOUBLE) AS value,
               EXISTS (SELECT 1 FROM tukey t WHERE t.is_outlier AND t.date = c.date AND t.store_id = c.store_id
                       AND t.sku_id = c.sku_id AND t.metric_name = p.mark) AS is_outlier
        FROM changes c, LATERAL (VALUES ('sold', sold, 'sold'), ('on_hand', on_hand, 'delta_on_hand'),
                                        ('delta_on_hand', change, 'delta_on_hand')) p(metric, value, mark)
        WHERE p.value IS NOT NULL""",
    )
    sql["boxplot"] = _with(
        RAW + series.format(90, ""),
        """SELECT store_id, sku_id, metric, min, q1, median, q3, max, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
               q3 + 1.5 * (q3 - q1) AS upper_fence,
               array_to_string(list_filter(v, lambda x: x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)), ',') AS flags
        FROM (
          SELECT store_id, sku_id, metric, count(*) AS n, CAST(min(value) AS DOUBLE) AS min, quantile_cont(value, 0.25) AS q1,
                 quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, CAST(max(value) AS DOUBLE) AS max,
                 list(value ORDER BY date) FILTER (value IS NOT NULL) AS v
          FROM (SELECT store_id, sku_id, date, 'sold' AS metric, sold AS value FROM changes
                UNION ALL SELECT store_id, sku_id, date, 'delta_on_hand', change FROM changes)
          GROUP BY ALL
        ) WHERE n >= 5""",
    )
    sql["list_stores"] = _with(RAW, "SELECT DISTINCT store_id FROM raw_daily")
    sql["list_skus"] = _with(RAW, "SELECT DISTINCT sku_id FROM raw_daily WHERE store_id = 'ST-003'")
    sql["detection_mode"] = _with(
        RAW,
        """SELECT *, CASE WHEN total = 0 THEN 'none' WHEN has_on_hand > total * 0.1 AND has_sold > total * 0.1 THEN 'full'
                 WHEN has_sold > total * 0.1 THEN 'sold_only' WHEN has_on_hand > total * 0.1 THEN 'on_hand_only' ELSE 'none' END AS mode,
               concat_ws(',', CASE WHEN has_sold > total * 0.1 THEN 'sold' END,
                         CASE WHEN has_on_hand > total * 0.1 THEN 'delta_on_hand' END) AS metrics
        FROM (SELECT count(*) AS total, count(on_hand) AS has_on_hand, count(*) FILTER (sold > 0) AS has_sold FROM raw_daily)""",
    )
    sql["date_spine"] = _with(
        RAW,
        """SELECT CAST(CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS date
        FROM raw_daily""",
    )
    sql["duplicate_keys"] = """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, CAST(l_suppkey AS VARCHAR) AS store_id,
               CAST(l_partkey % 100 AS VARCHAR) AS sku_id, count(*) AS rows
        FROM lineitem GROUP BY ALL HAVING count(*) > 1"""
    keys = "CAST(date AS VARCHAR) AS date, store_id, sku_id"
    stats = ", ".join(f"round({c}_{x} + 1e-8, 5) AS {c}_{x}" for c in _REASON_FEATURES for x in ("mean", "std"))
    sql["feature_baseline"] = _with(BASELINE, f"SELECT {keys}, baseline_rows, {stats} FROM baseline")
    sql["forest_features"] = _with(
        FEATURES,
        f"""SELECT {keys}, CAST(sold AS DOUBLE) AS sold, CAST(delivered AS DOUBLE) AS delivered, CAST(returned AS DOUBLE) AS returned,
               CAST(coalesce(delta_on_hand, 0) AS DOUBLE) AS delta_on_hand, price, CAST(promo_flag AS DOUBLE) AS promo_flag,
               CAST(day_of_week AS DOUBLE) AS day_of_week FROM features""",
    )
    sql["forest_training_counts"] = _with(
        SCOPES, "SELECT scope, CAST(date AS VARCHAR) AS date, training_rows FROM training"
    )
    sql["forest_scope"] = _with(
        SCOPES,
        f"""SELECT {keys}, CASE WHEN f.date >= s.cutoff THEN s.scope WHEN f.date >= (SELECT cutoff FROM cutoff WHERE scope = 'global')
               THEN 'global' ELSE 'none' END AS scope
        FROM features f LEFT JOIN cutoff s ON s.scope = 'store:' || f.store_id""",
    )
    zs = " UNION ALL ".join(
        f"""SELECT date, store_id, sku_id, {i} AS i, '{c}' AS feature, CAST(coalesce({c}, 0) AS DOUBLE) AS value, {c}_mean AS mean,
            CASE WHEN {c}_std > 0 THEN (coalesce({c}, 0) - {c}_mean) / {c}_std ELSE 0 END AS z FROM baseline WHERE baseline_rows > 0"""
        for i, c in enumerate(_REASON_FEATURES)
    )
    sql["forest_reasons"] = _with(
        BASELINE,
        f"""SELECT {keys}, rank - 1 AS rank, feature, round(value + 1e-8, 4) AS value, round(mean + 1e-8, 4) AS mean, round(z + 1e-8, 4) AS z
        FROM (SELECT *, row_number() OVER (PARTITION BY date, store_id, sku_id ORDER BY round(abs(z), 9) DESC, i) AS rank FROM ({zs}))
        WHERE rank <= 3 AND round(abs(z), 9) > 1.5""",
    )
    in_scope = """FROM features f LEFT JOIN cutoff s ON s.scope = 'store:' || f.store_id
        LEFT JOIN (SELECT cutoff AS everybody FROM cutoff WHERE scope = 'global') ON true"""
    label = """CASE WHEN f.date >= s.cutoff THEN 'store' WHEN f.date >= everybody THEN 'global' ELSE 'insufficient_data' END"""
    sql["forest_model"] = _with(
        SCOPES,
        """SELECT scope, CAST(tree AS BIGINT) AS tree, CAST(least(training_rows, 256) AS BIGINT) AS sample_size, true AS whole
        FROM cutoff c JOIN training t ON t.scope = c.scope AND t.date = c.cutoff, range(100) r(tree)""".replace("SELECT scope", "SELECT c.scope"),
    )
    sql["forest_results"] = _with(
        BASELINE + SCOPES.removeprefix(FEATURES),
        f"""SELECT CAST(f.date AS VARCHAR) AS date, f.store_id, f.sku_id, true AS score_fits, CAST(0.05 AS DOUBLE) AS threshold_used,
               {label} AS fallback_used, CASE WHEN {label} = 'insufficient_data' THEN '' ELSE coalesce(told, '') END AS reasons
        {in_scope} LEFT JOIN (
          SELECT date, store_id, sku_id, string_agg(feature, ',' ORDER BY rank) AS told
          FROM (SELECT *, row_number() OVER (PARTITION BY date, store_id, sku_id ORDER BY round(abs(z), 9) DESC, i) AS rank FROM ({zs}))
          WHERE rank <= 3 AND round(abs(z), 9) > 1.5 GROUP BY ALL) r ON r.date = f.date AND r.store_id = f.store_id AND r.sku_id = f.sku_id""",
    )
    sql["forest_shares"] = _with(SCOPES, f"SELECT {label} AS label, count(*) AS rows, true AS share_fits {in_scope} GROUP BY ALL")
    sql["flexible_forest"] = _with(
        EVENTS,
        """SELECT row_id, CAST(date AS VARCHAR) AS date, identifier_key, label, 'isolation_forest' AS detector_type,
               true AS score_fits, true AS share_fits FROM event WHERE value IS NOT NULL AND k IS NOT NULL""",
    )
    sql["flexible_tukey"] = _with(
        EVENTS,
        """SELECT row_id, CAST(date AS VARCHAR) AS date, identifier_key, label, metric_name, round(actual_value, 6) AS actual_value,
               round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence,
               round(upper_fence, 6) AS upper_fence, round(outlier_distance, 6) AS outlier_distance, is_outlier FROM flex""",
    )
    sql["flexible_zscores"] = _with(
        EVENTS,
        """SELECT row_id, metric_name, round(CASE WHEN std > 0 THEN abs((actual_value - mean) / std) / (1 + 1e-8) ELSE 0 END, 6) AS z
        FROM (SELECT * FROM metric WHERE row_id IN (SELECT row_id FROM event WHERE value IS NOT NULL AND k IS NOT NULL))
        JOIN (SELECT metric_name, avg(actual_value) AS mean, stddev_pop(actual_value) AS std FROM metric
              WHERE row_id IN (SELECT row_id FROM event WHERE value IS NOT NULL AND k IS NOT NULL) GROUP BY ALL) USING (metric_name)""",
    )
    sql["flexible_detections"] = _with(
        EVENTS,
        """SELECT CAST(date AS VARCHAR) AS date, 'tukey' AS detector_type, metric_name, count(*) AS results,
               count(*) FILTER (is_outlier) AS flags FROM flex GROUP BY ALL""",
    )
    sql["flexible_incidents"] = _with(
        EVENTS
        + """,
        flagged AS (
          SELECT *, row_number() OVER (PARTITION BY identifier_key ORDER BY metric_order, date, row_id) AS rank,
                 '• ' || metric_name || ' value ' || printf('%.2f', actual_value) || ' is '
                 || CASE WHEN actual_value < lower_fence THEN 'below' ELSE 'above' END || ' normal range ' AS line
          FROM flex WHERE is_outlier
        )""",
        """SELECT left(sha256('1_' || identifier_key || '_' || min(date)), 32) AS incident_id, CAST(min(date) AS VARCHAR) AS date,
               any_value(label) AS store_id, CAST(1 AS BIGINT) AS dataset_id, 'open' AS status,
               CAST(least(35 + 5 * count(*), 100) AS DOUBLE) AS severity_score,
               'Anomalies in ' || string_agg(DISTINCT metric_name, ', ' ORDER BY metric_name) || ' for ' || any_value(label) AS headline,
               CAST(1 AS BIGINT) AS sku_count, CAST(0 AS DOUBLE) AS estimated_impact, 'tukey' AS detectors_triggered,
               string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 5) AS description
        FROM flagged GROUP BY identifier_key""",
    )
    sql["flexible_incidents_both"] = _with(
        EVENTS
        + """,
        flag AS (
          SELECT row_id, date, identifier_key, label, metric_order, metric_name, true AS by_tukey,
                 '• ' || metric_name || ' value ' || printf('%.2f', actual_value) || ' is '
                 || CASE WHEN actual_value < lower_fence THEN 'below' ELSE 'above' END || ' normal range ' AS line
          FROM flex WHERE is_outlier
          UNION ALL
          SELECT row_id, date, identifier_key, label, NULL, NULL, false,
                 CASE WHEN row_id % 40 = 0 THEN '• k is 3.0 standard deviations from mean' END
          FROM event WHERE value IS NOT NULL AND k IS NOT NULL AND row_id % 40 < 2
        ),
        ordered_flag AS (
          SELECT *, row_number() OVER (PARTITION BY identifier_key ORDER BY by_tukey DESC, metric_order NULLS LAST, date NULLS LAST, row_id) AS rank
          FROM flag
        )""",
        """SELECT left(sha256('1_' || identifier_key || '_' || min(date)), 32) AS incident_id, CAST(min(date) AS VARCHAR) AS date,
               any_value(label) AS store_id,
               CAST(least(20 + 15 * count(DISTINCT by_tukey) + 5 * count(*), 100) AS DOUBLE) AS severity_score,
               CASE WHEN count(metric_name) > 0 THEN 'Anomalies in ' || string_agg(DISTINCT metric_name, ', ' ORDER BY metric_name)
                    ELSE 'Anomalies detected' END || ' for ' || any_value(label) AS headline,
               concat_ws(',', CASE WHEN bool_or(NOT by_tukey) THEN 'isolation_forest' END, CASE WHEN bool_or(by_tukey) THEN 'tukey' END)
                 AS detectors_triggered,
               coalesce(string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 5), 'Multiple anomalies detected') AS description
        FROM ordered_flag GROUP BY identifier_key""",
    )
    sql["csv_scan"] = _with(ORDERS, "SELECT row_index, order_date, priority, status, total FROM dirty")
    sql["rejected_changes"] = _with(
        FLAGGED,
        """SELECT dedup_key AS incident_id, CAST(i AS BIGINT) AS change_id, 'bogus' AS status
        FROM incident, (VALUES (1), (2), (3)) v(i) WHERE dedup_key[i + 1] = 'f'""",
    )
    sql["csv_profile"] = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, '{kind}' AS detected_type, count(*) AS total_count, "
        f"count(*) - count(v) AS null_count, count(DISTINCT v) AS unique_count FROM (SELECT {value} AS v FROM orders)"
        for name, kind, value in (
            ("customer", "integer", "o_custkey"),
            ("quantity", "integer", "CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey * 3 END"),
            ("urgent", "integer", "o_orderkey % 2"),
            ("total", "float", "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END"),
            ("remark", "text", "o_orderkey"),
        )
    )
    sql["preview_rows"] = _with(ORDERS, "SELECT * FROM dirty ORDER BY row_index LIMIT 20")
    sql["parse_dates"] = _with(
        ORDERS, "SELECT row_index, order_date, CAST(date AS VARCHAR) AS parsed FROM dirty JOIN parsed USING (row_index)"
    )
    sql["parse_numbers"] = _with(
        ORDERS, "SELECT row_index, d.total, p.total AS parsed FROM dirty d JOIN parsed p USING (row_index)"
    )
    sql["valid_rows"] = _with(
        ORDERS,
        """SELECT row_index, CAST(date AS VARCHAR) AS date, customer, priority, total, status
        FROM keyed WHERE NOT no_id AND NOT no_metric""",
    )
    sql["row_errors"] = _with(
        ORDERS,
        """SELECT row_index + 2 AS row, 'All identifier columns are empty' AS error FROM keyed WHERE no_id
        UNION ALL SELECT row_index + 2, 'All metric columns are empty' FROM keyed WHERE no_metric""",
    )
    sql["transform_summary"] = _with(
        ORDERS,
        """SELECT count(*) AS total_rows, count(*) FILTER (NOT no_id AND NOT no_metric) AS valid_rows,
               count(*) FILTER (no_id OR no_metric) AS error_rows FROM keyed""",
    )
    sql["identifier_key"] = _with(ORDERS, "SELECT row_index, identifier_key FROM keyed")
    sql["packed_rows"] = _with(
        ORDERS,
        """SELECT CAST(2 AS BIGINT) AS dataset_id, row_index AS row_id, CAST(date AS VARCHAR) AS date,
               '{' || concat_ws(',', '"customer":"' || customer || '"', '"priority":"' || priority || '"') || '}' AS identifiers,
               '{"total":' || CAST(total AS VARCHAR) || '}' AS metrics, '{"status":"' || status || '"}' AS attributes, identifier_key
        FROM keyed WHERE NOT no_id AND NOT no_metric""",
    )
    sql["dataset_page"] = _with(
        ORDERS,
        """SELECT row_index AS row_id, CAST(date AS VARCHAR) AS date, identifier_key FROM keyed
        WHERE NOT no_id AND NOT no_metric AND date <= DATE '1998-01-01' ORDER BY keyed.date DESC, row_index LIMIT 50 OFFSET 25""",
    )
    sql["dataset_page_next"] = _with(
        ORDERS,
        """SELECT row_index AS row_id, CAST(date AS VARCHAR) AS date, identifier_key FROM keyed
        WHERE NOT no_id AND NOT no_metric AND date <= DATE '1998-01-01' ORDER BY keyed.date DESC, row_index LIMIT 50 OFFSET 75""",
    )
    sql["unique_identifiers"] = _with(
        EVENTS,
        """SELECT identifier_key, '{"event_type":"' || event_type || '","user_id":"' || user_id || '"}' AS identifiers,
               count(*) AS rows FROM event GROUP BY ALL""",
    )
    sets = """, stat AS (
      SELECT 1 AS id, count(*) AS n, min(date) AS a, max(date) AS b FROM event
      UNION ALL SELECT 2, count(*), min(date), max(date) FROM keyed WHERE NOT no_id AND NOT no_metric
    )"""
    sql["dataset_list"] = _with(
        EVENTS + "," + ORDERS + sets,
        """SELECT CAST(id AS BIGINT) AS dataset_id, CASE id WHEN 1 THEN 'events' ELSE 'renamed' END AS name,
               CASE id WHEN 1 THEN 'day' ELSE 'order_date' END AS date_column,
               CASE id WHEN 1 THEN 'event_type,user_id' ELSE 'customer,priority' END AS identifier_columns,
               CASE id WHEN 1 THEN 'value,k' ELSE '' END AS metric_columns, n AS row_count FROM stat""",
    )
    sql["dataset_stats"] = _with(
        EVENTS + "," + ORDERS + sets,
        """SELECT CAST(id AS BIGINT) AS dataset_id, n AS row_count, CAST(a AS VARCHAR) AS date_range_start,
               CAST(b AS VARCHAR) AS date_range_end FROM stat""",
    )
    sql["data_stats"] = _with(
        EVENTS + "," + ORDERS + sets + "," + RAW,
        """SELECT 'datasets' AS part, CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS DOUBLE) AS datasets, CAST(NULL AS DOUBLE) AS stores,
               CAST(NULL AS DOUBLE) AS skus, CAST(min(a) AS VARCHAR) AS date_from, CAST(max(b) AS VARCHAR) AS date_to FROM stat
        UNION ALL
        SELECT 'daily', count(*), NULL, count(DISTINCT store_id), count(DISTINCT sku_id), CAST(min(date) AS VARCHAR),
               CAST(max(date) AS VARCHAR) FROM raw_daily""",
    )
    dirty = ORDERS + "," + _cells("dirty", DIRTY_COLUMNS, "row_index") + COUNTED
    sql["profile_columns"] = _with(
        dirty,
        """SELECT CAST(ordinal AS BIGINT) AS ordinal, column_name, total AS total_count, nulls AS null_count, uniques AS unique_count,
               round(uniques / total, 9) AS cardinality_ratio, sample_values
        FROM counted JOIN (
          SELECT ordinal, string_agg(value, '|' ORDER BY first, value) AS sample_values
          FROM (SELECT ordinal, value, min(pos) AS first, row_number() OVER (PARTITION BY ordinal ORDER BY min(pos), value) AS rank
                FROM cell WHERE value IS NOT NULL GROUP BY ordinal, value)
          WHERE rank <= 5 GROUP BY ordinal) USING (ordinal)""",
    )
    sql["profile_numeric"] = " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS ordinal, round(CAST(min({c}) AS DOUBLE), 4) AS min_value, round(CAST(max({c}) AS DOUBLE), 4) AS max_value,
            round(avg({c}), 4) AS mean_value, round(coalesce(stddev_samp({c}), 0), 4) AS std_value FROM lineitem"""
        for i, c in enumerate(["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    )
    sql["detect_types"] = _with(
        dirty
        + f""",
        evidence AS (
          SELECT ordinal, count(*) AS rows, count(day) AS named, count(day) FILTER (year(day) BETWEEN 1900 AND 2100) AS unnamed,
                 count(DISTINCT lower(trim(value))) AS words,
                 bool_and(lower(trim(value)) IN ({BOOLEANS})) AS bools,
                 bool_and(bare IN ({BLANKS}) OR coalesce(TRY_CAST(bare AS DOUBLE) = floor(TRY_CAST(bare AS DOUBLE)), false)) AS ints,
                 bool_and(money IN ({BLANKS}) OR TRY_CAST(money AS DOUBLE) IS NOT NULL) AS nums,
                 count(TRY_CAST(money AS DOUBLE)) AS nnum
          FROM (
            SELECT *, coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%d/%m/%Y')) AS day,
                   regexp_replace(value, '[, ]', '', 'g') AS bare, regexp_replace(value, '[, £$€]', '', 'g') AS money
            FROM cell WHERE value IS NOT NULL
          ) GROUP BY ordinal
        )""",
        f"""SELECT column_name, CASE WHEN CASE WHEN {DATE_HINT} THEN named ELSE unnamed END * 2 >= rows THEN 'date'
               WHEN words <= 2 AND bools THEN 'boolean' WHEN ints THEN 'integer' WHEN nums AND nnum >= rows * 0.8 THEN 'float'
               WHEN uniques / (total - nulls) < 0.5 THEN 'categorical' ELSE 'text' END AS detected_type
        FROM counted JOIN evidence USING (ordinal)""",
    )
    part_and_events = [
        _with(_cells(table, columns, order) + COUNTED + ROLES, "SELECT column_name, detected_type, r FROM role")
        for table, columns, order in (("part", PART_COLUMNS, "p_partkey"), ("events", EVENT_COLUMNS, "event_id"))
    ]
    sql["suggest_roles"] = f"""SELECT column_name, detected_type, r[1] AS suggested_role, CAST(r[2] AS DOUBLE) AS role_confidence
        FROM (SELECT * FROM ({part_and_events[0]}) UNION ALL SELECT * FROM ({part_and_events[1]}))"""
    sql["suggest_schema"] = _with(
        _cells("events", EVENT_COLUMNS, "event_id") + COUNTED + ROLES,
        """SELECT arg_min(column_name, ordinal) FILTER (r[1] = 'date') AS date_column,
               coalesce(string_agg(column_name, ',' ORDER BY r[2] DESC, ordinal) FILTER (r[1] = 'identifier'), '') AS identifiers,
               coalesce(string_agg(column_name, ',' ORDER BY r[2] DESC, ordinal) FILTER (r[1] = 'metric'), '') AS metrics,
               '' AS warnings FROM role""",
    )
    return sql
