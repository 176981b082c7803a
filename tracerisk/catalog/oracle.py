"""DuckDB SQL with the results that the queries of the catalog must give."""

from tracerisk.catalog.queries import (
    _HISTOGRAMS,
    EVENTS_SLOT,
    EVENTS_WAITING,
    FULL_RULE,
    LINES_SLOT,
    LINES_WAITING,
    SCORE_RULES,
    SKETCH_PROBS,
    STUMP_FEATURES,
)
from tracerisk.operators.experiments import GAINS, METRICS
from tracerisk.schema import (
    ALL_FEATURES,
    COLUMNS,
    DATA_COLUMNS,
    EVENT_TYPES,
    NOVEL_FEATURES,
    RAW_FEATURES,
    RESOURCES,
    TASK_KEY,
    TRACE_SCHEMA,
)


def q(name: str) -> str:
    return f'"{name}"'


def cols(names) -> str:
    return ", ".join(q(n) for n in names)


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {q(name)}"


KEY = cols(TASK_KEY)
DATA = cols(DATA_COLUMNS)
ORDER = 'ORDER BY "timestamp", ingest_seq'
LABEL_CASE = (
    "CASE event_type " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EVENT_TYPES.items()) + " END"
)

RAW_E = """
ev AS (
  SELECT event_id, epoch_us(ts) AS t, user_id, event_type AS kind, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
once AS (
  SELECT t AS "timestamp", CAST(NULL AS INTEGER) AS missing_info, user_id AS job_id,
         CAST(event_id % 4 AS INTEGER) AS task_index,
         CASE WHEN kind <> 'signup' THEN 1000 + (event_id * 7) % 20 END AS machine_id,
         CAST(CASE kind WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 3
              WHEN 'purchase' THEN 4
              ELSE CASE k % 4 WHEN 0 THEN 8 WHEN 1 THEN 2 ELSE 5 END END AS INTEGER) AS event_type,
         'u' || (user_id % 50) AS "user",
         CAST(k % 4 AS INTEGER) AS scheduling_class, CAST(k % 12 AS INTEGER) AS priority,
         CASE WHEN k % 5 <> 0 THEN value / 500 END AS cpu_requested,
         CASE WHEN k % 7 <> 0 THEN value / 1000 END AS memory_requested,
         CASE WHEN k % 6 <> 0 THEN k / 10000 END AS disk_requested,
         CAST(CASE WHEN k % 9 <> 0 THEN k % 2 END AS INTEGER) AS different_machine,
         event_id AS ingest_seq
  FROM ev
),
raw AS (
  SELECT * FROM once
  UNION ALL
  SELECT * REPLACE (ingest_seq + 1099511627776 AS ingest_seq) FROM once WHERE ingest_seq % 50 = 0
)"""

RAW_L = """
li AS (
  SELECT l_orderkey AS job_id, l_linenumber AS task_index, l_partkey AS part, l_suppkey AS supp,
         l_quantity AS qty, l_discount AS disc, l_tax AS tax, 'c' || o_custkey AS "user",
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
         epoch_us(o_orderdate) + (l_partkey % 1440) * 60000000 AS s,
         CAST(l_quantity AS BIGINT) * 1000000 AS waited,
         CAST(floor(l_extendedprice) AS BIGINT) * 100000 AS ran,
         CASE WHEN l_returnflag = 'R'
              THEN CASE l_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 5 END
              ELSE 4 END AS final
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
steps AS (
  SELECT *, s AS "timestamp", CAST(NULL AS BIGINT) AS machine_id, 0 AS event_type,
         disc * 10 AS cpu_requested FROM li
  UNION ALL
  SELECT *, s + waited, supp, 1, CASE WHEN part % 5 <> 0 THEN disc * 10 END FROM li
  UNION ALL
  SELECT *, s + waited + ran, supp, final, NULL FROM li
),
raw AS (
  SELECT "timestamp", CAST(NULL AS INTEGER) AS missing_info, job_id, task_index, machine_id,
         CAST(event_type AS INTEGER) AS event_type, "user",
         CAST(priority % 4 AS INTEGER) AS scheduling_class, priority, cpu_requested,
         tax AS memory_requested, qty / 100000 AS disk_requested,
         CAST(task_index % 2 AS INTEGER) AS different_machine,
         CAST(event_type AS BIGINT) * 100000000000000000
           + (((supp % 1000000) * 1000000 + part % 1000000) * 100 + CAST(qty AS BIGINT)) * 1000
           + CAST(round(disc * 100) AS BIGINT) * 10 + CAST(round(tax * 100) AS BIGINT) AS ingest_seq
  FROM steps
)"""

_FILLS = ",\n         ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {c}" for c in RESOURCES
)
CLEAN = f"""
dd AS (SELECT {DATA}, min(ingest_seq) AS ingest_seq FROM raw GROUP BY {DATA}),
clean AS (
  SELECT "timestamp", job_id, task_index, coalesce(machine_id, -1) AS machine_id, event_type,
         "user", scheduling_class, priority,
         {_FILLS},
         {LABEL_CASE} AS event_label, ingest_seq, row_number() OVER w AS event_no
  FROM dd WHERE job_id IS NOT NULL AND task_index IS NOT NULL
  WINDOW w AS (PARTITION BY job_id, task_index {ORDER}
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

_LASTS = ", ".join(
    f"last({q(c)} {ORDER}) FILTER (WHERE {q(c)} IS NOT NULL) AS {q(c)}"
    for c in [*DATA_COLUMNS, "event_label"]
    if c not in TASK_KEY
)
LABELS = f"""
final AS (SELECT {KEY}, {_LASTS} FROM clean GROUP BY {KEY}),
labelled AS (
  SELECT *, CAST(event_type IN (2, 3, 5) AS INTEGER) AS label
  FROM final WHERE event_type IN (2, 3, 4, 5)
)"""

TIMES = f"""
subs AS (SELECT {KEY}, min("timestamp") AS t0 FROM clean WHERE event_type = 0 GROUP BY {KEY}),
scheds AS (SELECT {KEY}, min("timestamp") AS t1 FROM clean WHERE event_type = 1 GROUP BY {KEY}),
delay AS (
  SELECT {KEY}, (t1 - t0) / 1e6 AS scheduling_delay_sec
  FROM subs JOIN scheds USING ({KEY}) WHERE t1 >= t0
),
duration AS (
  SELECT {KEY}, ("timestamp" - t1) / 1e6 AS execution_duration_sec
  FROM scheds JOIN labelled USING ({KEY}) WHERE "timestamp" >= t1
)"""

RATES = """
rates AS (
  SELECT machine_id,
         count(*) FILTER (WHERE event_type IN (2, 3, 5)) / count(event_type) AS machine_failure_rate
  FROM clean WHERE machine_id <> -1 GROUP BY machine_id
)"""


def slots(width: int) -> str:
    return f"""
onm AS (
  SELECT *, "timestamp" // {width * 1_000_000} AS time_window
  FROM clean WHERE event_type = 1 AND machine_id <> -1
),
per_slot AS (
  SELECT machine_id, time_window, count(*) AS concurrency_density
  FROM onm GROUP BY machine_id, time_window
),
concurrency AS (
  SELECT {KEY}, first(concurrency_density {ORDER}) AS concurrency_density
  FROM onm JOIN per_slot USING (machine_id, time_window) GROUP BY {KEY}
),
asks AS (SELECT * FROM onm WHERE cpu_requested > 0),
means AS (SELECT machine_id, avg(cpu_requested) AS mean_cpu FROM asks GROUP BY machine_id),
overcommit AS (
  SELECT {KEY}, first(cpu_requested / mean_cpu {ORDER}) AS resource_overcommit_ratio
  FROM asks JOIN means USING (machine_id) GROUP BY {KEY}
)"""


def waiting(width: int) -> str:
    return f"""
maxp AS (
  SELECT "timestamp" // {width * 1_000_000} AS time_window, max(priority) AS max_waiting_priority
  FROM clean WHERE event_type = 0 GROUP BY 1
),
sp AS (
  SELECT clean.*, max_waiting_priority
  FROM clean LEFT JOIN maxp ON "timestamp" // {width * 1_000_000} = time_window
  WHERE event_type = 1
),
gap AS (
  SELECT {KEY}, first(max_waiting_priority - priority {ORDER})
           FILTER (WHERE max_waiting_priority - priority IS NOT NULL) AS priority_inversion_flag
  FROM sp GROUP BY {KEY}
),
flag AS (
  SELECT {KEY}, first(coalesce(CAST(priority < max_waiting_priority AS INTEGER), 0) {ORDER})
           AS priority_inversion_flag
  FROM sp GROUP BY {KEY}
)"""


MATRIX = f"""
matrix AS (
  SELECT {KEY}, machine_id, {cols(RAW_FEATURES)}, label,
         coalesce(scheduling_delay_sec, 0) AS scheduling_delay_sec,
         coalesce(execution_duration_sec, 0) AS execution_duration_sec,
         coalesce(machine_failure_rate, 0) AS machine_failure_rate,
         coalesce(concurrency_density, 0) AS concurrency_density,
         coalesce(resource_overcommit_ratio, 0) AS resource_overcommit_ratio,
         CAST(coalesce(priority_inversion_flag, 0) AS DOUBLE) AS priority_inversion_flag
  FROM labelled LEFT JOIN delay USING ({KEY}) LEFT JOIN duration USING ({KEY})
       LEFT JOIN rates USING (machine_id) LEFT JOIN concurrency USING ({KEY})
       LEFT JOIN overcommit USING ({KEY}) LEFT JOIN gap USING ({KEY})
)"""

BEFORE = f"""
history AS (
  SELECT *, count(event_type) OVER w AS total, count(*) FILTER (WHERE event_type IN (2, 3, 5)) OVER w AS failures
  FROM clean WHERE machine_id <> -1
  WINDOW w AS (PARTITION BY machine_id ORDER BY "timestamp" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
_BEFORE_OUT = f"""
SELECT {KEY}, {r6(f"first(failures / nullif(total, 0) {ORDER})", "machine_failure_rate_before")}
FROM history WHERE event_type = 1 GROUP BY {KEY}"""

# Every split between two neighbouring values of a feature, and the fall in the variance of labels -1 and 1 that it brings.
STUMP = """
cells AS (
  """ + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM labelled GROUP BY {c}"
    for c in STUMP_FEATURES
) + """
),
sums AS (
  SELECT *, sum(n) OVER l AS nl, sum(pos) OVER l AS pl, sum(n) OVER f AS na, sum(pos) OVER f AS pa,
         lead(v) OVER (PARTITION BY feature ORDER BY v) AS next_v
  FROM cells
  WINDOW f AS (PARTITION BY feature), l AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)
),
tried AS (
  SELECT feature, (v + next_v) / 2 AS threshold, CAST(na AS BIGINT) AS "rows", CAST(na AS DOUBLE) AS weight,
         4 * (pa / na) * (1 - pa / na) AS impurity,
         4 * (pa / na) * (1 - pa / na) - nl / na * 4 * (pl / nl) * (1 - pl / nl)
           - (na - nl) / na * 4 * ((pa - pl) / (na - nl)) * (1 - (pa - pl) / (na - nl)) AS gain
  FROM sums WHERE next_v IS NOT NULL
)"""
_STUMP_OUT = (
    f"SELECT feature, {r6('threshold', 'threshold')}, \"rows\", {r6('weight', 'weight')}, "
    f"{r6('impurity', 'impurity')}, {r6('gain', 'gain')} FROM tried ORDER BY tried.gain DESC LIMIT 1"
)

_DIGEST = "md5(concat_ws('|', job_id, task_index, '42'))"
SPLIT = f"""
split AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_DIGEST}, {KEY})
                      <= round(0.2 * count(*) OVER (PARTITION BY label))
                 THEN 'test' ELSE 'train' END AS split
  FROM matrix
)"""
FOLDS = f"""
folds AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {_DIGEST}, {KEY}) - 1) % 5
                 AS INTEGER) AS fold
  FROM scored
)"""
SCORED = f"""
scored AS (
  SELECT {KEY}, label, priority, x / (x + 5000.0) AS probability,
         CAST(x / (x + 5000.0) >= 0.5 AS INTEGER) AS prediction
  FROM (SELECT *, execution_duration_sec + 100 * concurrency_density AS x FROM matrix)
)"""
COUNTS = """
counts AS (
  SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
  FROM scored
)"""
CURVE = """
by_score AS (
  SELECT probability, count(*) FILTER (WHERE label = 1) AS pos,
         count(*) FILTER (WHERE label = 0) AS neg
  FROM scored GROUP BY probability
),
curve AS (
  SELECT probability, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM by_score
  WINDOW w AS (ORDER BY probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
auc AS (SELECT sum(neg * (tp - pos + pos / 2)) / max(p * n) AS roc_auc FROM curve)"""


RULES = f"""
folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {_DIGEST}, {KEY}) - 1) % 5
                 AS INTEGER) AS fold
  FROM matrix
),
ruled AS (
  {" UNION ALL ".join(
    f"""SELECT '{family}' AS family, '{group}' AS feature_group, '{family} ({group})' AS model, label, fold,
         {c} / ({c} + {half}) AS probability, CAST({c} / ({c} + {half}) >= 0.5 AS INTEGER) AS prediction
  FROM folded""" for (family, group), (c, half) in SCORE_RULES.items())}
)"""


def measured(by: str, source: str = "ruled") -> str:
    """Metrics per group, and the curve they come from."""
    return f"""
points AS (
  SELECT {by}, probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM {source} GROUP BY {by}, probability
),
curves AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS p, sum(neg) OVER g AS n
  FROM points
  WINDOW g AS (PARTITION BY {by}),
         w AS (PARTITION BY {by} ORDER BY probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
areas AS (SELECT {by}, sum(neg * (tp - pos + pos / 2)) / max(p * n) AS roc_auc FROM curves GROUP BY {by}),
cells AS (
  SELECT {by}, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
  FROM {source} GROUP BY {by}
),
measured AS (
  SELECT {by}, (tn + tp) / (tn + fp + fn + tp) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
         coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1, roc_auc
  FROM cells JOIN areas USING ({by})
)"""


_MEASURES = ", ".join(r6(q(c), c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))


def gains() -> str:
    def row(start, end):
        named = [f"a.{m} AS {o}_from, b.{m} AS {o}_to" for m, o in (("f1", "f1"), ("roc_auc", "auc"))]
        return f"""SELECT a.model AS from_model, b.model AS to_model, {", ".join(named)}
FROM measured a, measured b WHERE a.family = '{start[0]}' AND a.feature_group = '{start[1]}'
AND b.family = '{end[0]}' AND b.feature_group = '{end[1]}'"""

    columns = ", ".join(
        f"{r6(f'{m}_from', f'{m}_from')}, {r6(f'{m}_to', f'{m}_to')}, {r6(f'{m}_to - {m}_from', f'{m}_gain')}, "
        + r6(f"({m}_to - {m}_from) * 100 / {m}_from", f"{m}_gain_percent")
        for m in ("f1", "auc")
    )
    return f"SELECT from_model, to_model, {columns} FROM ({' UNION ALL '.join(row(*g) for g in GAINS)})"


_START = "SELECT DISTINCT model, CAST('infinity' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM ruled"
_POINT = f"model, {r6('probability', 'threshold')}, {r6('fp / n', 'fpr')}, {r6('tp / p', 'tpr')}"


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


E = (RAW_E, CLEAN)
L = (RAW_L, CLEAN)
E_ALL = (*E, LABELS, TIMES, RATES, slots(EVENTS_SLOT), waiting(EVENTS_WAITING), MATRIX)
L_ALL = (*L, LABELS, TIMES, RATES, slots(LINES_SLOT), waiting(LINES_WAITING), MATRIX)
L_SCORED = (*L_ALL, SCORED, COUNTS, CURVE)
L_RULED = (*L_ALL, RULES)

_MATRIX_OUT = (
    f"SELECT {KEY}, machine_id, scheduling_class, priority, "
    + ", ".join(r6(q(c), c) for c in RESOURCES[:3])
    + ", different_machine, label, concurrency_density, "
    + ", ".join(r6(q(c), c) for c in NOVEL_FEATURES if c != "concurrency_density")
    + " FROM matrix"
)
_LABELLED_OUT = f"SELECT {DATA}, event_label, label FROM labelled"
_DISTRIBUTION = """
SELECT label, count(*) AS n_tasks, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent,
       round(sum(count(*)) FILTER (WHERE label = 0) OVER ()
             / sum(count(*)) FILTER (WHERE label = 1) OVER (), 6) AS imbalance_ratio
FROM labelled GROUP BY label"""


def missing(source: str, names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({q(c)}) AS missing_count, "
        f"{r6(f'(count(*) - count({q(c)})) * 100.0 / count(*)', 'missing_pct')} FROM {source}"
        for c in names
    )


def describe(source: str, names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({q(c)}) AS n, {r6(f'avg({q(c)})', 'mean')}, "
        f"{r6(f'stddev_samp({q(c)})', 'std')}, {r6(f'CAST(min({q(c)}) AS DOUBLE)', 'min')}, "
        + ", ".join(
            r6(f"quantile_cont(CAST({q(c)} AS DOUBLE), {p})", n)
            for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
        )
        + f", {r6(f'CAST(max({q(c)}) AS DOUBLE)', 'max')} FROM {source}"
        for c in names
    )


def by_label(source: str, col: str) -> str:
    return (
        f"SELECT label, count({col}) AS n, {r6(f'avg({col})', 'mean')}, "
        f"{r6(f'quantile_cont(CAST({col} AS DOUBLE), 0.5)', 'median')}, "
        f"{r6(f'stddev_samp({col})', 'std')} FROM {source} GROUP BY label"
    )


def labelled_feature(table: str, col: str) -> str:
    return by_label(f"(SELECT * FROM {table} JOIN labelled USING ({KEY}))", col)


def histogram(col: str, upper: float | None, bins: int = 50, source: str = "matrix") -> tuple[str, str]:
    value = f"round(CAST({q(col)} AS DOUBLE), 6)"
    value = value if upper is None else f"least({value}, {float(upper)})"
    return f"""
SELECT CAST(bin AS INTEGER) AS bin, {r6(f"lo + bin * ((hi - lo) / {bins})", "bin_start")},
       {r6(f"lo + (bin + 1) * ((hi - lo) / {bins})", "bin_end")}, coalesce(n, 0) AS n_rows
FROM (SELECT unnest(range({bins})) AS bin, * FROM span)
LEFT JOIN (SELECT least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS bin, count(*) AS n
           FROM vals, span GROUP BY 1) USING (bin)""", f"""
vals AS (SELECT CAST({value} AS DOUBLE) AS v FROM {source} WHERE {q(col)} IS NOT NULL),
span AS (
  SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM vals
)"""


def boxplot(names) -> str:
    parts = []
    for c in names:
        parts.append(f"""
SELECT label, '{c}' AS feature, {r6("min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))", "whisker_low")},
       {r6("max(q1)", "q1")}, {r6("max(med)", "median")}, {r6("max(q3)", "q3")},
       {r6("max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))", "whisker_high")}
FROM (SELECT label, CAST({q(c)} AS DOUBLE) AS v FROM matrix)
JOIN (SELECT label, quantile_cont(CAST({q(c)} AS DOUBLE), 0.25) AS q1,
             quantile_cont(CAST({q(c)} AS DOUBLE), 0.5) AS med,
             quantile_cont(CAST({q(c)} AS DOUBLE), 0.75) AS q3 FROM matrix GROUP BY label)
USING (label) GROUP BY label""")
    return " UNION ALL ".join(parts)


def corr(a: str, b: str) -> str:
    c = f"corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE))"
    return r6(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END", "correlation")


def label_corr() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {corr(c, 'label')} FROM matrix" for c in ALL_FEATURES
    )


def corr_matrix() -> str:
    names = [*ALL_FEATURES, "label"]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, {corr(min(a, b), max(a, b))} FROM matrix"
        for a in names
        for b in names
    )


def shape() -> str:
    return " UNION ALL ".join(
        f"SELECT count(*) AS n_rows, {i} AS position, '{f.name}' AS \"column\", "
        f"'{f.dataType.simpleString()}' AS type FROM raw"
        for i, f in enumerate(TRACE_SCHEMA.fields)
    )


def scale() -> str:
    scaled = ", ".join(
        r6(f"coalesce(({q(c)} - m_{c}) / nullif(s_{c}, 0), 0)", c) for c in ALL_FEATURES
    )
    fits = ", ".join(
        f"avg({q(c)}) AS m_{c}, stddev_pop({q(c)}) AS s_{c}" for c in ALL_FEATURES
    )
    return f"""SELECT {KEY}, split, {scaled}
FROM split, (SELECT {fits} FROM split WHERE split = 'train')"""


REPORT = f"""
SELECT class, {r6("p", "precision")}, {r6("r", "recall")}, {r6("f", "f1")}, support FROM (
  SELECT '0' AS class, p0 AS p, r0 AS r, f0 AS f, n0 AS support FROM sides
  UNION ALL SELECT '1', p1, r1, f1, n1 FROM sides
  UNION ALL SELECT 'accuracy', NULL, NULL, (tn + tp) / (n0 + n1), n0 + n1 FROM sides
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM sides
  UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
                   (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM sides
)"""
SIDES = """
sides AS (
  SELECT *, tn + fp AS n0, tp + fn AS n1,
         coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
         coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f0,
         coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
         coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1
  FROM counts
)"""

# Four degrees of freedom: A = sin(theta) * (1 + cos(theta)^2 / 2).
TTEST = f"""
SELECT n, {r6("gap", "mean_gap")}, {r6("t", "t_statistic")}, {r6("p", "p_value")}, p < 0.05 AS significant
FROM (SELECT *, 1 - sin(atan(abs(t) / 2)) * (1 + cos(atan(abs(t) / 2)) ** 2 / 2) AS p
      FROM (SELECT count(*) AS n, avg(best - baseline) AS gap,
                   avg(best - baseline) / (stddev_samp(best - baseline) / sqrt(count(*))) AS t
            FROM (SELECT fold,
                         2.0 * count(*) FILTER (WHERE label = 1 AND prediction = 1)
                         / (2 * count(*) FILTER (WHERE label = 1 AND prediction = 1)
                            + count(*) FILTER (WHERE label <> prediction)) AS best,
                         2.0 * count(*) FILTER (WHERE label = 1 AND priority >= 3)
                         / (2 * count(*) FILTER (WHERE label = 1 AND priority >= 3)
                            + count(*) FILTER (WHERE (label = 1) <> (priority >= 3))) AS baseline
                  FROM folds GROUP BY fold)))"""

FLAGS = f"flags AS (SELECT * FROM flag JOIN labelled USING ({KEY}))"
E_FLAGS = (*E, LABELS, waiting(EVENTS_WAITING), FLAGS)


def oracle_sql() -> dict[str, str]:
    rate_out = f"SELECT machine_id, {r6('machine_failure_rate', 'machine_failure_rate')} FROM rates"
    over_out = (
        f"SELECT {KEY}, {r6('resource_overcommit_ratio', 'resource_overcommit_ratio')} "
        "FROM overcommit"
    )
    clean_out = f"SELECT {DATA}, event_label, event_no FROM clean"
    named = f"(SELECT *, {LABEL_CASE} AS event_label FROM raw)"
    out = {
        "trace_parts": with_(RAW_E, select=f"SELECT {cols(COLUMNS)} FROM raw"),
        "clean_trace": with_(*L, select=clean_out),
        "clean_trace_events": with_(*E, select=clean_out),
        "clean_trace_ranges": with_(*E, select=clean_out),
        "table_roundtrip_parquet": with_(*E, select=clean_out),
        "table_roundtrip_csv": with_(*E, select=clean_out),
        "rows_per_part": with_(
            RAW_E,
            select="""SELECT 'part-0000' || (ingest_seq % 3) AS part, count(*) AS n_rows
FROM raw GROUP BY ingest_seq % 3""",
        ),
        "trace_first_parts": with_(
            RAW_E, select=f"SELECT {cols(COLUMNS)} FROM raw WHERE ingest_seq % 3 < 2"
        ),
        "trace_rejected": with_(
            RAW_E, select='SELECT "timestamp", job_id FROM raw WHERE ingest_seq % 7 = 0'
        ),
        "dedupe_events": with_(*E, select=f"SELECT {DATA}, ingest_seq FROM dd"),
        "ffill_resources": with_(
            *E, select=f'SELECT {KEY}, "timestamp", event_no, {cols(RESOURCES)} FROM clean'
        ),
        "event_labels": with_(
            RAW_E, select=f"SELECT ingest_seq, event_type, event_label FROM {named}"
        ),
        "cleaning_summary": with_(
            *E,
            select="""SELECT (SELECT count(*) FROM raw) AS rows_in,
(SELECT count(*) FROM raw) - (SELECT count(*) FROM dd) AS duplicates_removed,
(SELECT count(*) FROM dd) - (SELECT count(*) FROM clean) AS missing_key_removed,
(SELECT count(*) FROM clean) AS rows_out""",
        ),
        "cleaning_counts": with_(
            *E,
            select="""SELECT (SELECT count(*) FROM raw) AS rows_in,
(SELECT count(*) FROM raw WHERE job_id IS NULL OR task_index IS NULL) AS missing_key_removed,
(SELECT count(*) FROM raw WHERE job_id IS NOT NULL AND task_index IS NOT NULL)
  - (SELECT count(*) FROM clean) AS duplicates_removed, (SELECT count(*) FROM clean) AS rows_out""",
        ),
        "incremental_parts": with_(RAW_E, select=f"SELECT {cols(COLUMNS)} FROM raw"),
        "part_ledger": with_(
            RAW_E,
            select="""SELECT 'part-0000' || (ingest_seq % 3) AS part, ingest_seq % 3 AS no, count(*) AS n_rows,
(ingest_seq % 3) // 2 AS load FROM raw GROUP BY ingest_seq % 3""",
        ),
        "machine_rate_before": with_(*L, BEFORE, select=_BEFORE_OUT),
        "machine_rate_before_events": with_(*E, BEFORE, select=_BEFORE_OUT),
        "machine_rate_before_ranges": with_(*E, BEFORE, select=_BEFORE_OUT),
        "task_times_by_bucket": with_(
            *L,
            LABELS,
            TIMES,
            select=f"""SELECT {KEY}, label, {r6("scheduling_delay_sec", "scheduling_delay_sec")},
{r6("execution_duration_sec", "execution_duration_sec")}
FROM labelled LEFT JOIN delay USING ({KEY}) LEFT JOIN duration USING ({KEY})""",
        ),
        "stream_slots": with_(
            *L, slots(LINES_SLOT), select="SELECT machine_id, time_window, concurrency_density FROM per_slot"
        ),
        "stream_waiting": with_(
            *L,
            select=f"""SELECT "timestamp" // {LINES_WAITING * 1_000_000} AS time_window,
max(priority) FILTER (WHERE event_type = 0) AS max_waiting_priority,
count(*) FILTER (WHERE event_type = 1) AS schedules
FROM clean WHERE event_type IN (0, 1) GROUP BY 1""",
        ),
        "sketched_quantiles": with_(
            *L_ALL,
            select=" UNION ALL ".join(
                f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, count({q(c)}) AS n, true AS within FROM matrix"
                for c in ALL_FEATURES
                for p in SKETCH_PROBS
            ),
        ),
        "sketched_task_counts": with_(
            *L,
            select=f"""SELECT count(*) AS n_tasks, true AS within, true AS as_of_whole
FROM (SELECT DISTINCT {KEY} FROM clean)""",
        ),
        "lr_gradient": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, 0.0::DOUBLE AS gradient" for c in [*ALL_FEATURES, "(intercept)"]
        ),
        "stump_gain": with_(*L, LABELS, STUMP, select=_STUMP_OUT),
        "task_labels": with_(*L, LABELS, select=_LABELLED_OUT),
        "task_labels_events": with_(*E, LABELS, select=_LABELLED_OUT),
        "label_distribution": with_(*L, LABELS, select=_DISTRIBUTION),
        "label_distribution_events": with_(*E, LABELS, select=_DISTRIBUTION),
        "negative_times": with_(
            *E,
            LABELS,
            TIMES,
            select=f"""SELECT
count(*) FILTER (WHERE t0 IS NOT NULL AND t1 IS NOT NULL) AS delays,
count(*) FILTER (WHERE t1 < t0) AS negative_delays,
count(*) FILTER (WHERE t1 IS NOT NULL AND "timestamp" IS NOT NULL) AS durations,
count(*) FILTER (WHERE "timestamp" < t1) AS negative_durations
FROM subs FULL JOIN scheds USING ({KEY}) LEFT JOIN labelled USING ({KEY})""",
        ),
        "feature_matrix": with_(*L_ALL, select=_MATRIX_OUT),
        "feature_matrix_events": with_(*E_ALL, select=_MATRIX_OUT),
        "feature_matrix_joined": with_(*E_ALL, select=_MATRIX_OUT),
        "delay_by_label": with_(
            *L_ALL, select=labelled_feature("delay", "scheduling_delay_sec")
        ),
        "duration_by_label": with_(
            *L_ALL, select=labelled_feature("duration", "execution_duration_sec")
        ),
        "concurrency_by_label": with_(
            *L_ALL, select=labelled_feature("concurrency", "concurrency_density")
        ),
        "overcommit_by_label": with_(
            *L_ALL, select=labelled_feature("overcommit", "resource_overcommit_ratio")
        ),
        "priority_gap_by_label": with_(
            *L_ALL, select=labelled_feature("gap", "priority_inversion_flag")
        ),
        "machine_rate_by_label": with_(
            *L_ALL,
            select=by_label(
                "(SELECT * FROM labelled LEFT JOIN rates USING (machine_id))",
                "machine_failure_rate",
            ),
        ),
        "raw_feature_means": with_(
            *E,
            LABELS,
            select="SELECT label, "
            + ", ".join(r6(f"avg({q(c)})", c) for c in RAW_FEATURES)
            + " FROM labelled GROUP BY label",
        ),
        "inversion_crosstab": with_(
            *E_FLAGS,
            select="""SELECT label, priority_inversion_flag, count(*) AS n_rows,
CAST(grouping(label, priority_inversion_flag) AS INTEGER) AS total_level
FROM flags GROUP BY CUBE (label, priority_inversion_flag)""",
        ),
        "inversion_pivot": with_(
            *E_FLAGS,
            select="""SELECT label, count(*) FILTER (WHERE priority_inversion_flag = 0) AS not_flagged,
count(*) FILTER (WHERE priority_inversion_flag = 1) AS flagged FROM flags GROUP BY label""",
        ),
        "inversion_rate": with_(
            *E_FLAGS,
            select=f"""SELECT label, count(*) AS n_tasks,
CAST(sum(priority_inversion_flag) AS BIGINT) AS flagged,
{r6("avg(priority_inversion_flag)", "rate")} FROM flags GROUP BY label""",
        ),
        "inversion_distribution": with_(
            *E_FLAGS,
            select=f"""SELECT priority_inversion_flag, count(*) AS n_tasks,
{r6("count(*) / sum(count(*)) OVER ()", "share")} FROM flag GROUP BY priority_inversion_flag""",
        ),
        "machine_rate_bands": with_(
            *E,
            RATES,
            select="""SELECT count(*) AS machines,
count(*) FILTER (WHERE machine_failure_rate = 0) AS no_failures,
count(*) FILTER (WHERE machine_failure_rate > 0.1) AS above_10_percent,
count(*) FILTER (WHERE machine_failure_rate > 0.5) AS above_50_percent FROM rates""",
        ),
        "missing_summary": with_(RAW_E, select=missing("raw", COLUMNS)),
        "clean_missing_summary": with_(
            *E, select=missing("clean", [*DATA_COLUMNS, "event_label"])
        ),
        "cpu_nulls_by_event": with_(
            RAW_E,
            select=f"""SELECT event_label, count(*) - count(cpu_requested) AS n_missing,
count(*) AS n_rows FROM {named} GROUP BY event_label""",
        ),
        **{
            name: with_(
                RAW_E,
                select=f"SELECT event_label, count(*) AS n_rows FROM {named} GROUP BY event_label",
            )
            for name in ("event_distribution", "result_roundtrip")
        },
        "final_event_distribution": with_(
            *E,
            LABELS,
            select="SELECT event_label, count(*) AS n_rows FROM final GROUP BY event_label",
        ),
        "scheduling_class_distribution": with_(
            RAW_E,
            select="SELECT scheduling_class, count(*) AS n_rows FROM raw GROUP BY scheduling_class",
        ),
        "priority_distribution": with_(
            RAW_E, select="SELECT priority, count(*) AS n_rows FROM raw GROUP BY priority"
        ),
        "describe_features": with_(*E_ALL, select=describe("matrix", ALL_FEATURES)),
        "describe_features_volume": with_(*L_ALL, select=describe("matrix", ALL_FEATURES)),
        "describe_machine_rate": with_(
            *L_ALL, select=describe("rates", ["machine_failure_rate"])
        ),
        "describe_slots": with_(*L_ALL, select=describe("per_slot", ["concurrency_density"])),
        "describe_waiting_priority": with_(
            *E_ALL, select=describe("maxp", ["max_waiting_priority"])
        ),
        "boxplot_duration": with_(*L_ALL, select=boxplot(["execution_duration_sec"])),
        "boxplot_features": with_(*E_ALL, select=boxplot(NOVEL_FEATURES)),
        "feature_label_corr": with_(*E_ALL, select=label_corr()),
        "feature_label_corr_volume": with_(*L_ALL, select=label_corr()),
        "corr_matrix": with_(*E_ALL, select=corr_matrix()),
        "corr_matrix_volume": with_(*L_ALL, select=corr_matrix()),
        "stage_summary": with_(
            *E,
            LABELS,
            select=f"""SELECT (SELECT count(*) FROM clean) AS n_events,
(SELECT count(*) FROM final) AS n_tasks, count(*) AS n_terminal,
count(*) FILTER (WHERE label = 0) AS n_normal, count(*) FILTER (WHERE label = 1) AS n_failed,
{r6("count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1)", "ratio")}
FROM labelled""",
        ),
        "trace_shape": with_(RAW_E, select=shape()),
        "trace_head": with_(
            RAW_E, select=f"SELECT ingest_seq, {cols(COLUMNS)} FROM raw ORDER BY ingest_seq LIMIT 5"
        ),
        **{
            f"{model}_prediction_frame": with_(
                *L_ALL,
                SPLIT,
                select=f"""SELECT {KEY}, label, true AS consistent, true AS in_range
FROM split WHERE split = 'test'""",
            )
            for model in ("lr", "rf", "gbt")
        },
        "model_roundtrip": with_(
            *L_ALL,
            SPLIT,
            select="""SELECT count(*) AS n_rows, 0::BIGINT AS n_changed
FROM split WHERE split = 'test'""",
        ),
        "stratified_split": with_(*L_ALL, SPLIT, select=f"SELECT {KEY}, label, split FROM split"),
        "split_distribution": with_(
            *L_ALL,
            SPLIT,
            select="SELECT split, label, count(*) AS n_tasks FROM split GROUP BY split, label",
        ),
        "stratified_folds": with_(
            *L_ALL, SCORED, FOLDS, select=f"SELECT {KEY}, label, fold FROM folds"
        ),
        "class_weights": with_(
            *L,
            LABELS,
            select=f"""SELECT label, {r6("sum(count(*)) OVER () / (2 * count(*))", "balanced_weight")},
{r6('''CASE label WHEN 1 THEN sum(count(*)) FILTER (WHERE label = 0) OVER ()
/ sum(count(*)) FILTER (WHERE label = 1) OVER () ELSE 1.0 END''', "positive_weight")}
FROM labelled GROUP BY label""",
        ),
        "standard_scale": with_(*L_ALL, SPLIT, select=scale()),
        "confusion_matrix": with_(
            *L_SCORED,
            select="""SELECT 0 AS label, 0 AS prediction, tn AS n_tasks FROM counts
UNION ALL SELECT 0, 1, fp FROM counts UNION ALL SELECT 1, 0, fn FROM counts
UNION ALL SELECT 1, 1, tp FROM counts""",
        ),
        "classification_metrics": with_(
            *L_SCORED,
            SIDES,
            select=f"""SELECT 'fixed score' AS model, {r6("(tn + tp) / (n0 + n1)", "accuracy")},
{r6("p1", "precision")}, {r6("r1", "recall")}, {r6("f1", "f1")},
{r6("(SELECT roc_auc FROM auc)", "roc_auc")} FROM sides""",
        ),
        "classification_report": with_(*L_SCORED, SIDES, select=REPORT),
        "roc_points": with_(
            *L_SCORED,
            select=f"""SELECT CAST('infinity' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr,
0.0::DOUBLE AS tpr UNION ALL
SELECT {r6("probability", "threshold")}, {r6("fp / n", "fpr")}, {r6("tp / p", "tpr")} FROM curve""",
        ),
        "roc_auc": with_(*L_SCORED, select=f"SELECT {r6('roc_auc', 'roc_auc')} FROM auc"),
        "operational_impact": with_(
            *L_SCORED,
            select=f"""SELECT tn + fp + fn + tp AS n_tasks, tp + fn AS failures, tp AS caught,
fn AS missed, fp AS false_alarms, {r6("tp / (tp + fn) * 100", "caught_percent")},
{r6("fn / (tp + fn) * 100", "missed_percent")}, {r6("fp / (fp + tn) * 100", "false_alarm_percent")}
FROM counts""",
        ),
        "paired_ttest": with_(*L_SCORED, FOLDS, select=TTEST),
        "roc_auc_by_group": with_(
            *L_RULED, measured("model, fold"), select=f"SELECT model, fold, {r6('roc_auc', 'roc_auc')} FROM areas"
        ),
        "metrics_by_group": with_(
            *L_RULED, measured("model, fold"), select=f"SELECT model, fold, {_MEASURES} FROM measured"
        ),
        "rule_comparison": with_(
            *L_RULED,
            measured("family, feature_group, model"),
            select=f"SELECT family, feature_group, model, {_MEASURES} FROM measured",
        ),
        "rule_improvement": with_(*L_RULED, measured("family, feature_group, model"), select=gains()),
        "rule_ablation": with_(
            *L_RULED,
            measured("family, feature_group, model"),
            select=f"""SELECT m.model AS removed_feature, {r6("m.f1", "f1")}, {r6("f.f1 - m.f1", "f1_drop")},
{r6("m.roc_auc", "auc")}, {r6("f.roc_auc - m.roc_auc", "auc_drop")}, f.f1 - m.f1 > 0.01 AS high_impact
FROM measured m, measured f WHERE f.model = '{FULL_RULE[0]} ({FULL_RULE[1]})' AND m.model <> f.model""",
        ),
        "rule_cross_validation": with_(
            *L_RULED,
            f"lone AS (SELECT * FROM ruled WHERE model = '{FULL_RULE[0]} ({FULL_RULE[1]})')",
            measured("fold", "lone"),
            select=" UNION ALL ".join(
                f"SELECT '{m}' AS metric, {r6(f'avg({q(m)})', 'mean')}, {r6(f'stddev_pop({q(m)})', 'std')} FROM measured"
                for m in METRICS
            ),
        ),
        "rule_roc_plot": with_(
            *L_RULED, measured("model"), select=f"{_START} UNION ALL SELECT {_POINT} FROM curves"
        ),
        "rule_confusion_plot": with_(
            *L_RULED,
            measured("model"),
            select="""SELECT model, 0 AS label, 0 AS prediction, tn AS n_tasks FROM cells
UNION ALL SELECT model, 0, 1, fp FROM cells UNION ALL SELECT model, 1, 0, fn FROM cells
UNION ALL SELECT model, 1, 1, tp FROM cells""",
        ),
        "roc_corners": with_(
            *L_RULED,
            measured("model"),
            select=f"""{_START} UNION ALL SELECT {_POINT} FROM (
  SELECT *, row_number() OVER v AS i, lead(pos) OVER v AS next_pos, lead(neg) OVER v AS next_neg FROM curves
  WINDOW v AS (PARTITION BY model ORDER BY probability DESC)
) WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
        ),
    }
    for suffix, parts in (("", L_ALL), ("_events", E_ALL)):
        out |= {
            f"scheduling_delay{suffix}": with_(*parts, select="SELECT * FROM delay"),
            f"execution_duration{suffix}": with_(*parts, select="SELECT * FROM duration"),
            f"machine_failure_rate{suffix}": with_(*parts, select=rate_out),
            f"concurrency_density{suffix}": with_(*parts, select="SELECT * FROM concurrency"),
            f"resource_overcommit{suffix}": with_(*parts, select=over_out),
            f"priority_gap{suffix}": with_(*parts, select="SELECT * FROM gap"),
            f"priority_inversion_flag{suffix}": with_(*parts, select="SELECT * FROM flag"),
        }
    for name, (col, upper) in _HISTOGRAMS.items():
        select, parts = histogram(col, upper)
        out[name] = with_(*L_ALL, parts, select=select)
    for name, col, bins in (("priority", "priority", 12), ("cpu", "cpu_requested", 30)):
        select, parts = histogram(col, None, bins, "raw")
        out[f"histogram_{name}"] = with_(RAW_E, parts, select=select)
    return out
