"""The queries of :mod:`transferwatch.queries` as SQL for another engine, for comparison only."""

from __future__ import annotations

TX = """
tx AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   strftime(l_shipdate, '%Y%m%d')) AS txn_id,
         TIMESTAMP '2022-09-01 00:00:00' + to_minutes(CAST(
           (l_partkey * 7919 + l_orderkey * 104729 + CAST(l_linenumber AS BIGINT) * 15485863)
           % 25920 AS BIGINT)) AS ts,
         c_nationkey AS from_bank, 'C' || o_custkey AS account,
         s_nationkey AS to_bank, 'S' || l_suppkey AS account_1,
         l_extendedprice AS amount_received, l_returnflag AS receiving_currency,
         l_extendedprice * (1 + l_tax) AS amount_paid, o_orderstatus AS payment_currency,
         o_orderpriority AS payment_format,
         CAST(l_quantity >= 40 AND l_tax >= 0.07 AND l_returnflag = 'R' AS INTEGER)
           AS is_laundering
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
),
t AS (
  SELECT *, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
         CAST(minute(ts) AS INTEGER) AS minute, CAST(floor(epoch(ts)) AS BIGINT) AS sec
  FROM tx
)"""

DL = """
dl AS (
  SELECT d.doc_id, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

PL = "pl AS (SELECT doc_id, 1 - quality AS prediction, toxic AS label FROM labels)"


def split_cte(source: str, fraction: float, target: str, unique: str, name: str) -> str:
    """Rows ranked by hash within their class; the lowest are the drawn part."""
    return f"""
{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {target}
              ORDER BY md5(concat({unique}, ':42')), {unique})
            <= floor({fraction} * count(*) OVER (PARTITION BY {target}) + 0.5) AS INTEGER)
            AS in_part
  FROM {source}
)"""


SPLIT = split_cte("t", 0.25, "is_laundering", "txn_id", "parted") + """,
train AS (SELECT * EXCLUDE (in_part) FROM parted WHERE in_part = 0),
prod AS (SELECT * EXCLUDE (in_part) FROM parted WHERE in_part = 1)"""

ORDER = "ORDER BY sec, ts, txn_id"
SIDES = {"sender": "account", "receiver": "account_1"}
AMOUNTS = ("amount_received", "amount_paid")
PERIODS = ("day", "hour", "minute")
INTERACTIONS = {
    "bank_pair_freq_enc": "from_bank, to_bank",
    "account_pair_freq_enc": "account, account_1",
    "payment_format_hour_freq_enc": "payment_format, hour",
    "sender_payment_format_freq_enc": "account, payment_format",
    "day_hour_freq_enc": "day, hour",
    "bank_payment_hour_freq_enc": "from_bank, payment_format, hour",
}
COUNTERPARTIES = {
    "sender": ("unique_receivers_per_sender", "account_1"),
    "receiver": ("unique_senders_per_receiver", "account"),
}


def total(side: str) -> str:
    return f"count(*) OVER (PARTITION BY {SIDES[side]}) AS {side}_total_txn"


def mean_label(key: str, name: str) -> str:
    return f"avg(CAST(is_laundering AS DOUBLE)) OVER (PARTITION BY {key}) AS {name}"


def unique_others(side: str) -> str:
    name, other = COUNTERPARTIES[side]
    return f"count(DISTINCT {other}) OVER (PARTITION BY {SIDES[side]}) AS {name}"


def recency(side: str) -> str:
    window = f"(PARTITION BY {SIDES[side]} {ORDER})"
    gap = f"(epoch_us(ts) - lag(epoch_us(ts)) OVER {window}) / 1e6"
    return f"coalesce({gap}, -1.0) AS time_since_last_txn_{side}"


def last_rows(side: str, rows: int) -> str:
    return f"(PARTITION BY {SIDES[side]} {ORDER} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def rolling_std(side: str, amount: str) -> str:
    std = f"coalesce(stddev_samp({amount}) OVER {last_rows(side, 5)}, 0)"
    return f"round({std}, 2) AS rolling_std_{amount}_{side}"


def rolling_mean(side: str, amount: str) -> str:
    mean = f"avg({amount}) OVER {last_rows(side, 5)}"
    return f"round({mean}, 7) AS rolling_avg_{amount}_{side}"


def mean_ratio(side: str, amount: str) -> str:
    mean = f"avg({amount}) OVER {last_rows(side, 5)}"
    return f"round({amount} / ({mean} + 1e-6), 4) AS {amount}_to_avg_{side}_ratio"


def rolling_unique() -> str:
    return (
        f"count(DISTINCT account_1) OVER {last_rows('sender', 20)}"
        " AS rolling_unique_receivers_sender"
    )


def velocity(side: str) -> str:
    return (
        f"count(*) OVER (PARTITION BY {SIDES[side]} ORDER BY sec"
        f" RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS txn_velocity_{side}"
    )


def frequency(keys: str, name: str) -> str:
    share = f"CAST(count(*) OVER (PARTITION BY {keys}) AS DOUBLE) / count(*) OVER ()"
    return f"{share} AS {name}"


def amount_columns() -> list[str]:
    return [
        "round(ln(1 + amount_received), 6) AS log_amount_received",
        "round(ln(1 + amount_paid), 6) AS log_amount_paid",
        "abs(amount_received - amount_paid) AS amount_diff",
        "amount_received / (amount_paid + 1) AS amount_ratio",
    ]


def outlier(source: str, column: str) -> str:
    low, high = (f"(SELECT quantile_cont({column}, {q}) FROM {source})" for q in (0.25, 0.75))
    return (
        f"CAST(coalesce({column} < {low} - 1.5 * ({high} - {low})"
        f" OR {column} > {high} + 1.5 * ({high} - {low}), false) AS BIGINT) AS outlier_{column}"
    )


def threshold(source: str, period: str) -> str:
    return (
        f"(SELECT avg(r) FROM (SELECT avg(CAST(is_laundering AS DOUBLE)) AS r"
        f" FROM {source} GROUP BY {period}))"
    )


def high_flag(source: str, period: str) -> str:
    own = f"avg(CAST(is_laundering AS DOUBLE)) OVER (PARTITION BY {period})"
    return f"CAST({own} > {threshold(source, period)} AS BIGINT) AS high_fraud_{period}"


# Categories of the driver's data, in order; the first of each is left out.
ONE_HOT = {
    "receiving_currency": ["A", "N", "R"],
    "payment_currency": ["F", "O", "P"],
    "payment_format": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}


def one_hot_columns() -> list[str]:
    return [
        f"CAST(coalesce({c} = '{v}', false) AS BIGINT) AS \"{c}_{v}\""
        for c, values in ONE_HOT.items()
        for v in values[1:]
    ]


def window_columns() -> list[str]:
    """What only depends on the rows at hand, however they came about."""
    columns = [rolling_unique()]
    for side in SIDES:
        columns += [recency(side), velocity(side)]
        for amount in AMOUNTS:
            columns += [
                rolling_std(side, amount),
                rolling_mean(side, amount),
                mean_ratio(side, amount),
            ]
    return columns


def batch_count_columns() -> list[str]:
    columns = [f(s) for s in SIDES for f in (total, unique_others)]
    columns += [frequency(keys, name) for name, keys in INTERACTIONS.items()]
    for key in ("from_bank", "to_bank", "account", "account_1"):
        columns.append(frequency(key, f"{key}_freq_enc"))
    return columns


def select(columns: list[str], source: str = "t", ctes: str = TX, key: str = "txn_id") -> str:
    listed = ",\n  ".join([key, *columns])
    return f"WITH {ctes}\nSELECT {listed}\nFROM {source}"


def training_features() -> str:
    columns = [*amount_columns(), *[outlier("t", a) for a in AMOUNTS], *window_columns()]
    columns += batch_count_columns()
    for side, key in SIDES.items():
        columns += [
            mean_label(key, f"{side}_fraud_rate"),
            mean_label(key, f"{key}_target_enc"),
        ]
    columns += [mean_label(b, f"{b}_target_enc") for b in ("from_bank", "to_bank")]
    columns += [mean_label(p, f"fraud_rate_by_{p}") for p in PERIODS]
    columns += [high_flag("t", p) for p in PERIODS]
    return select(columns + one_hot_columns())


# Mean label per key of the training part, by lookup name.
RATES = {
    **{f"fraud_rate_by_{p}": p for p in PERIODS},
    "sender_fraud_rate": "account",
    "receiver_fraud_rate": "account_1",
    "from_bank_target_enc": "from_bank",
    "to_bank_target_enc": "to_bank",
    "account_target_enc": "account",
    "account_1_target_enc": "account_1",
}


def rate_tables() -> str:
    tables = [
        f"{name}_table AS (SELECT {key} AS k, avg(CAST(is_laundering AS DOUBLE)) AS r"
        f" FROM train GROUP BY {key})"
        for name, key in RATES.items()
    ]
    return ",\n".join(tables)


def rate_joins() -> str:
    return "\n".join(
        f"LEFT JOIN {name}_table ON {name}_table.k = p.{key}" for name, key in RATES.items()
    )


def learned_columns() -> list[str]:
    columns = [f"coalesce({name}_table.r, 0) AS {name}" for name in RATES]
    for period in PERIODS:
        own = f"coalesce(fraud_rate_by_{period}_table.r, 0)"
        columns.append(
            f"CAST({own} > {threshold('train', period)} AS BIGINT) AS high_fraud_{period}"
        )
    return columns


def lookup_apply() -> str:
    listed = ",\n  ".join(["p.txn_id", *learned_columns()])
    return f"WITH {TX},{SPLIT},\n{rate_tables()}\nSELECT {listed}\nFROM prod p\n{rate_joins()}"


def production_outliers() -> list[str]:
    return [outlier("train", a) for a in AMOUNTS]


def production_features(frozen: bool) -> str:
    columns = [*amount_columns(), *production_outliers(), *window_columns(), *one_hot_columns()]
    columns += ["day", "hour", "minute", "account", "account_1", "from_bank", "to_bank"]
    if not frozen:
        columns += batch_count_columns()
        counted = [c.rsplit(" AS ", 1)[1] for c in batch_count_columns()]
        outer = [f"p.{c}" for c in counted]
        tables, joins = "", ""
    else:
        columns.append("payment_format")
        outer, tables, joins = frozen_counts()
    own = [c.rsplit(" AS ", 1)[1] for c in columns if " AS " in c]
    done = {o.removeprefix("p.") for o in outer if o.startswith("p.")}
    outer += [f"p.{c}" for c in own if c not in done]
    listed = ",\n  ".join(["p.txn_id", *outer, *learned_columns()])
    return (
        f"WITH {TX},{SPLIT},\n{rate_tables()}{tables},\n"
        f"p AS ({select(columns, 'prod', ctes='one AS (SELECT 1)')})\n"
        f"SELECT {listed}\nFROM p\n{rate_joins()}\n{joins}"
    )


def frozen_counts() -> tuple[list[str], str, str]:
    """Totals and frequencies of the training part, joined to production rows."""
    outer, tables, joins = [], [], []
    grouped = dict(INTERACTIONS)
    grouped |= {f"{k}_freq_enc": k for k in ("from_bank", "to_bank", "account", "account_1")}
    for name, keys in grouped.items():
        tables.append(
            f"{name}_table AS (SELECT {keys}, CAST(count(*) AS DOUBLE)"
            f" / (SELECT count(*) FROM train) AS v FROM train GROUP BY {keys})"
        )
        match = " AND ".join(f"{name}_table.{k} = p.{k}" for k in keys.split(", "))
        joins.append(f"LEFT JOIN {name}_table ON {match}")
        outer.append(f"coalesce({name}_table.v, 0) AS {name}")
    for side, key in SIDES.items():
        unique, other = COUNTERPARTIES[side]
        tables.append(
            f"{side}_counts AS (SELECT {key}, count(*) AS n, count(DISTINCT {other}) AS u"
            f" FROM train GROUP BY {key})"
        )
        joins.append(f"LEFT JOIN {side}_counts ON {side}_counts.{key} = p.{key}")
        outer.append(f"CAST(coalesce({side}_counts.n, 0) AS BIGINT) AS {side}_total_txn")
        outer.append(f"CAST(coalesce({side}_counts.u, 0) AS BIGINT) AS {unique}")
    return outer, ",\n" + ",\n".join(tables), "\n".join(joins)


def text_key(keys: str) -> str:
    return " || '_' || ".join(f"CAST({k} AS VARCHAR)" for k in keys.split(", "))


def lookup_export() -> str:
    parts = []
    for name, key in RATES.items():
        parts.append(
            f"SELECT '{name}' AS lookup, CAST({key} AS VARCHAR) AS key,"
            f" avg(CAST(is_laundering AS DOUBLE)) AS value FROM train GROUP BY {key}"
        )
    grouped = dict(INTERACTIONS)
    grouped |= {f"{k}_freq_enc": k for k in ("from_bank", "to_bank", "account", "account_1")}
    for name, keys in grouped.items():
        parts.append(
            f"SELECT '{name}', {text_key(keys)},"
            f" CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM train)"
            f" FROM train GROUP BY {keys}"
        )
    for side, key in SIDES.items():
        unique, other = COUNTERPARTIES[side]
        parts.append(f"SELECT '{side}_total_txn', {key}, CAST(count(*) AS DOUBLE)"
                     f" FROM train GROUP BY {key}")
        parts.append(f"SELECT '{unique}', {key}, CAST(count(DISTINCT {other}) AS DOUBLE)"
                     f" FROM train GROUP BY {key}")
    for period in PERIODS:
        parts.append(f"SELECT '{period}_thresh', '0', {threshold('train', period)}")
    union = "\nUNION ALL\n".join(parts)
    return (
        f"WITH {TX},{SPLIT},\nall_lookups AS (\n{union}\n)\n"
        "SELECT lookup, key, round(value, 8) AS value FROM all_lookups"
    )


def _per_side(make, *amounts: str) -> str:
    if amounts:
        return select([make(s, a) for s in SIDES for a in amounts])
    return select([make(s) for s in SIDES])


QUALITY = """
m AS (
  SELECT count(*) FILTER (prediction = 1 AND label = 1) AS tp,
         count(*) FILTER (prediction = 1 AND label = 0) AS fp,
         count(*) FILTER (prediction = 0 AND label = 0) AS tn,
         count(*) FILTER (prediction = 0 AND label = 1) AS fn
  FROM pl
),
r AS (
  SELECT *, coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall
  FROM m
),
q AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)
"""

REPORT = f"""
WITH {PL},
c AS (SELECT prediction AS class FROM pl UNION SELECT label FROM pl),
s AS (
  SELECT class, (SELECT count(*) FROM pl WHERE prediction = class AND label = class) AS hit,
         (SELECT count(*) FROM pl WHERE prediction = class) AS guess,
         (SELECT count(*) FROM pl WHERE label = class) AS support
  FROM c
),
p AS (
  SELECT class, support, coalesce(CAST(hit AS DOUBLE) / nullif(guess, 0), 0) AS precision,
         coalesce(CAST(hit AS DOUBLE) / nullif(support, 0), 0) AS recall
  FROM s
),
f AS (
  SELECT CAST(class AS VARCHAR) AS class, precision, recall, support,
         coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1
  FROM p
),
u AS (
  SELECT class, precision, recall, f1, support FROM f
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support),
         sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
  FROM f
)
SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1,
       CAST(support AS BIGINT) AS support
FROM u
"""

# A window is reported once the watermark, ten minutes behind the latest row, has passed its end.
CLOSED = """
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR
      <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
"""
WINDOW_START = "CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start"
REQUESTS = """CAST(count(*) AS BIGINT) AS total_requests,
  CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS error_count,
  CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) * 100 AS error_rate_percent,
  round(avg(value), 8) AS avg_duration, arg_max(value, ts) AS last_duration"""


def fraud_rate_by(period: str) -> str:
    return (
        f"WITH {TX}\nSELECT {period}, avg(CAST(is_laundering AS DOUBLE))"
        f" AS fraud_rate_by_{period}\nFROM t GROUP BY {period}"
    )


ORACLES: dict[str, str] = {
    "high_risk_hours": f"""
WITH {TX},
g AS (SELECT hour, avg(CAST(is_laundering AS DOUBLE)) AS r FROM t GROUP BY hour)
SELECT hour, r AS fraud_rate_by_hour,
       round((SELECT avg(r) FROM g), 8) AS hour_thresh,
       CAST(r > (SELECT avg(r) FROM g) AS BIGINT) AS high_fraud_hour
FROM g""",
    "missing_target_count": f"""
WITH {DL}
SELECT count(*) AS n_rows, count(*) FILTER (quality IS NULL) AS n_missing FROM dl""",
    "clean_drop_null_target": f"WITH {DL} SELECT * FROM dl WHERE quality IS NOT NULL",
    "class_distribution": f"""
WITH {DL}
SELECT quality, count(*) AS n,
       CAST(count(*) AS DOUBLE) / (SELECT count(quality) FROM dl) AS share
FROM dl WHERE quality IS NOT NULL GROUP BY quality""",
    "stratified_split": f"""
WITH {TX},{split_cte('t', 0.25, 'is_laundering', 'txn_id', 'parted')}
SELECT txn_id, is_laundering, in_part FROM parted""",
    "train_test_split": f"""
WITH {DL},
known AS (SELECT * FROM dl WHERE quality IS NOT NULL),
{split_cte('known', 0.2, 'quality', 'doc_id', 'parted')}
SELECT doc_id, quality, in_part FROM parted""",
    "parse_time_parts": select(
        ["sec AS epoch"] + [f"CAST({p} AS BIGINT) AS {p}" for p in PERIODS]
    ),
    "amount_features": select(amount_columns()),
    "amount_outliers": select([outlier("t", a) for a in AMOUNTS]),
    "iqr_outliers": (
        f"SELECT event_id, round(value, 8) AS value, {outlier('events', 'value')} FROM events"
    ),
    "sender_totals": select([total("sender"), mean_label("account", "sender_fraud_rate")]),
    "receiver_totals": select([total("receiver"), mean_label("account_1", "receiver_fraud_rate")]),
    "batch_account_counts": _per_side(total),
    "unique_counterparties": _per_side(unique_others),
    "recency_sender": select([recency("sender")]),
    "recency_receiver": select([recency("receiver")]),
    "interval_pairs": f"""
WITH {TX}
SELECT a.txn_id, b.txn_id AS matched
FROM t a JOIN t b ON a.account_1 = b.account_1 AND b.sec BETWEEN a.sec - 3600 AND a.sec""",
    "distinct_sketches": f"""
WITH {TX}
SELECT account, count(DISTINCT account_1) AS n_exact, count(*) AS transfers, TRUE AS within_bound
FROM t GROUP BY account""",
    "quartile_sketches": """
SELECT a.name AS column, q.share, TRUE AS within_error
FROM (VALUES ('amount_received'), ('amount_paid')) AS a(name),
     (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) AS q(share)""",
    "time_order": select(["row_number() OVER (ORDER BY ts, txn_id) AS place"]),
    **{f"fraud_rate_by_{p}": fraud_rate_by(p) for p in PERIODS},
    "high_risk_periods": select(
        [mean_label(p, f"fraud_rate_by_{p}") for p in PERIODS]
        + [high_flag("t", p) for p in PERIODS]
    ),
    "freq_bank_pair": select([frequency("from_bank, to_bank", "bank_pair_freq_enc")]),
    "freq_account_pair": select([frequency("account, account_1", "account_pair_freq_enc")]),
    "lookup_in_place": select([frequency("account, account_1", "account_pair_freq_enc")]),
    "freq_format_hour": select([frequency("payment_format, hour", "payment_format_hour_freq_enc")]),
    "freq_sender_format": select(
        [frequency("account, payment_format", "sender_payment_format_freq_enc")]
    ),
    "freq_day_hour": select([frequency("day, hour", "day_hour_freq_enc")]),
    "freq_bank_format_hour": select(
        [frequency("from_bank, payment_format, hour", "bank_payment_hour_freq_enc")]
    ),
    "freq_bank": select([frequency(b, f"{b}_freq_enc") for b in ("from_bank", "to_bank")]),
    "freq_account": select([frequency(a, f"{a}_freq_enc") for a in ("account", "account_1")]),
    "target_bank": select([mean_label(b, f"{b}_target_enc") for b in ("from_bank", "to_bank")]),
    "target_account": select([mean_label(a, f"{a}_target_enc") for a in ("account", "account_1")]),
    "rolling_std": _per_side(rolling_std, *AMOUNTS),
    "rolling_mean": _per_side(rolling_mean, *AMOUNTS),
    "amount_to_mean": _per_side(mean_ratio, *AMOUNTS),
    "rolling_unique_receivers": select([rolling_unique()]),
    "velocity_sender": select([velocity("sender")]),
    "velocity_receiver": select([velocity("receiver")]),
    "one_hot": select(one_hot_columns()),
    "typed_records": """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN NULL
            ELSE CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS k,
       CASE WHEN event_type = 'error' THEN 'k' ELSE '' END AS fault
FROM events""",
    "numeric_coerce": """
SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE), 0) AS k,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS kind
FROM events""",
    "feature_align": select(
        [
            'CAST(0 AS DOUBLE) AS "payment_format_9-UNSEEN"',
            "CAST(hour AS DOUBLE) AS hour",
            "amount_received / (amount_paid + 1) AS amount_ratio",
        ]
    ),
    "lookup_export": lookup_export(),
    "lookup_apply": lookup_apply(),
    "training_features": training_features(),
    "production_features": production_features(frozen=False),
    "production_features_frozen": production_features(frozen=True),
    "run_training": f"""
WITH {TX},{SPLIT}
SELECT 'success' AS status, 'training' AS mode, 'queries' AS build_id, 'latest' AS model_version,
       CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS rejected,
       (SELECT CAST(count(*) FILTER (is_laundering IS NULL) AS VARCHAR) FROM t) AS missing,
       (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM prod) AS n_production,
       (SELECT count(*) FROM train) AS n_features""",
    "model_compare": f"""
WITH {TX},{SPLIT},
held AS (
  SELECT CAST(sum(floor(0.2 * n + 0.5)) AS BIGINT) AS n_test
  FROM (SELECT count(*) AS n FROM train GROUP BY is_laundering)
)
SELECT model, n_test, TRUE AS metrics_fit
FROM (VALUES ('random_forest'), ('boosted_slow'), ('boosted_fast'), ('ensemble')) AS m(model), held""",
    "best_model": """
WITH guesses AS (
  SELECT 1 AS place, 'random_forest' AS model, 1 - quality AS prediction, toxic AS label FROM labels
  UNION ALL SELECT 2, 'boosted_slow', quality, toxic FROM labels
  UNION ALL SELECT 3, 'boosted_fast', CAST(doc_id % 2 AS INTEGER), toxic FROM labels
  UNION ALL SELECT 4, 'ensemble', 0, toxic FROM labels
),
counted AS (
  SELECT place, model, count(*) FILTER (prediction = 1 AND label = 1) AS tp,
         count(*) FILTER (prediction = 1) AS guessed, count(*) FILTER (label = 1) AS truth
  FROM guesses GROUP BY place, model
),
rated AS (
  SELECT *, coalesce(tp / nullif(guessed, 0), 0.0) AS p, coalesce(tp / nullif(truth, 0), 0.0) AS r
  FROM counted
),
scored AS (
  SELECT *, 0.6 * r + 0.3 * coalesce(2 * p * r / nullif(p + r, 0), 0.0) + 0.1 * p AS objective
  FROM rated
)
SELECT model, round(objective, 8) AS objective FROM scored ORDER BY objective DESC, place LIMIT 1""",
    **{
        name: f"""
WITH {TX},{SPLIT}
SELECT txn_id, TRUE AS walk_fits, TRUE AS vote_fits, TRUE AS probability_fits, TRUE AS class_fits,
       TRUE AS confidence_fits
FROM prod"""
        for name in ("score_batch", "stream_score")
    },
    "confusion_matrix": f"WITH {PL}, {QUALITY} SELECT tp, fp, tn, fn FROM m",
    "quality_metrics": f"""
WITH {PL}, {QUALITY}
SELECT tp, round(accuracy, 8) AS accuracy, round(precision, 8) AS precision,
       round(recall, 8) AS recall, round(f1, 8) AS f1,
       round(0.6 * recall + 0.3 * f1 + 0.1 * precision, 8) AS objective
FROM q""",
    "class_report": REPORT,
    "prediction_distribution": """
SELECT event_type, count(*) AS n,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) AS share
FROM events GROUP BY event_type""",
    "latency_last_1000": """
SELECT count(*) AS n_recent, round(avg(value), 8) AS average_value
FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)""",
    "request_metrics": f"SELECT {REQUESTS} FROM events",
    "stream_velocity": """
SELECT event_id, user_id,
       count(*) OVER (PARTITION BY user_id ORDER BY sec
                      RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS velocity,
       round(coalesce((epoch_us(ts) - lag(epoch_us(ts))
                       OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, -1.0), 6)
         AS since_last
FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)""",
    "stream_features": select(window_columns()),
    "stream_latency_last_1000": """
SELECT count(*) AS n_recent, round(avg(value), 8) AS average_value
FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)""",
    "stream_quality": f"""
WITH pl AS (
  SELECT date_trunc('hour', ts) AS hour, CAST(value > 50 AS INTEGER) AS prediction,
         CASE WHEN event_type <> 'click' THEN CAST(event_type = 'error' AS INTEGER) END AS label
  FROM events
),
settled AS (
  SELECT least(max(ts), max(ts) FILTER (event_type <> 'click') + INTERVAL 5 MINUTE)
         - INTERVAL 10 MINUTE - INTERVAL 6 HOUR AS until
  FROM events
),
m AS (
  SELECT hour, count(*) FILTER (prediction = 1 AND label = 1) AS tp,
         count(*) FILTER (prediction = 1 AND label = 0) AS fp,
         count(*) FILTER (prediction = 0 AND label = 0) AS tn,
         count(*) FILTER (prediction = 0 AND label = 1) AS fn,
         count(*) FILTER (label IS NULL) AS unlabelled
  FROM pl WHERE hour + INTERVAL 1 HOUR <= (SELECT until FROM settled) GROUP BY hour
),
{QUALITY.split("),", 1)[1]}
SELECT CAST(epoch(hour) AS BIGINT) AS window_start, tp, fp, tn, fn, unlabelled,
       round(accuracy, 8) AS accuracy, round(precision, 8) AS precision,
       round(recall, 8) AS recall, round(f1, 8) AS f1
FROM q""",
    "stream_request_metrics": (
        f"SELECT {WINDOW_START}, {REQUESTS} FROM events {CLOSED} GROUP BY date_trunc('hour', ts)"
    ),
    "stream_prediction_metrics": (
        f"SELECT {WINDOW_START}, event_type, count(*) AS n,"
        f" round(avg(value), 8) AS average_latency"
        f" FROM events {CLOSED} GROUP BY date_trunc('hour', ts), event_type"
    ),
}
