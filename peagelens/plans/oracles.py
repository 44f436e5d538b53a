"""The same queries in ANSI-style SQL over the given tables, for an independent check."""

import math

from peagelens.operators.distribution import CELL, REACH
from peagelens.operators.forecast import DRAWS
from peagelens.plans.queries import (
    BEND_RATE,
    BEND_SIZE,
    FIXED_BENDS,
    FIXED_SEASONS,
    FIXED_TREND,
    FIXED_WAVES,
    KDE_POINTS,
)
from peagelens.schema import (
    CAP_FACTOR,
    CASH_PAYMENTS,
    DAY_PERIODS,
    FEATURE_LAGS,
    FEATURE_WINDOWS,
    FORECAST_HOURS,
    HISTORY_HOURS,
    LOOKBACK_HOURS,
    NOISE_SHARE,
    NOISE_STD,
    SEASONS,
    SECOND_PASS_LAGS,
    SECOND_PASS_WINDOWS,
    SUBSCRIBER_PAYMENTS,
    WEEKDAYS_FR,
)

EVENTS = """tx AS (
  SELECT *, CASE WHEN montant_paye < 0 THEN 0.0::DOUBLE ELSE montant_paye END AS montant_net FROM (
    SELECT CASE WHEN event_id % 83 <> 0 THEN event_id END AS id_transaction, ts AS date_heure,
      CASE user_id % 6 WHEN 0 THEN 'Cotonou-Nord' WHEN 1 THEN 'Allada' WHEN 2 THEN 'Houegbo'
        WHEN 3 THEN 'Porto-Novo' WHEN 4 THEN 'Epke' ELSE 'Parakou' END AS gare,
      CAST(event_id % 4 + 1 AS INTEGER) AS voie,
      CASE event_type WHEN 'click' THEN 'MOTO' WHEN 'view' THEN 'VL' WHEN 'purchase' THEN 'PL'
        ELSE 'BUS' END AS classe_vehicule,
      CASE WHEN event_id % 97 = 0 THEN -value WHEN event_id % 89 = 0 THEN 0.0::DOUBLE
        ELSE value END AS montant_paye,
      CASE event_id % 5 WHEN 0 THEN 'Especes' WHEN 1 THEN chr(9) || 'Badge' WHEN 2 THEN ' Abonné '
        WHEN 3 THEN 'Mobile Money' ELSE 'Carte' END AS type_paiement,
      CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 73 = 0 THEN 'Suspendu'
        WHEN user_id % 3 = 0 THEN 'Oui' ELSE 'Non' END AS statut_abonnement,
      CASE WHEN event_id % 89 = 0 THEN 'Exonere' ELSE 'Standard' END AS type_transaction
    FROM events) e)"""

ORDERS = """tx AS (
  SELECT *, CASE WHEN montant_paye < 0 THEN 0.0::DOUBLE ELSE montant_paye END AS montant_net FROM (
    SELECT o_orderkey AS id_transaction, o_orderdate AS date_heure, n_name AS gare,
      CAST(o_orderkey % 4 + 1 AS INTEGER) AS voie, c_mktsegment AS classe_vehicule,
      round(o_totalprice - 50000.0::DOUBLE, 2) AS montant_paye, o_orderpriority AS type_paiement,
      CASE WHEN c_acctbal < 0 THEN 'Oui' ELSE 'Non' END AS statut_abonnement,
      CASE o_orderstatus WHEN 'P' THEN 'Exonere' ELSE 'Standard' END AS type_transaction
    FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey) o)"""

PAID = "paid AS (SELECT * FROM tx WHERE montant_net > 0)"

HOURLY = """hourly AS (
  SELECT date_trunc('hour', date_heure) AS ds, count(*) AS y FROM tx
  WHERE date_heure IS NOT NULL GROUP BY 1)"""

DENSE = f"""{HOURLY},
spine AS (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 HOUR)) AS ds FROM hourly),
dense AS (SELECT spine.ds, coalesce(y, 0) AS y FROM spine LEFT JOIN hourly USING (ds))"""

DENSE_GARE = """hourly AS (
  SELECT gare, date_trunc('hour', date_heure) AS ds, count(*) AS y FROM tx
  WHERE date_heure IS NOT NULL AND gare IS NOT NULL GROUP BY 1, 2),
spine AS (
  SELECT gare, unnest(generate_series(min(ds), max(ds), INTERVAL 1 HOUR)) AS ds
  FROM hourly GROUP BY gare),
dense AS (SELECT gare, ds, coalesce(y, 0) AS y FROM spine LEFT JOIN hourly USING (gare, ds))"""

# The same passages with the number that decides which fields of the export are bad.
RAW_EVENTS = EVENTS.replace("SELECT CASE WHEN event_id % 83", "SELECT event_id AS n, CASE WHEN event_id % 83")

RAW_TYPED = """fact_rows AS (
  SELECT id_transaction,
    CASE WHEN n % 101 <> 0 THEN date_heure END AS date_heure,
    CASE WHEN n % 107 = 0 THEN NULL WHEN n % 109 = 0 THEN 'Porto "Nord", A' ELSE gare END AS gare,
    CASE WHEN n % 131 <> 0 THEN voie END AS voie, classe_vehicule,
    CASE WHEN n % 103 <> 0 AND n % 127 <> 0 THEN montant_paye END AS montant_paye,
    CASE WHEN n % 103 <> 0 AND n % 127 <> 0 THEN montant_net END AS montant_net,
    type_paiement, statut_abonnement, type_transaction,
    TIMESTAMP '2024-02-01 00:00:00' AS load_timestamp
  FROM tx)"""

LOAD_REPORT = """WITH n AS (SELECT event_id AS n, value FROM events),
c AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE n % 101 = 0) AS bad_time,
  count(*) FILTER (WHERE n % 131 = 0) AS bad_lane,
  count(*) FILTER (WHERE n % 127 = 0 AND n % 103 <> 0) AS bad_amount FROM n)
SELECT 'rows' AS measure, n_rows AS n FROM c UNION ALL SELECT 'malformed', 0 FROM c
UNION ALL SELECT 'lost_id_transaction', 0 FROM c UNION ALL SELECT 'lost_date_heure', bad_time FROM c
UNION ALL SELECT 'lost_voie', bad_lane FROM c UNION ALL SELECT 'lost_montant_paye', bad_amount FROM c"""


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _r(expr: str, digits: int) -> str:
    """Rounded, with no negative zero."""
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _count_by(key: str) -> str:
    return _with(
        EVENTS, PAID,
        select=f"SELECT {key}, count(id_transaction) AS transactions FROM paid "
        f"WHERE {key} IS NOT NULL GROUP BY 1",
    )


def _share_by(key: str) -> str:
    pct = _r("count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()", 6)
    return _with(
        EVENTS,
        select=f"SELECT {key}, count(*) AS transactions, {pct} AS pct FROM tx "
        f"WHERE {key} IS NOT NULL GROUP BY 1",
    )


def _revenue_by(key: str) -> str:
    return _with(
        EVENTS, PAID,
        select=f"SELECT {key}, {_r('sum(montant_net)', 4)} AS revenue FROM paid "
        f"WHERE {key} IS NOT NULL GROUP BY 1",
    )


def _weekday(number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(WEEKDAYS_FR))
    return f"CASE {number} {cases} END"


def _period(hour: str) -> str:
    cases = " ".join(f"WHEN {hour} < {end} THEN '{name}'" for name, _, end in DAY_PERIODS)
    return f"CASE {cases} END"


def _summary(key: str) -> str:
    return _with(
        EVENTS,
        select=f"SELECT {key}, count(id_transaction) AS total_transactions, "
        "min(date_heure) AS first_transaction, max(date_heure) AS last_transaction "
        f"FROM tx WHERE {key} IS NOT NULL GROUP BY 1",
    )


def _hourly_by(key: str) -> str:
    return _with(
        EVENTS,
        select=f"SELECT {key}, date_trunc('hour', date_heure) AS ds, count(*) AS count FROM tx "
        f"WHERE {key} IS NOT NULL AND date_heure IS NOT NULL GROUP BY 1, 2",
    )


def _kpi(source: str) -> str:
    days = (
        f"days AS (SELECT CAST(date_heure AS DATE) AS jour, count(id_transaction) AS n, "
        f"sum(montant_net) AS r FROM {source} WHERE date_heure IS NOT NULL GROUP BY 1)"
    )
    fields = {
        "total_revenue": "sum(montant_net)",
        "avg_ticket": "avg(montant_net)",
        "median_ticket": "quantile_cont(montant_net, 0.5)",
        "avg_transactions_per_day": "(SELECT avg(n) FROM days)",
        "avg_revenue_per_day": "(SELECT avg(r) FROM days)",
    }
    columns = ", ".join(f"coalesce({_r(e, 4)}, 0.0::DOUBLE) AS {n}" for n, e in fields.items())
    return days + (
        f"\nSELECT count(*) AS total_transactions, {columns}, "
        f"(SELECT count(*) FROM days) AS active_days FROM {source}"
    )


def _growth(binding: str = ORDERS) -> str:
    def window(d: int) -> str:
        def total(first: str, last: str) -> str:
            return (
                f"coalesce(sum(CASE WHEN date_heure >= e - INTERVAL {first} DAY "
                f"AND date_heure < e - INTERVAL {last} DAY THEN montant_net END), 0.0::DOUBLE)"
            )

        return (
            f"SELECT {d} AS window_days, {total(str(d), '0')} AS c, {total(str(2 * d), str(d))} AS p "
            "FROM paid, last_end"
        )

    return _with(
        binding, PAID,
        "last_end AS (SELECT max(date_heure) + INTERVAL 1 HOUR AS e FROM paid)",
        f"w AS ({window(7)} UNION ALL {window(30)})",
        select=f"SELECT CAST(window_days AS INTEGER) AS window_days, {_r('c', 4)} AS current_revenue, "
        f"{_r('p', 4)} AS previous_revenue, "
        f"{_r('CASE WHEN p <= 0 THEN 0.0::DOUBLE ELSE (c - p) / p * 100.0::DOUBLE END', 4)} "
        "AS growth_pct FROM w",
    )


def _subscription() -> str:
    blank = "' ' || chr(9)"
    payment, status = f"lower(trim(type_paiement, {blank}))", f"lower(trim(statut_abonnement, {blank}))"
    subscriber = f"({status} = 'oui' OR {payment} IN {_in(SUBSCRIBER_PAYMENTS)})"
    cash = f"{payment} IN {_in(CASH_PAYMENTS)}"
    return _with(
        EVENTS, PAID,
        f"s AS (SELECT sum(CASE WHEN {subscriber} THEN montant_net ELSE 0.0::DOUBLE END) AS a, "
        f"sum(CASE WHEN {cash} THEN montant_net ELSE 0.0::DOUBLE END) AS c, "
        "sum(montant_net) AS t FROM paid)",
        select=f"SELECT 'Abonnés' AS canal, {_r('a', 4)} AS revenue FROM s UNION ALL "
        f"SELECT 'Cash', {_r('c', 4)} FROM s UNION ALL "
        f"SELECT 'Autres', {_r('greatest(t - a - c, 0.0::DOUBLE)', 4)} FROM s",
    )


_DIMENSIONS = {
    "gare": "gare",
    "classe": "classe_vehicule",
    "paiement": "type_paiement",
    "jour_semaine": "CAST(isodow(date_heure) - 1 AS VARCHAR)",
    "heure": "CAST(hour(date_heure) AS VARCHAR)",
    "jour": "strftime(date_heure, '%Y-%m-%d')",
}


def _breakdowns() -> str:
    parts = [
        f"SELECT '{name}' AS dimension, {expr} AS label, count(id_transaction) AS transactions, "
        f"{_r('sum(montant_net)', 4)} AS revenue FROM paid GROUP BY 2 HAVING {expr} IS NOT NULL"
        for name, expr in _DIMENSIONS.items()
    ]
    return _with(EVENTS, PAID, select="\nUNION ALL\n".join(parts))


def _peaks() -> str:
    def best(kind: str, expr: str, order: str) -> str:
        return (
            f"(SELECT '{kind}' AS kind, CAST({expr} AS VARCHAR) AS label, "
            "count(id_transaction) AS transactions FROM paid GROUP BY 2 "
            f"ORDER BY 3 DESC, {order} LIMIT 1)"
        )

    return _with(
        EVENTS, PAID,
        select=" UNION ALL ".join(
            [
                best("jour", _DIMENSIONS["jour"], "2"),
                best("heure", "hour(date_heure)", f"CAST({'label'} AS INTEGER)"),
                best("gare", "gare", "2"),
            ]
        ),
    )


def _best_worst(binding: str = ORDERS) -> str:
    def pick(kind: str, order: str) -> str:
        return f"(SELECT '{kind}' AS kind, jour, r AS amount FROM days ORDER BY r {order}, jour LIMIT 1)"

    return _with(
        binding, PAID,
        "days AS (SELECT strftime(date_heure, '%Y-%m-%d') AS jour, sum(montant_net) AS r "
        "FROM paid GROUP BY 1)",
        select=f"SELECT kind, jour, {_r('amount', 4)} AS amount FROM "
        f"({pick('best', 'DESC')} UNION ALL {pick('worst', 'ASC')}) b",
    )


def _describe(*names: str) -> str:
    def one(column: str) -> str:
        fields = {
            "mean": f"avg({column})",
            "std": f"stddev_samp({column})",
            "min": f"min({column})::DOUBLE",
            "p25": f"quantile_cont({column}, 0.25)",
            "p50": f"quantile_cont({column}, 0.5)",
            "p75": f"quantile_cont({column}, 0.75)",
            "max": f"max({column})::DOUBLE",
        }
        columns = ", ".join(f"{_r(e, 4)} AS {n}" for n, e in fields.items())
        return f"SELECT '{column}' AS variable, count({column}) AS count, {columns} FROM tx"

    return _with(EVENTS, select=" UNION ALL ".join(one(n) for n in names))


FENCES = """cuts AS (
  SELECT classe_vehicule, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
    quantile_cont({v}, 0.75) AS q3
  FROM {src} WHERE classe_vehicule IS NOT NULL GROUP BY 1),
fenced AS (
  SELECT t.*, q1, median, q3, q1 - (q3 - q1) * 1.5::DOUBLE AS low_fence,
    q3 + (q3 - q1) * 1.5::DOUBLE AS high_fence
  FROM {src} t JOIN cuts USING (classe_vehicule))"""


def _box(v: str, src: str, key: str | None) -> str:
    fenced = FENCES.format(v=v, src=src)
    if key is None:
        src_all = f"(SELECT * REPLACE ('all' AS classe_vehicule) FROM {src})"
        fenced = FENCES.format(v=v, src=src_all)
    label = f"{key}, " if key else ""
    return _with(
        EVENTS, PAID, fenced,
        select=f"SELECT {label}{_r('max(q1)', 4)} AS q1, {_r('max(median)', 4)} AS median, "
        f"{_r('max(q3)', 4)} AS q3, "
        + _r(f"min({v}) FILTER (WHERE {v} BETWEEN low_fence AND high_fence)", 4)
        + " AS whisker_low, "
        + _r(f"max({v}) FILTER (WHERE {v} BETWEEN low_fence AND high_fence)", 4)
        + f" AS whisker_high, count(*) FILTER (WHERE {v} < low_fence OR {v} > high_fence) AS n_outliers "
        "FROM fenced GROUP BY classe_vehicule",
    )


def _histogram(binding: str, where: str, bins: int) -> str:
    return _with(
        binding,
        f"v AS (SELECT montant_net AS x FROM tx WHERE montant_net IS NOT NULL AND {where})",
        f"b AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS w FROM v)",
        "edges AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * w AS low, lo + (i + 1) * w AS high "
        f"FROM range({bins}) r(i), b)",
        select=f"SELECT bin, {_r('low', 6)} AS low, {_r('high', 6)} AS high, count(x) AS count "
        f"FROM edges LEFT JOIN v ON x >= low AND (x < high OR bin = {bins - 1}) "
        "GROUP BY bin, low, high",
    )


def _kde(bins: int = 100, where: str = "TRUE") -> str:
    return _with(
        EVENTS.replace("tx AS (", "every AS (", 1),
        f"tx AS (SELECT * FROM every WHERE {where})",
        "v AS (SELECT montant_net AS x, count(*) AS c FROM tx "
        "WHERE montant_net IS NOT NULL GROUP BY 1)",
        "s AS (SELECT min(montant_net) AS lo, max(montant_net) AS hi, count(*) AS n, "
        "stddev_samp(montant_net) * pow(count(*), -0.2::DOUBLE) AS h FROM tx)",
        f"g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / {KDE_POINTS - 1} AS p, "
        f"lo, hi, n, h FROM range({KDE_POINTS}) r(i), s)",
        "d AS (SELECT point, p, lo, hi, n, sum(c * exp(-0.5::DOUBLE * ((x - p) / h) * ((x - p) / h)))"
        " / (n * h * sqrt(2 * pi())) AS y FROM g, v GROUP BY point, p, lo, hi, n, h)",
        select=f"SELECT point, {_r('p', 7)} AS x, {_r('y', 7)} AS density, "
        f"{_r(f'y * n * (hi - lo) / {bins}', 7)} AS expected_count FROM d",
    )


def _correlation() -> str:
    names = ["montant_paye", "heure", "montant_net", "ca"]
    lines = [
        f"SELECT '{a}' AS variable, "
        + ", ".join(f"{_r(f'corr({a}, {b})', 8)} AS {b}" for b in names)
        + " FROM n"
        for a in names
    ]
    return _with(
        EVENTS,
        "n AS (SELECT montant_paye, hour(date_heure)::DOUBLE AS heure, montant_net, "
        "montant_net AS ca FROM tx)",
        select=" UNION ALL ".join(lines),
    )


YEARS = range(1995, 2002)


def _pivot_month(agg: str) -> str:
    columns = ", ".join(
        f"{agg.format(where=f'FILTER (WHERE year(date_heure) = {y})')} AS \"{y}\"" for y in YEARS
    )
    return _with(
        ORDERS,
        select="SELECT CAST(month(date_heure) AS INTEGER) AS mois_num, "
        f"monthname(date_heure) AS mois, {columns} FROM tx GROUP BY 1, 2",
    )


_DTYPES = {
    "id_transaction": "bigint", "date_heure": "timestamp_ntz", "gare": "string", "voie": "int",
    "classe_vehicule": "string", "montant_paye": "double", "montant_net": "double",
    "type_paiement": "string", "statut_abonnement": "string", "type_transaction": "string",
    "load_timestamp": "timestamp_ntz",
}


def _profile() -> str:
    lines = [
        f"SELECT '{name}' AS \"column\", '{kind}' AS dtype, count({name}) AS non_null, "
        f"count(*) - count({name}) AS nulls FROM fact_rows"
        for name, kind in _DTYPES.items()
    ]
    return _with(RAW_EVENTS, RAW_TYPED, select=" UNION ALL ".join(lines))


def _duplicates() -> str:
    def scope(name: str, columns: str) -> str:
        return (
            f"SELECT '{name}' AS scope, (SELECT count(*) FROM tx) AS n_rows, "
            f"(SELECT count(*) FROM (SELECT DISTINCT {columns} FROM tx) q) AS n_distinct"
        )

    lane = "date_trunc('hour', date_heure), gare, voie, classe_vehicule, type_paiement"
    return _with(
        EVENTS,
        f"d AS ({scope('row', '*')} UNION ALL {scope('lane_hour', lane)})",
        select="SELECT scope, n_rows, n_distinct, n_rows - n_distinct AS n_duplicates FROM d",
    )


def _time_columns(at: str) -> dict[str, str]:
    turn = 2.0 * math.pi
    h, m = f"hour({at})", f"month({at})"
    return {
        "heure": f"CAST({h} AS INTEGER)",
        "jour_semaine": f"CAST(isodow({at}) - 1 AS INTEGER)",
        "jour_mois": f"CAST(day({at}) AS INTEGER)",
        "mois": f"CAST({m} AS INTEGER)",
        "est_weekend": f"CAST(isodow({at}) >= 6 AS INTEGER)",
        "heure_sin": f"sin({h} * {turn / 24!r}::DOUBLE)",
        "heure_cos": f"cos({h} * {turn / 24!r}::DOUBLE)",
        "mois_sin": f"sin({m} * {turn / 12!r}::DOUBLE)",
        "mois_cos": f"cos({m} * {turn / 12!r}::DOUBLE)",
    }


def _lag_columns(lags: tuple[int, ...]) -> dict[str, str]:
    return {
        f"nb_vehicules_lag{k}": f"CAST(lag(nb_vehicules, {k}) OVER (ORDER BY date) AS DOUBLE)"
        for k in lags
    }


def _rolling_columns(windows: tuple[int, ...]) -> dict[str, str]:
    columns = {}
    for w in windows:
        over = f"OVER (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")):
            columns[f"nb_vehicules_roll_{name}_{w}"] = (
                f"CASE WHEN count(nb_vehicules) {over} = {w} "
                f"THEN CAST({agg}(nb_vehicules) {over} AS DOUBLE) END"
            )
    return columns


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


# Hours are those with any passage; what counts is the known ids.
KNOWN_IDS = DENSE.replace("count(*) AS y", "count(id_transaction) AS y")
SERIES = KNOWN_IDS + ",\nseries AS (SELECT ds AS date, y AS nb_vehicules FROM dense)"


def _round_all(columns: dict[str, str], digits: int) -> str:
    """Rounds the columns that are doubles, passes the others."""
    whole = {"heure", "jour_semaine", "jour_mois", "mois", "est_weekend"}
    return ", ".join(
        n if n in whole else f"{_r(n, digits)} AS {n}" for n in columns
    )


def _feature_ctes() -> tuple[list[str], dict[str, str]]:
    columns = {
        **_time_columns("date"), **_lag_columns(FEATURE_LAGS), **_rolling_columns(FEATURE_WINDOWS)
    }
    full = " AND ".join(f"{n} IS NOT NULL" for n in columns)
    ctes = [
        EVENTS, SERIES,
        f"wide AS (SELECT date, nb_vehicules, {_select(columns)} FROM series)",
        f"feat AS (SELECT * FROM wide WHERE {full})",
    ]
    return ctes, columns


def _features() -> str:
    ctes, columns = _feature_ctes()
    return _with(*ctes, select=f"SELECT date, nb_vehicules, {_round_all(columns, 6)} FROM feat")


def _second_pass() -> str:
    ctes, columns = _feature_ctes()
    new = {**_lag_columns(SECOND_PASS_LAGS), **_rolling_columns(SECOND_PASS_WINDOWS)}
    kept = {n: n for n in columns if n not in new}
    full = " AND ".join(f"{n} IS NOT NULL" for n in new)
    ctes.append(f"wide2 AS (SELECT date, nb_vehicules, {_select({**kept, **new})} FROM feat)")
    return _with(
        *ctes,
        select=f"SELECT date, nb_vehicules, {_round_all({**kept, **new}, 6)} "
        f"FROM wide2 WHERE {full}",
    )


def _fourier() -> str:
    days = (
        "(CAST(ds AS DATE) - DATE '1970-01-01') + "
        "(hour(ds) * 3600 + minute(ds) * 60 + second(ds)) / 86400.0::DOUBLE"
    )
    waves = []
    for name, period, order in SEASONS:
        for k in range(1, order + 1):
            angle = f"t * {2.0 * math.pi * k / period!r}::DOUBLE"
            waves.append(f"{_r(f'sin({angle})', 8)} AS {name}_sin_{k}")
            waves.append(f"{_r(f'cos({angle})', 8)} AS {name}_cos_{k}")
    return _with(
        EVENTS, DENSE, f"days AS (SELECT ds, y, {days} AS t FROM dense)",
        select=f"SELECT ds, y, {', '.join(waves)} FROM days",
    )


def _splits() -> str:
    def part(train: float, val: float) -> str:
        a, b = f"floor(n * {train}::DOUBLE)", f"floor(n * {val}::DOUBLE)"
        return f"CASE WHEN i <= {a} THEN 'train' WHEN i <= {a} + {b} THEN 'val' ELSE 'test' END"

    return _with(
        EVENTS, DENSE,
        "p AS (SELECT ds, y, row_number() OVER (ORDER BY ds) AS i, count(*) OVER () AS n FROM dense)",
        select=f"SELECT ds, y, {part(0.7, 0.15)} AS part_70_15_15, {part(0.8, 0.0)} AS part_80_20 "
        "FROM p",
    )


def _forecast_metrics() -> str:
    return _with(
        EVENTS, DENSE_GARE,
        "p AS (SELECT gare, y, "
        f"CAST(lag(y, {LOOKBACK_HOURS}) OVER (PARTITION BY gare ORDER BY ds) AS DOUBLE) AS f, "
        "row_number() OVER (PARTITION BY gare ORDER BY ds) AS i, "
        "count(*) OVER (PARTITION BY gare) AS n FROM dense)",
        "t AS (SELECT * FROM p WHERE i > floor(n * 0.8::DOUBLE) AND f IS NOT NULL)",
        select=f"SELECT gare, count(*) AS n_test, {_r('avg(abs(y - f))', 2)} AS mae, "
        f"{_r('sqrt(avg((y - f) * (y - f)))', 2)} AS rmse, "
        f"{_r('avg(abs((y - f) / (y + 1e-8::DOUBLE))) * 100.0::DOUBLE', 2)} AS mape "
        "FROM t GROUP BY gare",
    )


def _long(**sections: tuple[str, tuple[str, ...], tuple[str, ...]]) -> str:
    """Sections of a report, each SQL with its label columns and figures, as one frame."""
    parts = []
    for section, (sql, labels, figures) in sections.items():
        label = "concat_ws('|', " + ", ".join(f'CAST("{c}" AS VARCHAR)' for c in labels) + ")" if labels else "''"
        for f in figures:
            value = f'epoch_us("{f}") / 1e6::DOUBLE' if f in _TIMES else f'CAST("{f}" AS DOUBLE)'
            parts.append(
                f"SELECT '{section}' AS section, {label} AS label, '{f}' AS measure, {_r(value, 4)} AS value "
                f"FROM ({sql})"
            )
    return "\nUNION ALL\n".join(parts)


_TIMES = ("start", "end", "first_transaction", "last_transaction")
_KPI = (
    "total_transactions", "total_revenue", "avg_ticket", "median_ticket",
    "avg_transactions_per_day", "avg_revenue_per_day", "active_days",
)


def _traffic_report() -> str:
    days = _with(
        EVENTS, PAID,
        select="SELECT strftime(date_heure, '%Y-%m-%d') AS jour, count(id_transaction) AS transactions, "
        "sum(montant_net) AS revenue FROM paid WHERE date_heure IS NOT NULL GROUP BY 1",
    )
    period = _with(
        EVENTS, PAID,
        select='SELECT min(date_heure) AS start, max(date_heure) AS "end" FROM paid',
    )
    return _long(
        summary=(f"WITH {EVENTS},\n{PAID},\n{_kpi('paid')}", (), _KPI),
        growth=(_growth(EVENTS), ("window_days",), ("current_revenue", "previous_revenue", "growth_pct")),
        period=(period, (), ("start", "end")),
        peaks=(_peaks(), ("kind", "label"), ("transactions",)),
        breakdowns=(_breakdowns(), ("dimension", "label"), ("transactions", "revenue")),
        weekdays=(ORACLES["weekday_counts"], ("jour_num",), ("transactions",)),
        daily=(days, ("jour",), ("transactions", "revenue")),
        best_worst_day=(_best_worst(EVENTS), ("kind", "jour"), ("amount",)),
        channels=(_subscription(), ("canal",), ("revenue",)),
    )


def _entity_report(key: str) -> str:
    return _long(
        summary=(_summary(key), (key,), ("total_transactions", "first_transaction", "last_transaction")),
        hourly=(_hourly_by(key), (key, "ds"), ("count",)),
    )


def _noisy_forecast() -> str:
    """Noise from an MD5 digest by the Box-Muller rule, clipped and rounded half to even."""
    size = float(1 << 48)
    u = "CAST(('0x' || substr(d, {}, 12)) AS BIGINT)::DOUBLE"
    noise = (
        f"sqrt(-2.0::DOUBLE * ln(({u.format(1)} + 1.0::DOUBLE) / {size!r}::DOUBLE)) "
        f"* cos({2.0 * math.pi!r}::DOUBLE * ({u.format(13)} / {size!r}::DOUBLE)) "
        f"* (coalesce(y_std, 0.0::DOUBLE) * {NOISE_STD * NOISE_SHARE!r}::DOUBLE)"
    )

    def out(expr: str, name: str) -> str:
        return f"round_even(least(greatest({expr} + z, 0.0::DOUBLE), cap), 2) AS {name}"

    return _with(
        EVENTS, DENSE_GARE,
        "ranked AS (SELECT gare, ds, y, row_number() OVER (PARTITION BY gare ORDER BY ds DESC) AS i FROM dense)",
        "limits AS (SELECT gare, stddev_samp(y) AS y_std, "
        f"max(y) * {CAP_FACTOR!r}::DOUBLE AS cap FROM dense GROUP BY gare)",
        f"ahead AS (SELECT gare, ds + INTERVAL {LOOKBACK_HOURS} HOUR AS ds, y::DOUBLE AS yhat, y_std, cap, "
        f"md5('0|' || gare || '|' || strftime(ds + INTERVAL {LOOKBACK_HOURS} HOUR, '%Y-%m-%d %H:%M:%S')) AS d "
        f"FROM ranked JOIN limits USING (gare) WHERE i <= {LOOKBACK_HOURS})",
        f"drawn AS (SELECT *, {noise} AS z FROM ahead)",
        select=f"SELECT gare, ds AS datetime, {out('yhat', 'predicted')}, "
        f"{out('yhat - y_std', 'lower_95')}, {out('yhat + y_std', 'upper_95')} FROM drawn",
    )


def _binned_kde(bins: int = 100) -> str:
    """Values split over the two cells beside them, kernels summed for the occupied cells."""
    return _with(
        EVENTS,
        "shape AS (SELECT min(montant_net) AS low, max(montant_net) AS high, count(montant_net) AS n, "
        "stddev_samp(montant_net) * pow(count(montant_net), -0.2) AS h FROM tx)",
        f"scale AS (SELECT *, (high - low) / {KDE_POINTS - 1} AS step, h * {CELL!r}::DOUBLE AS width FROM shape)",
        "places AS (SELECT (montant_net - low) / width AS pos FROM tx, scale WHERE montant_net IS NOT NULL)",
        "cells AS (SELECT cell, sum(w) AS w FROM (SELECT floor(pos) AS cell, 1.0::DOUBLE - (pos - floor(pos)) AS w FROM places "
        "UNION ALL SELECT floor(pos) + 1, pos - floor(pos) FROM places) c GROUP BY cell)",
        f"points AS (SELECT CAST(unnest(range({KDE_POINTS})) AS INTEGER) AS point)",
        "sums AS (SELECT point, coalesce(sum(w * exp(-0.5::DOUBLE * pow((cell * width - point * step) / h, 2))) "
        f"FILTER (WHERE abs(cell * width - point * step) <= {REACH!r}::DOUBLE * h), 0.0::DOUBLE) AS s "
        "FROM points, cells, scale GROUP BY point)",
        "results AS (SELECT point, low + point * step AS x, "
        f"s / (n * h * {math.sqrt(2.0 * math.pi)!r}::DOUBLE) AS density, n * (high - low) / {bins} AS expected FROM sums, scale)",
        select=f"SELECT point, {_r('x', 7)} AS x, {_r('density', 7)} AS density, {_r('density * expected', 7)} AS expected_count FROM results",
    )


def _fixed_product() -> str:
    """A fixed multiplicative model over the gap-free network hours."""
    weights = iter(FIXED_WAVES)
    waves = []
    for _, period, order in FIXED_SEASONS:
        for k in range(1, order + 1):
            angle = f"(day * {2.0 * math.pi * k / period!r}::DOUBLE)"
            waves += [f"{next(weights)!r}::DOUBLE * {f}({angle})" for f in ("sin", "cos")]
    level, slope = FIXED_TREND
    trend = f"{level!r}::DOUBLE + t * {slope!r}::DOUBLE" + "".join(
        f" + greatest(t - {place!r}::DOUBLE, 0.0::DOUBLE) * {change!r}::DOUBLE" for place, change in FIXED_BENDS
    )
    days = "(CAST(ds AS DATE) - DATE '1970-01-01') + hour(ds) * 3600 / 86400.0::DOUBLE"
    return _with(
        EVENTS, DENSE,
        f"placed AS (SELECT ds, y, {days} AS day FROM dense)",
        "timed AS (SELECT *, (day - min(day) OVER ()) / (max(day) OVER () - min(day) OVER ()) AS t FROM placed)",
        f"parts AS (SELECT ds, y, {trend} AS trend, {' + '.join(waves)} AS season FROM timed)",
        select=f"SELECT ds, y, {_r('trend', 6)} AS trend, {_r('season', 6)} AS season, "
        f"{_r('trend * (1.0::DOUBLE + season)', 6)} AS yhat FROM parts",
    )


def _fixed_band() -> str:
    """Futures drawn from digests: Laplace bends whose slopes add up, noise by Box-Muller, quantiles over the draws."""
    size = float(1 << 48)
    whole = "CAST(('0x' || substr({}, {}, 12)) AS BIGINT)::DOUBLE"
    side = f"(({whole.format('b', 13)} + 0.5::DOUBLE) / {size!r}::DOUBLE - 0.5::DOUBLE)"
    noise = (
        f"sqrt(-2.0::DOUBLE * ln(({whole.format('z', 1)} + 1.0::DOUBLE) / {size!r}::DOUBLE)) "
        f"* cos({2.0 * math.pi!r}::DOUBLE * ({whole.format('z', 13)} / {size!r}::DOUBLE))"
    )
    return _with(
        EVENTS, DENSE_GARE,
        "ranked AS (SELECT gare, ds, y, row_number() OVER (PARTITION BY gare ORDER BY ds DESC) AS i FROM dense)",
        "spread AS (SELECT gare, stddev_samp(y) AS noise FROM dense GROUP BY gare)",
        f"ahead AS (SELECT gare, ds + INTERVAL {LOOKBACK_HOURS} HOUR AS ds, y::DOUBLE AS yhat, noise, "
        "CAST(row_number() OVER (PARTITION BY gare ORDER BY ds) AS INTEGER) AS step "
        f"FROM ranked JOIN spread USING (gare) WHERE i <= {LOOKBACK_HOURS})",
        "drawn AS (SELECT gare, step, noise, draw, md5('bend|0|' || gare || '|' || draw || '|' || step) AS b, "
        f"md5('0|' || gare || '|' || draw || '|' || step) AS z FROM ahead, (SELECT unnest(range(1, {DRAWS + 1})) AS draw) n)",
        f"bent AS (SELECT *, CASE WHEN ({whole.format('b', 1)} + 0.5::DOUBLE) / {size!r}::DOUBLE < {BEND_RATE!r}::DOUBLE "
        f"THEN -{BEND_SIZE!r}::DOUBLE * sign({side}) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs({side})) ELSE 0.0::DOUBLE END AS bend FROM drawn)",
        "slopes AS (SELECT *, sum(bend) OVER (PARTITION BY gare, draw ORDER BY step) AS slope FROM bent)",
        "moved AS (SELECT gare, step, coalesce(sum(slope) OVER (PARTITION BY gare, draw ORDER BY step "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) + noise * {noise} AS off FROM slopes)",
        "ends AS (SELECT gare, step, quantile_cont(off, 0.025) AS lo, quantile_cont(off, 0.975) AS hi FROM moved GROUP BY ALL)",
        select=f"SELECT gare, ds, step, yhat, {_r('yhat + lo', 6)} AS yhat_lower, {_r('yhat + hi', 6)} AS yhat_upper "
        "FROM ahead JOIN ends USING (gare, step)",
    )


def _rollout(select: str) -> str:
    """The fixed model rolled forward: each clipped value is fed back into the window."""
    n, day = LOOKBACK_HOURS, LOOKBACK_HOURS - 24 + 1
    return "WITH RECURSIVE " + ",\n".join([
        EVENTS, DENSE,
        "ends AS (SELECT min(y)::DOUBLE AS lo, max(y)::DOUBLE AS hi, max(ds) AS last FROM dense)",
        "width AS (SELECT *, CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END AS w FROM ends)",
        f"tail AS (SELECT ds, y FROM dense ORDER BY ds DESC LIMIT {n})",
        "roll AS (SELECT 0 AS i, (SELECT list((y - lo) / w ORDER BY ds) FROM tail, width) AS x, "
        "NULL::DOUBLE AS p UNION ALL "
        f"SELECT i + 1, list_append(x[2:], least(greatest(v, 0.0::DOUBLE), 1.0::DOUBLE)), v FROM "
        f"(SELECT i, x, x[1] * 0.6::DOUBLE + x[{day}] * 0.4::DOUBLE AS v FROM roll WHERE i < {FORECAST_HOURS}) q)",
        "ahead AS (SELECT CAST(i - 1 AS INTEGER) AS hour, last + i * INTERVAL 1 HOUR AS ds, "
        "greatest(p * w + lo, 0.0::DOUBLE) AS predicted FROM roll, width WHERE i > 0)",
    ]) + "\n" + select


def _fixed_reservoir() -> str:
    """The fixed reservoir: its state warmed on the last hours, then fed with its own clipped predictions."""
    inner = ((0.5, -0.3, 0.0), (0.2, 0.4, -0.5), (0.0, 0.6, 0.3))
    inputs = ((0.8, 0.1, -0.2), (-0.5, 0.3, 0.2), (0.4, -0.2, 0.1))
    bias, readout = (0.1, -0.2, 0.3), (0.45, 0.1, -0.12, -0.15, 0.2, -0.15, 0.1)
    n, seen = LOOKBACK_HOURS, ("a", "s", "c")

    def total(weights, names) -> str:
        return " + ".join(f"{w}::DOUBLE * {x}" for w, x in zip(weights, names))

    def state(k: int) -> str:
        drive = total(inner[k] + inputs[k], ("x1", "x2", "x3", *seen))
        return f"0.3::DOUBLE * x{k + 1} + 0.7::DOUBLE * tanh({drive} + {bias[k]}::DOUBLE) AS z{k + 1}"

    told = total(readout[1:], (*seen, "z1", "z2", "z3"))
    return "WITH RECURSIVE " + ",\n".join([
        EVENTS, DENSE,
        "ends AS (SELECT min(y)::DOUBLE AS lo, max(y)::DOUBLE AS hi, max(ds) AS last FROM dense)",
        "width AS (SELECT *, CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END AS w FROM ends)",
        "placed AS (SELECT ds, (y - lo) / w AS u, row_number() OVER (ORDER BY ds DESC) AS back FROM dense, width)",
        f"tail AS (SELECT {n} + 1 - back AS k, u FROM placed WHERE back <= {n})",
        "roll AS (SELECT 0 AS i, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS x3, NULL::DOUBLE AS v UNION ALL "
        f"SELECT i, z1, z2, z3, {readout[0]}::DOUBLE + {told} AS v FROM "
        f"(SELECT *, {', '.join(state(k) for k in range(3))} FROM "
        "(SELECT i + 1 AS i, x1, x2, x3, 2.0::DOUBLE * coalesce(u, least(greatest(v, 0.0::DOUBLE), 1.0::DOUBLE)) - 1.0::DOUBLE AS a, "
        f"sin(angle * (epoch(last) / 3600 - {n} + i + 2)) AS s, cos(angle * (epoch(last) / 3600 - {n} + i + 2)) AS c "
        f"FROM roll LEFT JOIN tail ON k = i + 1, width, (SELECT 2.0::DOUBLE * pi() / 24.0::DOUBLE AS angle) "
        f"WHERE i < {n} + {FORECAST_HOURS} - 1) q) q)",
    ]) + (
        f"\nSELECT CAST(i - {n} AS INTEGER) AS hour, last + (i - {n} + 1) * INTERVAL 1 HOUR AS ds, "
        f"{_r('greatest(v * w + lo, 0.0::DOUBLE)', 6)} AS predicted FROM roll, width WHERE i >= {n}"
    )


def _fixed_metrics() -> str:
    lag = "CAST(lag(y, {}) OVER (ORDER BY ds) AS DOUBLE)"
    return _with(
        EVENTS, DENSE,
        f"p AS (SELECT ds, y, {lag.format(LOOKBACK_HOURS)} * 0.6::DOUBLE + {lag.format(24)} * 0.4::DOUBLE AS f FROM dense)",
        "w AS (SELECT *, row_number() OVER (ORDER BY ds) AS i, count(*) OVER () AS n FROM p WHERE f IS NOT NULL)",
        "t AS (SELECT * FROM w WHERE i > floor(n * 0.8::DOUBLE))",
        select=f"SELECT count(*) AS n_test, {_r('avg(abs(y - f))', 6)} AS mae, "
        f"{_r('sqrt(avg((y - f) * (y - f)))', 6)} AS rmse, "
        f"{_r('avg(abs((y - f) / (y + 1e-8::DOUBLE))) * 100.0::DOUBLE', 6)} AS mape FROM t",
    )


def _feature_sequences() -> str:
    ctes, columns = _feature_ctes()
    names = [*columns, "nb_vehicules"]
    bounds = ", ".join(f"min({c})::DOUBLE AS {c}_lo, max({c})::DOUBLE AS {c}_hi" for c in names)
    scaled = ", ".join(
        f"({c} - {c}_lo) / CASE WHEN {c}_hi > {c}_lo THEN {c}_hi - {c}_lo ELSE 1.0::DOUBLE END AS {c}" for c in names
    )
    past = "OVER (ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    total = " + ".join(columns)
    first, last = list(columns)[0], list(columns)[-1]
    a, b = "floor(n * 0.7::DOUBLE)", "floor(n * 0.15::DOUBLE)"
    return _with(
        *ctes,
        f"b AS (SELECT {bounds} FROM feat)",
        f"s AS (SELECT date, {scaled} FROM feat, b)",
        f"w AS (SELECT date, nb_vehicules AS y, count(*) {past} AS k, sum({total}) {past} AS x_sum, "
        f"lag({first}, 24) OVER (ORDER BY date) AS x_first, lag({last}, 1) OVER (ORDER BY date) AS x_last FROM s)",
        "f AS (SELECT *, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM w WHERE k = 24)",
        select=f"SELECT date, CASE WHEN i <= {a} THEN 'train' WHEN i <= {a} + {b} THEN 'val' ELSE 'test' END AS part, "
        f"{_r('y', 6)} AS y, CAST({24 * len(columns)} AS INTEGER) AS n_values, {_r('x_sum', 6)} AS x_sum, "
        f"{_r('x_first', 6)} AS x_first, {_r('x_last', 6)} AS x_last FROM f",
    )


FACT_SELECT = _with(RAW_EVENTS, RAW_TYPED, select="SELECT * FROM fact_rows")


ORACLES: dict[str, str] = {
    "scan_paid": _with(EVENTS, PAID, select="SELECT * FROM paid"),
    "scan_all": _with(
        EVENTS, select="SELECT date_heure, id_transaction, gare, classe_vehicule FROM tx"
    ),
    "etl_transform": FACT_SELECT,
    "etl_csv_roundtrip": FACT_SELECT,
    "etl_report": LOAD_REPORT,
    "calendar_parts": _with(
        EVENTS,
        select="SELECT id_transaction, strftime(date_heure, '%Y-%m-%d') AS date, "
        "CAST(hour(date_heure) AS INTEGER) AS heure, dayname(date_heure) AS jour_semaine, "
        "monthname(date_heure) AS mois, CAST(year(date_heure) AS INTEGER) AS annee, "
        f"{_period('hour(date_heure)')} AS periode_jour FROM tx",
    ),
    "count_by_payment": _count_by("type_paiement"),
    "count_by_class": _count_by("classe_vehicule"),
    "count_by_gare": _count_by("gare"),
    "payment_share": _share_by("type_paiement"),
    "class_share": _share_by("classe_vehicule"),
    "gare_share": _share_by("gare"),
    "hourly_profile": _with(
        EVENTS, PAID,
        select="SELECT CAST(hour(date_heure) AS INTEGER) AS heure, "
        "count(*) AS nombre_transactions FROM paid WHERE date_heure IS NOT NULL GROUP BY 1",
    ),
    "weekday_counts": _with(
        EVENTS, PAID,
        "c AS (SELECT isodow(date_heure) - 1 AS n, count(id_transaction) AS t FROM paid GROUP BY 1)",
        select=f"SELECT CAST(i AS INTEGER) AS jour_num, {_weekday('i')} AS jour_semaine, "
        "coalesce(t, 0) AS transactions FROM range(7) r(i) LEFT JOIN c ON n = i",
    ),
    "day_period_counts": _with(
        EVENTS,
        f"p AS (SELECT {_period('hour(date_heure)')} AS periode, count(*) AS n FROM tx GROUP BY 1)",
        select="SELECT q.periode, coalesce(n, 0) AS transactions FROM (VALUES "
        + ", ".join(f"('{name}')" for name, _, _ in DAY_PERIODS)
        + ") q(periode) LEFT JOIN p USING (periode)",
    ),
    "daily_counts": _with(
        EVENTS, PAID,
        select="SELECT strftime(date_heure, '%Y-%m-%d') AS jour, "
        "count(id_transaction) AS transactions FROM paid GROUP BY 1",
    ),
    "distinct_classes": _with(EVENTS, PAID, select="SELECT DISTINCT classe_vehicule FROM paid"),
    "daily_revenue": _with(
        EVENTS, PAID,
        select="SELECT strftime(date_heure, '%Y-%m-%d') AS jour, "
        f"{_r('sum(montant_net)', 4)} AS revenue FROM paid GROUP BY 1",
    ),
    "daily_revenue_first31": _with(
        ORDERS, PAID,
        select="SELECT strftime(date_heure, '%Y-%m-%d') AS jour, "
        f"{_r('sum(montant_net)', 4)} AS revenue FROM paid GROUP BY 1 ORDER BY 1 LIMIT 31",
    ),
    "revenue_by_gare": _revenue_by("gare"),
    "revenue_by_class": _revenue_by("classe_vehicule"),
    "revenue_by_payment": _revenue_by("type_paiement"),
    "weekday_revenue": _with(
        EVENTS, PAID,
        "w AS (SELECT CAST(isodow(date_heure) - 1 AS INTEGER) AS jour_num, "
        "sum(montant_net) AS r FROM paid WHERE date_heure IS NOT NULL GROUP BY 1)",
        select=f"SELECT jour_num, {_weekday('jour_num')} AS jour_semaine, "
        f"{_r('r', 4)} AS montant_net FROM w",
    ),
    "monthly_revenue_by_payment": _with(
        ORDERS, PAID,
        select="SELECT strftime(date_heure, '%Y-%m') AS mois, type_paiement, "
        f"{_r('sum(montant_net)', 4)} AS montant_net FROM paid GROUP BY 1, 2",
    ),
    "mean_amount_by_class": _with(
        EVENTS,
        select=f"SELECT classe_vehicule, {_r('avg(montant_net)', 6)} AS mean_amount "
        "FROM tx GROUP BY 1",
    ),
    "revenue_growth": _growth(),
    "subscription_breakdown": _subscription(),
    "breakdowns_one_pass": _breakdowns(),
    "kpi_summary": f"WITH {EVENTS},\n{PAID},\n{_kpi('paid')}",
    "kpi_empty": f"WITH {EVENTS},\n{PAID},\n"
    f"none AS (SELECT * FROM paid WHERE gare = 'Aucune gare'),\n{_kpi('none')}",
    "anomaly_rate": _with(
        EVENTS,
        select="SELECT count(*) FILTER (WHERE montant_paye <= 0) AS anomalies, count(*) AS total, "
        + _r("count(*) FILTER (WHERE montant_paye <= 0) * 100.0::DOUBLE / count(*)", 6)
        + " AS pct FROM tx",
    ),
    "eda_summary": _with(
        EVENTS,
        select=f"SELECT count(*) AS total_transactions, {_r('sum(montant_net)', 4)} AS total_ca, "
        f"{_r('avg(montant_net)', 4)} AS ca_moyen, "
        + _r(
            "count(*) FILTER (WHERE statut_abonnement = 'Oui') * 100.0::DOUBLE "
            "/ count(statut_abonnement)", 4,
        )
        + " AS pct_abonnes, "
        + _r(
            "count(*) FILTER (WHERE type_transaction = 'Standard') * 100.0::DOUBLE "
            "/ count(type_transaction)", 4,
        )
        + " AS pct_standard, "
        "count(*) FILTER (WHERE type_transaction = 'Exonere') AS n_exonere FROM tx",
    ),
    "peaks": _peaks(),
    "best_worst_day": _best_worst(),
    "top10_gares_revenue": _with(
        ORDERS, PAID,
        "g AS (SELECT gare, sum(montant_net) AS r FROM paid GROUP BY 1 "
        "ORDER BY 2 DESC, 1 LIMIT 10)",
        select=f"SELECT gare, {_r('r', 4)} AS revenue FROM g",
    ),
    "top3_gares_revenue": _with(
        ORDERS,
        "g AS (SELECT gare, sum(montant_net) AS r FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)",
        select=f"SELECT gare, {_r('r', 4)} AS revenue FROM g",
    ),
    "top10_gares_count": _with(
        ORDERS,
        select="SELECT gare, count(id_transaction) AS transactions FROM tx GROUP BY 1 "
        "ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "top15_amounts": _with(
        EVENTS,
        select="SELECT montant_net, count(*) AS transactions FROM tx "
        "WHERE montant_net IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    ),
    "class_summary": _summary("classe_vehicule"),
    "gare_summary": _summary("gare"),
    "global_summary": _with(
        EVENTS,
        select='SELECT count(*) AS total_transactions, min(date_heure) AS start, '
        'max(date_heure) AS "end" FROM tx',
    ),
    "class_amount_stats": _with(
        EVENTS, PAID,
        select=f"SELECT classe_vehicule, count(montant_net) AS count, "
        f"{_r('avg(montant_net)', 4)} AS mean, "
        f"{_r('quantile_cont(montant_net, 0.5)', 4)} AS median, "
        f"{_r('min(montant_net)', 4)} AS min, {_r('max(montant_net)', 4)} AS max, "
        f"{_r('stddev_samp(montant_net)', 4)} AS std FROM paid GROUP BY 1",
    ),
    "box_stats": _box("montant_net", "paid", "classe_vehicule"),
    "box_stats_paid_by_class": _box("montant_paye", "tx", "classe_vehicule"),
    "box_stats_all": _box("montant_net", "tx", None),
    "box_outliers": _with(
        EVENTS, FENCES.format(v="montant_paye", src="tx"),
        select="SELECT id_transaction, classe_vehicule, montant_paye FROM fenced "
        "WHERE montant_paye < low_fence OR montant_paye > high_fence",
    ),
    "describe_amount": _describe("montant_paye", "montant_net"),
    "describe_numeric": _describe("id_transaction", "voie", "montant_paye", "montant_net"),
    "histogram_amount": _histogram(EVENTS, "montant_net > 0", 80),
    "histogram_all": _histogram(EVENTS, "TRUE", 100),
    "histogram_zoom": _histogram(ORDERS, "montant_net <= 3000", 60),
    "kde_amount": _kde(),
    "kde_amount_binned": _binned_kde(),
    "kde_amount_zoom": _kde(60, "montant_net <= 60"),
    "correlation_matrix": _correlation(),
    "pivot_amount": _with(
        EVENTS,
        select="SELECT type_paiement, "
        + ", ".join(
            _r(f"avg(montant_net) FILTER (WHERE statut_abonnement = '{v}')", 6) + f' AS "{v}"'
            for v in ("Non", "Oui", "Suspendu")
        )
        + " FROM tx GROUP BY 1",
    ),
    "pivot_month_year_count": _pivot_month("nullif(count(*) {where}, 0)"),
    "pivot_month_year_revenue": _pivot_month(
        "(round(sum(montant_net) {where}, 4) + 0.0::DOUBLE)"
    ),
    "profile_nulls": _profile(),
    "duplicate_rows": _duplicates(),
    "hourly_counts_sparse": _with(
        EVENTS, HOURLY, select="SELECT ds, y AS nombre_voitures FROM hourly"
    ),
    "hourly_counts_dense": _with(
        EVENTS, DENSE, select="SELECT ds, y AS nombre_voitures FROM dense"
    ),
    "hourly_counts_dense_by_gare": _with(
        EVENTS, DENSE_GARE, select="SELECT gare, ds, y FROM dense"
    ),
    "class_hourly": _hourly_by("classe_vehicule"),
    "gare_hourly": _hourly_by("gare"),
    "series_stats": _with(
        EVENTS, DENSE_GARE,
        select="SELECT gare, min(ds) AS data_start, max(ds) AS data_end, count(*) AS n_hours, "
        "CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS n_hours_train, "
        f"{_r('avg(y)', 6)} AS y_mean, {_r('stddev_samp(y)', 6)} AS y_std, max(y) AS y_max "
        "FROM dense GROUP BY gare",
    ),
    "history_tail": _with(
        EVENTS, DENSE, select=f"SELECT ds, y FROM dense ORDER BY ds DESC LIMIT {HISTORY_HOURS}"
    ),
    "last_90_days": _with(
        ORDERS, DENSE,
        select="SELECT ds, y FROM dense "
        "WHERE ds >= (SELECT max(ds) FROM dense) - INTERVAL 90 DAY",
    ),
    "chrono_split": _splits(),
    "calendar_features": _with(
        EVENTS, SERIES, f"t AS (SELECT *, {_select(_time_columns('date'))} FROM series)",
        select=f"SELECT date, nb_vehicules, {_round_all(_time_columns('date'), 10)} FROM t",
    ),
    "lag_features": _with(
        EVENTS, SERIES,
        select=f"SELECT date, nb_vehicules, {_select(_lag_columns(FEATURE_LAGS))} FROM series",
    ),
    "rolling_features": _with(
        EVENTS, SERIES,
        f"t AS (SELECT date, nb_vehicules, {_select(_rolling_columns(FEATURE_WINDOWS))} FROM series)",
        select=f"SELECT date, nb_vehicules, {_round_all(_rolling_columns(FEATURE_WINDOWS), 6)} "
        "FROM t",
    ),
    "feature_table": _features(),
    "feature_table_second_pass": _second_pass(),
    "fourier_features": _fourier(),
    "sequence_windows": _with(
        EVENTS, DENSE,
        f"s AS (SELECT ds, list(y) OVER (ORDER BY ds ROWS BETWEEN {LOOKBACK_HOURS} PRECEDING "
        "AND 1 PRECEDING) AS l, y FROM dense)",
        select="SELECT ds, array_to_string(l, ',') AS x, y FROM s "
        f"WHERE len(l) = {LOOKBACK_HOURS}",
    ),
    "minmax_scaled": _with(
        EVENTS, DENSE,
        "b AS (SELECT min(y)::DOUBLE AS lo, max(y)::DOUBLE AS hi FROM dense)",
        select="SELECT ds, y, "
        + _r("(y - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END", 10)
        + " AS y_scaled FROM dense, b",
    ),
    "forecast_metrics": _forecast_metrics(),
}

ORACLES["report_traffic_stats"] = _traffic_report()
ORACLES["report_class"] = _entity_report("classe_vehicule")
ORACLES["report_station"] = _entity_report("gare")
ORACLES["report_global"] = _long(
    summary=(ORACLES["global_summary"], (), ("total_transactions", "start", "end")),
    hourly=(_with(EVENTS, DENSE, select="SELECT ds, y AS count FROM dense"), ("ds",), ("count",)),
    day_periods=(ORACLES["day_period_counts"], ("periode",), ("transactions",)),
)
ORACLES |= {
    "rollout_fixed": _rollout(
        "SELECT hour, ds AS date, CAST(round_even(predicted, 0) AS BIGINT) AS predicted_vehicles FROM ahead"
    ),
    "rollout_fixed_summary": _rollout(
        f"SELECT count(*) AS future_hours, 0.0::DOUBLE AS noise_std, CAST({LOOKBACK_HOURS} AS INTEGER) AS lookback_hours, "
        "CAST(round_even(avg(predicted), 0) AS BIGINT) AS mean_prediction, "
        "CAST(round_even(min(predicted), 0) AS BIGINT) AS min_prediction, "
        "CAST(round_even(max(predicted), 0) AS BIGINT) AS max_prediction FROM ahead"
    ),
    "rollout_fixed_with_history": _rollout(
        f"(SELECT 'history' AS kind, ds, y::DOUBLE AS value FROM dense ORDER BY ds DESC LIMIT {HISTORY_HOURS}) "
        f"UNION ALL SELECT 'forecast', ds, {_r('predicted', 6)} FROM ahead"
    ),
    "reservoir_fixed": _fixed_reservoir(),
    "autoregressive_metrics_fixed": _fixed_metrics(),
    "forecast_noisy": _noisy_forecast(),
    "forecast_band_fixed": _fixed_band(),
    "kpi_of_stored_cube": f"WITH {ORDERS},\n{PAID},\n{_kpi('paid')}",
    "cube_by_month": _with(
        ORDERS, PAID,
        select="SELECT strftime(date_heure, '%Y-%m') AS annee_mois, classe_vehicule, count(*) AS rows, "
        f"CAST(count(id_transaction) AS BIGINT) AS transactions, {_r('sum(montant_net)', 2)} AS revenue, "
        "CAST(count(montant_net) AS BIGINT) AS amounts FROM paid GROUP BY 1, 2",
    ),
    "forecast_product_fixed": _fixed_product(),
    "forecast_as_csv": "SELECT * EXCLUDE (gare), regexp_replace(lower(gare), '[- ]', '_', 'g') AS gare_safe "
    f"FROM ({_noisy_forecast()}) f",
    "stats_as_json": ORACLES["series_stats"],
    "stats_as_documents": ORACLES["series_stats"],
    "registry_facts": _with(
        EVENTS, DENSE_GARE,
        select="SELECT gare, regexp_replace(lower(gare), '[- ]', '_', 'g') AS gare_safe, min(ds) AS data_start, "
        "max(ds) AS data_end, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS n_hours_train, "
        "round_even(avg(y), 3) AS y_mean, round_even(stddev_samp(y), 3) AS y_std, max(y) AS y_max "
        "FROM dense GROUP BY gare",
    ),
    "sequence_windows_features": _feature_sequences(),
}
