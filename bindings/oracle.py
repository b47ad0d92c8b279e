"""The same questions as plain SQL over the given tables, written independently of the operators."""

from __future__ import annotations

CTES: dict[str, str] = {}
MATERIALIZED = ("panel", "daily", "panel_sources", "panel_months", "daily_months", "visible", "events_once", "keyed", "decided", "features")
FINAL: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def ask(name: str, needs: str, sql: str) -> None:
    FINAL[name] = (needs.split(), sql)


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (needs, sql) in FINAL.items():
        head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" if n in MATERIALIZED else f"{n} AS ({CTES[n]})" for n in needs)
        out[name] = (f"WITH {head}\n" if needs else "") + sql
    return out


def r6(expression: str, alias: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0::DOUBLE AS {alias or expression}"


AS_OF = "DATE '2000-06-30'"
TODAY = "DATE '2001-09-01'"
SIGNALS = "('NATION_3', 'NATION_7', 'NATION_11', 'NATION_19')"

SHORT = ("real_gdp_yoy", "cpi_yoy", "unemployment_rate", "policy_rate", "yield_10y", "yield_2y")
LONG = ("total_credit_pct_gdp", "gov_debt_pct_gdp", "private_nonfin_pct_gdp", "hh_debt_pct_gdp",
        "corp_debt_pct_gdp", "debt_service_ratio")
INDICATORS = SHORT + LONG
LAGS = {"cpi_yoy_3m_ago": ("cpi_yoy", 90), "unemployment_3m_ago": ("unemployment_rate", 90),
        "policy_rate_6m_ago": ("policy_rate", 180), "total_credit_5y_ago": ("total_credit_pct_gdp", 1825),
        "debt_service_5y_ago": ("debt_service_ratio", 1825)}
DERIVED = {
    "cpi_change_3m": "cpi_yoy - cpi_yoy_3m_ago",
    "unemployment_change_3m": "unemployment_rate - unemployment_3m_ago",
    "policy_rate_change_6m": "policy_rate - policy_rate_6m_ago",
    "yield_curve_slope": "yield_10y - yield_2y",
    "total_credit_5y_change_pp": "total_credit_pct_gdp - total_credit_5y_ago",
    "dsr_5y_change_pp": "debt_service_ratio - debt_service_5y_ago",
    "real_rate_10y": "yield_10y - cpi_yoy",
}
THRESHOLDS = {"debt_late_cycle_low": 220, "debt_extreme": 280, "dsr_stretched": 17, "dsr_distress": 18,
              "dsr_extreme": 22, "cpi_elevated": 3, "cpi_peak": 4}

# ---- panel ------------------------------------------------------------------------------------

_FLAG = {"r": "l_returnflag = 'R'", "a": "l_returnflag = 'A'", "o": "l_linestatus = 'O'"}
_SUMS = """count(*)::DOUBLE AS n,
  (count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS n_r,
  (count(*) FILTER (l_returnflag = 'A'))::DOUBLE AS n_a,
  (count(*) FILTER (l_linestatus = 'O'))::DOUBLE AS n_o,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE AS price,
  sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE AS discount,
  sum(CAST(round(l_quantity * 100) AS BIGINT))::DOUBLE AS quantity,
  sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS order_total,
  sum(CAST(round(l_tax * 100) AS BIGINT))::DOUBLE AS tax,
  (sum(CAST(round(l_tax * 100) AS BIGINT)) FILTER (l_linestatus = 'O'))::DOUBLE AS tax_o,
  (sum(CAST(round(l_tax * 100) AS BIGINT)) FILTER (l_returnflag = 'R'))::DOUBLE AS tax_r,
  (sum(CAST(round(l_tax * 100) AS BIGINT)) FILTER (l_returnflag = 'A'))::DOUBLE AS tax_a"""
_MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"
cte("wide", f"""SELECT n_name AS entity, {_MONTH} AS date, {_SUMS}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
cte("wide_customer", f"""SELECT CAST(o_custkey AS VARCHAR) AS entity, {_MONTH} AS date, {_SUMS}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")

_ROLES = {
    "real_gdp_yoy": "(price / lag(price, 12) OVER (PARTITION BY entity ORDER BY date) - 1::DOUBLE) * 100::DOUBLE",
    "cpi_yoy": "3::DOUBLE + 2::DOUBLE * (discount / n - 5::DOUBLE)",
    "unemployment_rate": "tax / n",
    "policy_rate": "CASE WHEN n_o <> 0 THEN tax_o / n_o END",
    "yield_10y": "quantity / n / 600::DOUBLE",
    "yield_2y": "CASE WHEN n_r <> 0 THEN tax_r / n_r END",
    "total_credit_pct_gdp": "1000::DOUBLE * price / order_total",
    "gov_debt_pct_gdp": "100::DOUBLE * n_o / n",
    "private_nonfin_pct_gdp": "100::DOUBLE * (n_r + n_a) / n",
    "hh_debt_pct_gdp": "100::DOUBLE * n_r / n",
    "corp_debt_pct_gdp": "100::DOUBLE * n_a / n",
    "debt_service_ratio": "50::DOUBLE * n_r / n",
    "hy_spread": f"CASE WHEN entity IN {SIGNALS} AND n_a <> 0 THEN tax_a / n_a END",
}


def _panel(wide: str) -> str:
    parts = "\n  UNION ALL ".join(f"SELECT entity, '{n}' AS indicator, date, {e} AS value FROM {wide}" for n, e in _ROLES.items())
    return f"SELECT * FROM ({parts}) WHERE value IS NOT NULL"


cte("panel", _panel("wide"))
cte("panel_customer", _panel("wide_customer"))
PANEL = "wide panel"

cte("daily", """SELECT p_brand AS entity, CAST(l_shipdate AS DATE) AS date, l_returnflag AS source,
  sum(CAST(round(l_quantity * 100) AS BIGINT))::DOUBLE / count(*)::DOUBLE AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
_RANK = "CASE source WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END"
cte("canonical", f"""SELECT entity, date, value FROM daily
  QUALIFY row_number() OVER (PARTITION BY entity, date ORDER BY {_RANK}) = 1""")
cte("nation_orders", """SELECT o.*, n_name AS entity, n_nationkey, n_regionkey FROM orders o
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

# ---- snapshots ---------------------------------------------------------------------------------

_QUARTERS = "SELECT CAST(g AS DATE) AS as_of FROM generate_series(DATE '1995-10-01', DATE '2001-08-01', INTERVAL 3 MONTH) t(g)"
cte("grid", _QUARTERS)
cte("grid_one", f"SELECT {AS_OF} AS as_of")
cte("panel_sources", """SELECT entity, indicator, date, value, 'STAR' AS source FROM panel
  UNION ALL SELECT entity, indicator, date, value * 1.25::DOUBLE, 'ALT' FROM panel WHERE (year(date) * 12 + month(date)) % 2 = 0
  UNION ALL SELECT entity, indicator, CAST(date + 14 AS DATE), value * 0.75::DOUBLE, 'MID' FROM panel WHERE (year(date) * 12 + month(date)) % 3 = 0""")
_SRC_RANK = "CASE source WHEN 'ALT' THEN 0 WHEN 'STAR' THEN 1 ELSE 2 END"
cte("panel_srcday", f"""SELECT entity, indicator, date, value FROM panel_sources
  QUALIFY row_number() OVER (PARTITION BY entity, indicator, date ORDER BY {_SRC_RANK}) = 1""")
cte("panel_lagged45", "SELECT entity, indicator, CAST(date + 45 AS DATE) AS date, value FROM panel")


def _snapshot_ctes(suffix: str, panel: str, grid: str, entities: str) -> None:
    cte(f"found{suffix}", f"""SELECT p.entity, p.indicator, g.as_of, max(p.date) AS observed_on, arg_max(p.value, p.date) AS value
  FROM {panel} p JOIN {grid} g ON p.date <= g.as_of GROUP BY ALL""")
    cte(f"anchors{suffix}", f"SELECT DISTINCT entity, indicator, observed_on FROM found{suffix}")
    cte(f"lagged{suffix}", f"""SELECT a.entity, a.indicator, a.observed_on,
  arg_max(p.value, p.date) FILTER (p.date <= a.observed_on - 90) AS lag_90,
  arg_max(p.value, p.date) FILTER (p.date <= a.observed_on - 180) AS lag_180,
  arg_max(p.value, p.date) FILTER (p.date <= a.observed_on - 1825) AS lag_1825
  FROM anchors{suffix} a JOIN {panel} p ON p.entity = a.entity AND p.indicator = a.indicator AND p.date <= a.observed_on
  GROUP BY ALL""")
    picks = [f"max(value) FILTER (indicator = '{i}') AS {i}, max(f.observed_on) FILTER (indicator = '{i}') AS {i}_date" for i in INDICATORS]
    picks += [f"max(lag_{d}) FILTER (indicator = '{i}') AS {n}" for n, (i, d) in LAGS.items()]
    cte(f"snapshot{suffix}", f"""SELECT e.entity, e.as_of, {', '.join(picks)}
  FROM ({entities}) e LEFT JOIN (found{suffix} JOIN lagged{suffix} USING (entity, indicator, observed_on)) f
  ON f.entity = e.entity AND f.as_of = e.as_of GROUP BY 1, 2""")
    derived = ", ".join(f"{e} AS {n}" for n, e in DERIVED.items())
    st = ", ".join(f"{i}_date" for i in SHORT)
    lt = ", ".join(f"{i}_date" for i in (*LONG, "yield_10y", "cpi_yoy"))
    cte(f"features{suffix}", f"""SELECT *, {derived}, greatest({st}) AS st_data_date, greatest({lt}) AS lt_data_date
  FROM snapshot{suffix}""")


_ALL_NATIONS = "SELECT n_name AS entity, as_of FROM nation CROSS JOIN {grid}"
_snapshot_ctes("", "panel", "grid", _ALL_NATIONS.format(grid="grid"))
_snapshot_ctes("_one", "panel", "grid_one", _ALL_NATIONS.format(grid="grid_one"))
_snapshot_ctes("_pit", "panel_lagged45", "grid", _ALL_NATIONS.format(grid="grid"))
_snapshot_ctes("_cust", "panel_customer", "grid_one", "SELECT DISTINCT entity, as_of FROM found_cust WHERE indicator <> 'hy_spread'")
_snapshot_ctes("_custq", "panel_customer", "grid", "SELECT entity, as_of FROM (SELECT DISTINCT entity FROM found_custq WHERE indicator <> 'hy_spread') CROSS JOIN grid")
_snapshot_ctes("_src", "panel_srcday", "grid", _ALL_NATIONS.format(grid="grid"))


def snapshot_needs(suffix: str = "") -> str:
    panels = {"": f"{PANEL} grid", "_one": f"{PANEL} grid_one", "_pit": f"{PANEL} panel_lagged45 grid",
              "_cust": "wide_customer panel_customer grid_one", "_custq": "wide_customer panel_customer grid", "_src": f"{PANEL} panel_sources panel_srcday grid"}
    return f"{panels[suffix]} found{suffix} anchors{suffix} lagged{suffix} snapshot{suffix} features{suffix}"


# ---- calibration and signal ----------------------------------------------------------------------


def _thresholds(panel: str, minimum: int, keys: str = "entity") -> str:
    def quantile(indicator: str, p: float, floor: float | None) -> str:
        q = f"quantile_cont(value, {p}) FILTER (indicator = '{indicator}')"
        if floor is not None:
            q = f"greatest({q}, {floor}::DOUBLE)"
        return f"CASE WHEN count(*) FILTER (indicator = '{indicator}') >= {minimum} THEN {q} END"

    fields = {
        "debt_late_cycle_low": quantile("total_credit_pct_gdp", 0.75, None),
        "debt_extreme": quantile("total_credit_pct_gdp", 0.95, None),
        "dsr_stretched": quantile("debt_service_ratio", 0.75, None),
        "dsr_distress": quantile("debt_service_ratio", 0.9, None),
        "dsr_extreme": quantile("debt_service_ratio", 0.95, None),
        "cpi_elevated": quantile("cpi_yoy", 0.75, 2.5),
        "cpi_peak": quantile("cpi_yoy", 0.9, 3.5),
    }
    columns = ", ".join(f"{e} AS {n}" for n, e in fields.items())
    return f"""SELECT {keys}, {columns} FROM {panel}
  WHERE indicator IN ('total_credit_pct_gdp', 'debt_service_ratio', 'cpi_yoy') GROUP BY {keys}"""


cte("own", _thresholds("panel", 40))
cte("own_grid", _thresholds("(SELECT * FROM panel JOIN grid ON date <= as_of)", 40, "entity, as_of"))
cte("own_grid45", _thresholds("(SELECT * FROM panel_lagged45 JOIN grid ON date <= as_of)", 40, "entity, as_of"))
cte("own_src", _thresholds("panel_sources", 40))
cte("own_grid_src", _thresholds("(SELECT * FROM panel_sources JOIN grid ON date <= as_of)", 40, "entity, as_of"))
cte("own_customer", _thresholds("panel_customer", 40))
cte("own_customer10", _thresholds("panel_customer", 10))


def zscore(keys: str, source: str, latest: str = "arg_max(value, date)", minimum: int = 40) -> str:
    return f"""SELECT {keys}, count(*) AS n_obs,
  CASE WHEN count(*) >= {minimum} THEN {latest} END AS latest,
  CASE WHEN count(*) >= {minimum} THEN CASE WHEN min(value) = max(value) THEN 0::DOUBLE
    ELSE ({latest} - avg(value)) / stddev_pop(value) END END AS z
  FROM {source} GROUP BY {keys}"""


cte("signal_today", zscore("entity", f"(SELECT * FROM panel WHERE indicator = 'hy_spread' AND date >= {TODAY} - 7300)"))
cte("signal_grid", zscore("entity, as_of", """(SELECT p.*, as_of FROM panel p JOIN grid
  ON p.date <= as_of AND p.date >= as_of - 7300 WHERE indicator = 'hy_spread')"""))
cte("signal_grid45", zscore("entity, as_of", """(SELECT p.*, as_of FROM panel_lagged45 p JOIN grid
  ON p.date <= as_of AND p.date >= as_of - 7300 WHERE indicator = 'hy_spread')"""))

_SRC_NEWEST = f"arg_max(value, (date, -({_SRC_RANK})))"
cte("signal_src", zscore("entity", f"(SELECT * FROM panel_sources WHERE indicator = 'hy_spread' AND date >= {TODAY} - 7300)", _SRC_NEWEST))
cte("signal_grid_src", zscore("entity, as_of", """(SELECT p.*, as_of FROM panel_sources p JOIN grid
  ON p.date <= as_of AND p.date >= as_of - 7300 WHERE indicator = 'hy_spread')""", _SRC_NEWEST))

# ---- rules -----------------------------------------------------------------------------------------

_FILLED = ", ".join(f"coalesce(t.{n}, {d}::DOUBLE) AS {n}" for n, d in THRESHOLDS.items())


def _inputs(name: str, features: str, own: str | None, signal: str | None, signal_on: str, own_on: str = "entity") -> None:
    fields = _FILLED if own else ", ".join(f"{d}::DOUBLE AS {n}" for n, d in THRESHOLDS.items())
    joins = f" LEFT JOIN {own} t ON " + " AND ".join(f"t.{k} = f.{k}" for k in own_on.split()) if own else ""
    z = "NULL::DOUBLE AS hy_spread_z"
    if signal:
        z = "s.z AS hy_spread_z"
        joins += f" LEFT JOIN {signal} s ON " + " AND ".join(f"s.{k} = f.{k}" for k in signal_on.split())
    cte(name, f"SELECT f.*, {fields}, {z} FROM {features} f{joins}")


_inputs("inputs", "features", "own", "signal_today", "entity")
_inputs("inputs_src", "features_src", "own_src", "signal_src", "entity")
_inputs("inputs_srcpit", "features_src", "own_grid_src", "signal_grid_src", "entity as_of", "entity as_of")
_inputs("inputs_pit_rules", "features", "own", "signal_grid", "entity as_of")
_inputs("inputs_pit", "features_pit", "own_grid45", "signal_grid45", "entity as_of", "entity as_of")
_inputs("inputs_custq", "features_custq", "own_customer", None, "")
_inputs("inputs_default", "features_one", None, None, "")
_inputs("inputs_one", "features_one", "own", "signal_today", "entity")

D = "::DOUBLE"
_TC, _C5, _DSR = "total_credit_pct_gdp", "total_credit_5y_change_pp", "debt_service_ratio"
SHORT_RULES = {
    "negative_growth": (3, f"CASE WHEN real_gdp_yoy < 0 THEN 1{D} END"),
    "unemployment_rise": (3, f"CASE WHEN unemployment_change_3m > 0.5{D} THEN 1{D} WHEN unemployment_change_3m > 0.3{D} THEN 0.5{D} END"),
    "curve_inverted": (3, f"CASE WHEN yield_curve_slope < 0 THEN 0.4{D} END"),
    "inflation_level": (2, f"""CASE WHEN cpi_yoy > cpi_peak THEN 1{D} WHEN cpi_yoy > cpi_elevated THEN
      CASE WHEN policy_rate_change_6m > 0.5{D} THEN 0.9{D} ELSE 0.5{D} END END"""),
    "inflation_accelerating": (2, f"""CASE WHEN cpi_change_3m > 0.5{D} AND cpi_yoy >
      CASE WHEN cpi_elevated - 0.5{D} > 2{D} THEN cpi_elevated - 0.5{D} ELSE 2{D} END THEN 0.4{D} END"""),
    "policy_cut": (4, f"""CASE WHEN policy_rate_change_6m < -0.5{D} THEN CASE WHEN cpi_yoy < 4 THEN 1{D} ELSE 0.6{D} END
      WHEN policy_rate_change_6m < -0.25{D} THEN CASE WHEN cpi_yoy < 4 THEN 0.6{D} ELSE 0.4{D} END END"""),
    "inflation_falling": (4, f"CASE WHEN cpi_change_3m < -0.3{D} THEN 0.4{D} END"),
    "healthy_growth": (1, f"""CASE WHEN real_gdp_yoy > 1.5{D} AND cpi_yoy < 3 THEN CASE
      WHEN unemployment_change_3m IS NULL THEN 0.6{D} WHEN unemployment_change_3m <= 0.1{D} THEN 1{D}
      WHEN unemployment_change_3m <= 0.3{D} THEN 0.6{D} END END"""),
    "curve_steep": (1, f"CASE WHEN yield_curve_slope > 1 THEN 0.3{D} END"),
}
LONG_RULES = {
    "low_debt": (1, f"CASE WHEN {_TC} < 100 THEN 1{D} END"),
    "debt_outpacing": (2, f"CASE WHEN {_TC} >= 100 AND {_TC} < 200 THEN CASE WHEN {_C5} > 5 THEN 1{D} ELSE 0.4{D} END END"),
    "rapid_credit": (3, f"""CASE WHEN {_TC} < debt_extreme THEN CASE WHEN {_TC} >= 200 AND {_C5} > 15 THEN 1{D}
      WHEN {_TC} >= debt_late_cycle_low THEN 0.5{D} END END"""),
    "spread_tight": (3, f"CASE WHEN hy_spread_z < -1.5{D} THEN 0.5{D} END"),
    "extreme_debt": (4, f"CASE WHEN {_TC} >= debt_extreme THEN CASE WHEN {_DSR} > dsr_stretched THEN 0.8{D} ELSE 0.6{D} END END"),
    "service_burden": (4, f"CASE WHEN {_DSR} > dsr_distress AND {_TC} > debt_late_cycle_low THEN 0.7{D} END"),
    "spread_wide": (4, f"CASE WHEN hy_spread_z > 2 THEN 0.4{D} END"),
    "painful_deleveraging": (5, f"CASE WHEN {_C5} < -10 AND {_TC} > 150 AND {_DSR} > dsr_distress AND cpi_yoy < cpi_elevated THEN 1{D} END"),
    "service_extreme": (5, f"CASE WHEN {_DSR} > dsr_extreme THEN 0.7{D} END"),
    "financial_repression": (6, f"CASE WHEN real_rate_10y < -1 AND {_TC} > 150 THEN CASE WHEN real_rate_10y < -2 THEN 1{D} ELSE 0.7{D} END END"),
    "inflated_away": (6, f"CASE WHEN {_C5} < -10 AND {_TC} > 150 AND cpi_yoy > cpi_elevated THEN 0.7{D} END"),
}
STAGES = {1: "Expansion", 2: "Inflationary peak", 3: "Recession", 4: "Reflation"}
PHASES = {1: "Sound money", 2: "Debt outpaces income", 3: "Bubble", 4: "Top — peak debt service",
          5: "Deleveraging", 6: "Reflation / financial repression"}


def _weights(rules: dict, prefix: str, classes: range) -> str:
    sums = [
        " + ".join(["0::DOUBLE", *[f"coalesce({n}, 0::DOUBLE)" for n, (k, _) in rules.items() if k == cls]]) + f" AS {prefix}_w{cls}"
        for cls in classes
    ]
    fired = " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in rules)
    return ", ".join([*sums, f"{fired} AS {prefix}_n_votes"])


def _decision(source: str, prefix: str, labels: dict, cls: str, label: str, confidence: str) -> str:
    keys = list(labels)
    ranked = " UNION ALL ".join(f"SELECT entity, as_of, {k} AS k, {prefix}_w{k} AS w FROM {source}" for k in keys)
    names = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + " END"
    total = " + ".join(f"{prefix}_w{k}" for k in keys)
    torn = "w1 - w2 < 0.3::DOUBLE AND w2 > 0"
    return f"""SELECT s.entity, s.as_of,
  CASE WHEN {prefix}_n_votes = 0 OR ({torn}) THEN 0 ELSE k1 END AS {cls},
  CASE WHEN {prefix}_n_votes = 0 THEN 'Transition (insufficient data)'
       WHEN {torn} THEN 'Transition (' || {names.format('k1')} || ' ↔ ' || {names.format('k2')} || ')'
       ELSE {names.format('k1')} END AS {label},
  CASE WHEN {prefix}_n_votes = 0 THEN 0::DOUBLE ELSE w1 / ({total} + 1::DOUBLE) END AS {confidence}
  FROM {source} s JOIN (
    SELECT entity, as_of, max(CASE WHEN pos = 1 THEN k END) AS k1, max(CASE WHEN pos = 2 THEN k END) AS k2,
      max(CASE WHEN pos = 1 THEN w END) AS w1, max(CASE WHEN pos = 2 THEN w END) AS w2
    FROM (SELECT *, row_number() OVER (PARTITION BY entity, as_of ORDER BY w DESC, k) AS pos FROM ({ranked}))
    GROUP BY 1, 2) r ON r.entity = s.entity AND r.as_of = s.as_of"""


def _classification(suffix: str, inputs: str) -> None:
    fired = ", ".join(f"{e} AS {n}" for n, (_, e) in {**SHORT_RULES, **LONG_RULES}.items())
    cte(f"fired{suffix}", f"SELECT *, {fired} FROM {inputs}")
    cte(f"weighed{suffix}", f"""SELECT *, {_weights(SHORT_RULES, 'st', range(1, 5))}, {_weights(LONG_RULES, 'lt', range(1, 7))}
  FROM fired{suffix}""")
    cte(f"short{suffix}", _decision(f"weighed{suffix}", "st", STAGES, "st_stage", "st_label", "st_confidence"))
    cte(f"long{suffix}", _decision(f"weighed{suffix}", "lt", PHASES, "lt_phase", "lt_label", "lt_confidence"))
    cte(f"decided{suffix}", f"""SELECT w.*, st_stage, st_label, st_confidence, lt_phase, lt_label, lt_confidence
  FROM weighed{suffix} w JOIN short{suffix} s ON s.entity = w.entity AND s.as_of = w.as_of
  JOIN long{suffix} l ON l.entity = w.entity AND l.as_of = w.as_of""")


_classification("", "inputs")
_classification("_rules", "inputs_pit_rules")
_classification("_pit", "inputs_pit")
_classification("_custq", "inputs_custq")
_classification("_default", "inputs_default")
_classification("_one", "inputs_one")
_classification("_src", "inputs_src")
_classification("_srcpit", "inputs_srcpit")
_USER_RULES = {
    "inverted": (2, "CASE WHEN yield_curve_slope < 0 THEN 0.6::DOUBLE END"),
    "hot": (2, "CASE WHEN cpi_yoy > cpi_elevated THEN 0.5::DOUBLE END"),
    "cheap_money": (1, "CASE WHEN real_rate_10y < -2 THEN 0.9::DOUBLE WHEN real_rate_10y < 0 THEN 0.4::DOUBLE END"),
}
cte("fired_user", "SELECT *, " + ", ".join(f"{e} AS {n}" for n, (_, e) in _USER_RULES.items()) + " FROM inputs")
cte("weighed_user", f"SELECT *, {_weights(_USER_RULES, 'st', range(1, 3))} FROM fired_user")
cte("short_user", _decision("weighed_user", "st", {1: "Loose", 2: "Tight"}, "st_stage", "st_label", "st_confidence"))


def decided_needs(suffix: str) -> str:
    before = {
        "": f"{snapshot_needs()} own signal_today inputs",
        "_rules": f"{snapshot_needs()} own signal_grid inputs_pit_rules",
        "_pit": f"{snapshot_needs('_pit')} own_grid45 signal_grid45 inputs_pit",
        "_custq": f"{snapshot_needs('_custq')} own_customer inputs_custq",
        "_default": f"{snapshot_needs('_one')} inputs_default",
        "_one": f"{snapshot_needs('_one')} own signal_today inputs_one",
        "_src": f"{snapshot_needs('_src')} own_src signal_src inputs_src",
        "_srcpit": f"{snapshot_needs('_src')} own_grid_src signal_grid_src inputs_srcpit",
    }[suffix]
    return f"{before} fired{suffix} weighed{suffix} short{suffix} long{suffix} decided{suffix}"


_CAUTION = "CASE lt_phase WHEN 1 THEN 'low' WHEN 2 THEN 'low' WHEN 4 THEN 'elevated' WHEN 5 THEN 'high' WHEN 6 THEN 'elevated' ELSE 'moderate' END"
_REGIME = """CASE WHEN real_rate_10y IS NULL THEN 'unknown' WHEN real_rate_10y < -1 THEN 'repression'
  WHEN real_rate_10y < 0 THEN 'mild repression' WHEN real_rate_10y < 1 THEN 'neutral' ELSE 'savers compensated' END"""
_INTENSITY = "CASE WHEN real_rate_10y <= -1 THEN 1::DOUBLE WHEN real_rate_10y < 0 THEN -real_rate_10y ELSE 0::DOUBLE END"
_FX = """CASE WHEN home_real_rate IS NULL OR real_rate_10y IS NULL THEN 0::DOUBLE
  WHEN (home_real_rate - real_rate_10y) / 2 > 1 THEN 1::DOUBLE WHEN (home_real_rate - real_rate_10y) / 2 < -1 THEN -1::DOUBLE
  ELSE (home_real_rate - real_rate_10y) / 2 END"""

# ---- tilts ---------------------------------------------------------------------------------------------

_STAGE_TILTS = {
    1: {"equities": 1.0, "credit": 0.5, "real_estate": 0.5, "long_bonds": -0.3, "gold": -0.3, "commodities": -0.2},
    2: {"commodities": 1.0, "gold": 0.7, "tips": 1.0, "real_estate": 0.3, "long_bonds": -1.2, "credit": -0.5, "equities": -0.3},
    3: {"long_bonds": 1.2, "short_bonds": 0.5, "gold": 0.3, "equities": -1.0, "credit": -1.0, "commodities": -0.8, "real_estate": -0.5},
    4: {"equities": 0.5, "gold": 0.7, "tips": 0.5, "real_estate": 0.3, "credit": 0.3, "short_bonds": -0.3},
}
_PHASE_TILTS = {
    3: {"gold": 0.5, "short_bonds": 0.3, "equities": -0.3, "credit": -0.3},
    4: {"gold": 1.0, "short_bonds": 0.7, "tips": 0.3, "equities": -0.7, "credit": -0.7, "real_estate": -0.3, "long_bonds": -0.3},
    5: {"long_bonds": 1.5, "short_bonds": 1.0, "gold": 0.7, "credit": -1.5, "equities": -1.0, "real_estate": -1.2, "commodities": -0.5},
    6: {"gold": 1.2, "tips": 1.2, "real_estate": 0.7, "commodities": 0.5, "equities": 0.3, "long_bonds": -1.2, "short_bonds": -0.5},
}
ASSETS = ("equities", "long_bonds", "short_bonds", "credit", "tips", "gold", "commodities", "real_estate")
_RY = {"gold": 0.4, "commodities": 0.3, "real_estate": 0.2, "long_bonds": -0.4}
_HC = {"gold": -0.3, "equities": -0.15, "long_bonds": -0.2, "commodities": -0.15}

cte("assets", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{a}', {_RY.get(a, 0.0)}::DOUBLE, {_HC.get(a, 0.0)}::DOUBLE)" for i, a in enumerate(ASSETS)) + ") t(pos, asset, ry, hc)")

def _cycle(asset: str, table: dict, cls: str, prefix: str, order: tuple[int, ...]) -> str:
    """One cycle's tilt; the blend adds the classes in the order in which their rules vote."""
    total = "(" + " + ".join(f"{prefix}_w{k}" for k in order) + ")"
    blend = " + ".join(f"{table[k][asset]}::DOUBLE * ({prefix}_w{k} / {total})" for k in order if asset in table.get(k, {}))
    settled = " ".join(f"WHEN {k} THEN {row[asset]}::DOUBLE" for k, row in table.items() if asset in row)
    return f"CASE WHEN {cls} <> 0 THEN CASE {cls} {settled} ELSE 0::DOUBLE END WHEN {total} > 0 THEN {blend} ELSE 0::DOUBLE END"


def _tilts(suffix: str, decided: str, home: str | None, viewer: str = "") -> None:
    st = " ".join(f"WHEN '{a}' THEN {_cycle(a, _STAGE_TILTS, 'st_stage', 'st', (3, 2, 4, 1))}" for a in ASSETS)
    lt = " ".join(f"WHEN '{a}' THEN {_cycle(a, _PHASE_TILTS, 'lt_phase', 'lt', (1, 2, 3, 4, 5, 6))}" for a in ASSETS)
    rate = f"LEFT JOIN {home} h ON h.as_of = d.as_of" if home else ""
    fx = _FX if home or viewer else "0::DOUBLE"
    cte(f"layers{suffix}", f"""SELECT d.*, a.pos, a.asset, CASE a.asset {st} END AS st_tilt, CASE a.asset {lt} END AS lt_tilt,
  a.ry * ({_INTENSITY}) AS ry_tilt, a.hc * ({fx}) AS hc_tilt{', home_real_rate' if home else ''} FROM {decided} d CROSS JOIN assets a {rate}""")
    cte(f"tilted{suffix}", f"""SELECT d.entity, d.as_of, {viewer} a.pos, a.asset,
  (CASE a.asset {st} END) * st_confidence + (CASE a.asset {lt} END) * lt_confidence + a.ry * ({_INTENSITY}) + a.hc * ({fx}) AS tilt
  FROM {decided} d CROSS JOIN assets a {rate}""")


cte("home", "SELECT as_of, real_rate_10y AS home_real_rate FROM features WHERE entity = 'NATION_5'")
cte("viewers", "SELECT * FROM (VALUES ('SEK', 'NATION_5'), ('EUR', 'NATION_8'), ('USD', NULL), ('INR', NULL), ('BRL', NULL)) v(home_currency, home)")
cte("viewed", """SELECT d.*, v.home_currency, h.real_rate_10y AS home_real_rate FROM decided d CROSS JOIN viewers v
  LEFT JOIN features h ON h.entity = v.home AND h.as_of = d.as_of""")
_tilts("_all", "viewed", None, "d.home_currency,")
_tilts("_usd", "decided", None)
_tilts("_sek", "decided", "home")
USD = f"{decided_needs('')} assets tilted_usd"
SEK = f"{decided_needs('')} home assets tilted_sek"
_ARROW = """CASE WHEN tilt >= 1.5 THEN '↑↑↑' WHEN tilt >= 0.7 THEN '↑↑' WHEN tilt >= 0.2 THEN '↑'
  WHEN tilt <= -1.5 THEN '↓↓↓' WHEN tilt <= -0.7 THEN '↓↓' WHEN tilt <= -0.2 THEN '↓' ELSE '→' END"""

# ---- questions ---------------------------------------------------------------------------------------------

ask("history_scan", PANEL, f"SELECT date, {r6('value')} FROM panel WHERE entity = 'NATION_3' AND indicator = 'cpi_yoy'")
ask("entity_presence", PANEL, """SELECT entity, CAST(EXISTS (SELECT 1 FROM panel p WHERE p.entity = e.entity) AS INT) AS has_data
  FROM (SELECT n_name AS entity FROM nation UNION ALL SELECT r_name FROM region) e""")
ask("available_indicators", PANEL, "SELECT DISTINCT entity, indicator, CASE indicator " + " ".join(
    f"WHEN '{n}' THEN {i}" for i, n in enumerate(_ROLES)) + " END AS position FROM panel")
_CSV = """SELECT o_orderstatus AS entity, o_orderpriority AS indicator,
    CASE o_orderpriority WHEN '1-URGENT' THEN CAST(date_trunc('quarter', o_orderdate) AS DATE)
      WHEN '2-HIGH' THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN '3-MEDIUM' THEN CAST(date_trunc('year', o_orderdate) AS DATE)
      WHEN '5-LOW' THEN CASE WHEN month(o_orderdate) <= 6 THEN make_date(year(o_orderdate), month(o_orderdate) + 6, 1) END END AS date,
    o_orderpriority = '5-LOW' AND month(o_orderdate) > 6 AS fault, round(o_totalprice * 100)::DOUBLE AS v
  FROM orders WHERE o_orderstatus <> 'P'"""
ask("sdmx_csv_rows", "", f"""SELECT entity, indicator, date, count(*) FILTER (NOT fault) AS n_rows, count(*) FILTER (fault) AS n_faults,
  sum(v) FILTER (NOT fault) AS total FROM ({_CSV}) WHERE date IS NOT NULL OR fault GROUP BY 1, 2, 3""")
cte("grown_sales", """SELECT * FROM (SELECT entity, date, CASE n_regionkey WHEN 0 THEN price
      WHEN 1 THEN (price / lag(price, 12) OVER w - 1) * 100 WHEN 2 THEN (price / lag(price, 4) OVER w - 1) * 100
      WHEN 3 THEN (price / lag(price, 1) OVER w - 1) * 100 END AS v
    FROM wide JOIN nation ON n_name = entity WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE v IS NOT NULL""")
ask("provider_series", "wide grown_sales", f"""SELECT entity, 'sales' AS indicator, date, {r6('v', 'value')}, 'FRED' AS source,
  'SALES.' || entity AS series_id FROM grown_sales""")
ask("provider_series_faults", "", """SELECT n_name AS entity, 'SALES.' || n_name AS series_id, 'no yearly step for frequency D' AS error
  FROM nation WHERE n_regionkey = 4""")
ask("worldbank_json_rows", "wide", """SELECT entity, 'gini' AS indicator, make_date(year(date), 12, 31) AS date, sum(price) AS value,
  'WORLD_BANK' AS source, 'SI.POV.GINI' AS series_id, CAST(NULL AS VARCHAR) AS error
  FROM wide JOIN nation ON n_name = entity WHERE n_regionkey <> 4 AND year(date) <> 1998 GROUP BY entity, year(date)""")
ask("sdmx_xml_rows", "wide", """SELECT entity, 'sales_share' AS indicator,
  CAST(make_date(y, q * 3, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS date, v AS value, 'XML' AS source, 'G001.Q' AS series_id
  FROM (SELECT entity, year(date) AS y, quarter(date) + CASE WHEN year(date) = 2000 THEN 2 ELSE 0 END AS q, sum(price) AS v
    FROM wide WHERE year(date) < 2001 GROUP BY 1, 2, 3) WHERE q <= 4""")
cte("revisions", """SELECT entity, 'order_size' AS indicator, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  floor(o_totalprice / 150000)::DOUBLE AS value, o_orderpriority AS source, o_orderkey AS arrival, o_orderstatus AS status FROM nation_orders""")
cte("stored", "SELECT entity, indicator, date, source, max(value) AS old FROM revisions WHERE status = 'F' GROUP BY ALL")
cte("steps", """SELECT r.*, s.old, coalesce(lag(r.value) OVER (PARTITION BY r.entity, r.date, r.source ORDER BY arrival), s.old) AS previous
  FROM revisions r LEFT JOIN stored s USING (entity, indicator, date, source) WHERE status <> 'F'""")
cte("folded", """SELECT entity, indicator, date, source, arg_max(value, arrival) AS value, any_value(old) AS old,
  count(*) FILTER (previous IS NULL) AS n_new, count(*) FILTER (previous <> value) AS n_changed, count(*) FILTER (previous = value) AS n_skipped
  FROM steps GROUP BY ALL""")
REVISED = "nation_orders revisions stored steps folded"
ask("upsert_merge", REVISED, """SELECT coalesce(f.entity, s.entity) AS entity, coalesce(f.date, s.date) AS date, coalesce(f.source, s.source) AS source,
  coalesce(f.value, s.old) AS value, CASE WHEN s.entity IS NULL THEN 'S' ELSE 'OLD' END AS series_id,
  CASE WHEN f.entity IS NULL THEN 'kept' WHEN s.entity IS NULL THEN 'new' WHEN n_changed > 0 THEN 'changed' ELSE 'unchanged' END AS action,
  CAST(coalesce(n_new + n_changed, 0) AS BIGINT) AS n_inserted, CAST(coalesce(n_skipped, 0) AS BIGINT) AS n_skipped,
  CAST(coalesce(n_new, 0) AS BIGINT) AS n_new, CAST(coalesce(n_changed, 0) AS BIGINT) AS n_changed
  FROM folded f FULL JOIN stored s ON f.entity = s.entity AND f.date = s.date AND f.source = s.source""")
ask("upsert_summary", REVISED, """SELECT entity, indicator, CAST(sum(n_new + n_changed + n_skipped) AS BIGINT) AS rows,
  CAST(sum(n_new + n_changed) AS BIGINT) AS inserted, CAST(sum(n_skipped) AS BIGINT) AS skipped,
  CAST(sum(n_new) AS BIGINT) AS new, CAST(sum(n_changed) AS BIGINT) AS changed FROM folded GROUP BY 1, 2""")
cte("load_steps", """SELECT entity, source AS indicator, arrival, value, status = 'P' AND source = '5-LOW' AS broken,
  lag(value) OVER (PARTITION BY entity, source, date ORDER BY arrival) AS previous FROM revisions""")
cte("loaded", """SELECT entity, indicator, CASE WHEN NOT bool_or(broken) THEN count(*) END AS rows,
  CASE WHEN NOT bool_or(broken) THEN count(*) FILTER (previous IS DISTINCT FROM value) END AS inserted,
  CASE WHEN NOT bool_or(broken) THEN count(*) FILTER (previous = value) END AS skipped,
  CASE WHEN bool_or(broken) THEN 'period out of range: 2001-M13' END AS error FROM load_steps GROUP BY 1, 2""")
LOADED = "nation_orders revisions load_steps loaded"
ask("load_summary", LOADED, "SELECT * FROM loaded")
ask("load_end_to_end", f"{LOADED} wide grown_sales", """SELECT l.*, CASE WHEN error IS NULL THEN n_days ELSE 0 END AS stored, n_broken AS quarantined
    FROM loaded l JOIN (SELECT entity, source AS indicator, count(DISTINCT date) AS n_days, count(*) FILTER (status = 'P' AND source = '5-LOW') AS n_broken
      FROM revisions GROUP BY 1, 2) USING (entity, indicator)
  UNION ALL SELECT n_name, 'sales', CASE WHEN n_regionkey <> 4 THEN n END, CASE WHEN n_regionkey <> 4 THEN n END, CASE WHEN n_regionkey <> 4 THEN 0 END,
    CASE WHEN n_regionkey = 4 THEN 'no yearly step for frequency D' END, n, CASE WHEN n_regionkey = 4 THEN 1 ELSE 0 END
    FROM (SELECT n_name, n_regionkey, count(date) AS n FROM nation LEFT JOIN grown_sales ON entity = n_name GROUP BY ALL)
  UNION ALL SELECT n_name, 'nothing', 0, 0, 0, NULL, 0, 0 FROM nation""")
ask("load_summary_by_entity", LOADED, """SELECT entity, count(*) AS n_series, count(error) AS n_failed,
  CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows, CAST(coalesce(sum(inserted), 0) AS BIGINT) AS inserted FROM loaded GROUP BY 1""")
_AGES = f"""SELECT CAST(o_custkey AS VARCHAR) AS series_id, max(CAST(o_orderdate AS DATE)) AS latest,
  date_diff('day', max(CAST(o_orderdate AS DATE)), {TODAY}) AS age_days, arg_max(v, d) AS sample
  FROM (SELECT o_custkey, o_orderdate, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS v FROM orders)
  GROUP BY 1"""
ask("series_freshness", "", f"""SELECT s.series_id, s.transform, latest, CAST(age_days AS INT) AS age_days, sample,
  CASE WHEN latest IS NULL THEN 'EMPTY' ELSE coalesce(nullif(concat_ws('; ',
    CASE WHEN age_days > 730 THEN 'STALE >2y' WHEN age_days > 365 THEN 'stale >1y' END,
    CASE WHEN transform = 'yoy' AND (s.series_id LIKE '%657%' OR s.series_id LIKE '%659%') THEN 'BUG: 657/659 already YoY' END), ''), 'ok') END AS notes
  FROM (SELECT CAST(c_custkey AS VARCHAR) AS series_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'yoy' ELSE 'raw' END AS transform FROM customer) s
  LEFT JOIN ({_AGES}) a ON a.series_id = s.series_id""")
ask("fresh_candidates", "", f"""SELECT series_id, latest, CAST(age_days AS INT) AS age_days, sample FROM ({_AGES}) WHERE age_days < 365
  AND series_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""")
_CATALOGUE = "SELECT n_name AS entity, 'sales' AS indicator, n_nationkey AS position FROM nation UNION ALL SELECT r_name, 'sales', r_regionkey + 25 FROM region"
ask("catalogue_selection", "", f"SELECT * FROM ({_CATALOGUE}) WHERE entity IN ('NATION_3', 'NATION_7', 'REGION_1', 'NATION_24')")
ask("catalogue_entities", "", f"SELECT DISTINCT entity FROM ({_CATALOGUE})")
ask("entity_enrichment", "nation_orders", """SELECT lower(entity) AS code, 'Nation ' || n_nationkey AS name, n_regionkey AS tier,
  'N' || n_nationkey AS currency, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM nation_orders GROUP BY ALL""")
ask("code_translation", "nation_orders", """SELECT lower(entity) AS code, 'X' || n_nationkey AS provider_code, count(*) AS n_orders
  FROM nation_orders GROUP BY ALL""")
ask("store_round_trip", "nation_orders revisions", """SELECT entity, date, source, arg_max(value, (CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, arrival)) AS value
  FROM revisions WHERE date <= DATE '1999-12-31' GROUP BY 1, 2, 3""")

_GROWN = "CASE WHEN base = 0 THEN CASE WHEN value > 0 THEN 'inf'::DOUBLE WHEN value < 0 THEN '-inf'::DOUBLE END ELSE (value / base - 1) * 100 END"
ask("yoy_positional", PANEL, f"""SELECT entity, indicator, date, {r6('g', 'value')} FROM (SELECT *, {_GROWN} AS g FROM
  (SELECT *, lag(value, 12) OVER (PARTITION BY entity, indicator ORDER BY date) AS base FROM panel)) WHERE g IS NOT NULL""")
for _name in ("panel", "daily"):
    cte(f"{_name}_months", f"SELECT *, year(date) * 12 + month(date) AS m, day(date) AS d FROM {_name}")


def _year_before(months: str, keys: str) -> str:
    """Growth over a number of the month and the day in it: a table of its own, and an equality, so the join is a plain hash join."""
    on = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    return f"""(SELECT {keys}, date, {_GROWN} AS g FROM (SELECT {', '.join(f'a.{k}' for k in keys.split(', '))}, a.date, a.value, b.value AS base
  FROM {months} a JOIN {months} b ON {on} AND b.m = a.m - 12 AND b.d = a.d))"""


ask("yoy_calendar", f"{PANEL} panel_months", f"SELECT entity, indicator, date, {r6('g', 'value')} FROM {_year_before('panel_months', 'entity, indicator')} WHERE g IS NOT NULL")
ask("yoy_positional_sources", "daily", f"""SELECT entity, source, date, {r6('g', 'value')} FROM (SELECT *, {_GROWN} AS g FROM
  (SELECT *, lag(value, 12) OVER (PARTITION BY entity, source ORDER BY date) AS base FROM daily)) WHERE g IS NOT NULL""")
ask("yoy_calendar_sources", "daily daily_months", f"SELECT entity, source, date, {r6('g', 'value')} FROM {_year_before('daily_months', 'entity, source')} WHERE g IS NOT NULL")
ask("period_dates", "", """WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
  forms AS (SELECT DISTINCT unnest([year(d) || '-Q' || quarter(d), strftime(d, '%Y-M%m'), CAST(year(d) AS VARCHAR), strftime(d, '%Y/%m'),
    year(d) || '-Q' || month(d)]) AS period FROM days),
  parts AS (SELECT period, CAST(period[1:4] AS INT) AS y, TRY_CAST(period[7:] AS INT) AS k, CASE WHEN length(period) = 4 THEN 'Y' ELSE period[6:6] END AS form FROM forms)
  SELECT period, CASE WHEN form = 'Y' THEN make_date(y, 1, 1) WHEN form = 'Q' AND k <= 4 THEN make_date(y, k * 3 - 2, 1)
      WHEN form = 'M' THEN make_date(y, k, 1) END AS first_day,
    CASE WHEN form = 'Y' THEN make_date(y, 12, 31) WHEN form = 'Q' AND k <= 4 THEN last_day(make_date(y, k * 3, 1)) END AS last_day,
    CAST(form = 'Q' AND k > 4 AS INT) AS is_fault FROM parts""")
ask("derived_features", snapshot_needs(), f"SELECT entity, as_of, {', '.join(r6(n) for n in DERIVED)}, st_data_date, lt_data_date FROM features")


def _quadrant(growth: str, inflation: str) -> str:
    return (f"CASE WHEN real_gdp_yoy IS NULL OR real_gdp_yoy >= {growth} THEN 'G↑' ELSE 'G↓' END || "
            f"CASE WHEN coalesce(cpi_yoy >= {inflation}, true) THEN 'I↑' ELSE 'I↓' END")


ask("growth_inflation_quadrants", snapshot_needs(), f"""SELECT entity, as_of, {_quadrant('2', '2')} AS quadrant,
  {_quadrant('10', 'unemployment_rate')} AS own_trend_quadrant FROM features""")
ask("caution_and_yield_regimes", decided_needs(""), f"""SELECT entity, as_of, {_CAUTION} AS caution, {_REGIME} AS regime,
  round({_INTENSITY}, 6) AS intensity FROM decided""")
ask("home_currency_overlay", f"{snapshot_needs()} home", f"""SELECT f.entity, f.as_of, {r6('home_real_rate')}, {r6(_FX, 'intensity')}
  FROM features f LEFT JOIN home h ON h.as_of = f.as_of""")
ask("threshold_delta_table", f"{PANEL} own", " UNION ALL ".join(
    f"SELECT entity, '{n}' AS field, {d}::DOUBLE AS default_value, {r6(f'coalesce({n}, {d}::DOUBLE)', 'entity_value')}, "
    f"{r6(f'coalesce({n}, {d}::DOUBLE) - {d}::DOUBLE', 'delta')} FROM own" for n, d in THRESHOLDS.items()))
ask("status_bands", f"{snapshot_needs()} signal_grid", """SELECT f.entity, f.as_of,
  CASE WHEN total_credit_pct_gdp < 100 THEN 'very low' WHEN total_credit_pct_gdp < 200 THEN 'low' WHEN total_credit_pct_gdp < 250 THEN 'medium'
    WHEN total_credit_pct_gdp < 300 THEN 'high' WHEN total_credit_pct_gdp >= 300 THEN 'very high' END AS debt_band,
  CASE WHEN yield_curve_slope < 0 THEN 'inverted' WHEN yield_curve_slope < 0.5 THEN 'flat' WHEN yield_curve_slope >= 0.5 THEN 'normal' END AS curve_band,
  CASE WHEN real_rate_10y < -1 THEN 'financial repression' WHEN real_rate_10y < 0 THEN 'mildly negative' WHEN real_rate_10y >= 0 THEN 'positive' END AS real_rate_band,
  CASE WHEN z < -1.5 THEN 'unusually tight' WHEN z > 2 THEN 'unusually wide' WHEN z IS NOT NULL THEN 'normal range' END AS spread_band
  FROM features f LEFT JOIN signal_grid s ON s.entity = f.entity AND s.as_of = f.as_of""")

ask("canonical_daily", "daily canonical", f"SELECT entity, date, {r6('value')} FROM canonical")
ask("repeated_natural_keys", "", """SELECT p_brand AS entity, 'quantity' AS indicator, CAST(l_shipdate AS DATE) AS date, l_returnflag AS source, count(*) AS copies
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) > 1""")
ask("asof_latest", "daily canonical", f"""SELECT entity, 'quantity' AS indicator, {r6('arg_max(value, date)', 'value')}, max(date) AS observed_on
  FROM canonical WHERE date <= {AS_OF} GROUP BY entity""")
ask("asof_over_grid", "daily canonical", f"""SELECT c.entity, as_of, {r6('arg_max(value, date)', 'value')}, max(date) AS observed_on FROM canonical c
  JOIN (SELECT CAST(g AS DATE) AS as_of FROM (WITH RECURSIVE s(g) AS (SELECT DATE '1995-01-31' UNION ALL
    SELECT CAST(g + INTERVAL 1 MONTH AS DATE) FROM s WHERE g + INTERVAL 1 MONTH <= DATE '2001-12-31') SELECT g FROM s)) ON date <= as_of GROUP BY 1, 2""")
ask("asof_probe_join", f"{PANEL} nation_orders", f"""SELECT o_orderkey, i.indicator, CAST(o_orderdate AS DATE) AS as_of, {r6('p.value', 'value')}, p.date AS observed_on
  FROM (SELECT * FROM nation_orders CROSS JOIN (SELECT unnest({list(_ROLES)}) AS indicator)) i
  ASOF LEFT JOIN panel p ON p.entity = i.entity AND p.indicator = i.indicator AND i.o_orderdate >= p.date""")
ask("anchor_lags", "daily canonical", f"""SELECT c.entity, c.date, {r6('c.value', 'value')}, {r6('a.value', 'lag_90d')}, {r6('b.value', 'lag_180d')}, {r6('d.value', 'lag_1825d')}
  FROM (SELECT *, date - 90 AS d1, date - 180 AS d2, date - 1825 AS d3 FROM canonical) c
  ASOF LEFT JOIN canonical a ON a.entity = c.entity AND c.d1 >= a.date
  ASOF LEFT JOIN canonical b ON b.entity = c.entity AND c.d2 >= b.date
  ASOF LEFT JOIN canonical d ON d.entity = c.entity AND c.d3 >= d.date""")
_SNAP = ", ".join(r6(n) for n in (*INDICATORS, *LAGS))
ask("feature_snapshot", snapshot_needs(), f"SELECT entity, as_of, {_SNAP}, {', '.join(f'{i}_date' for i in INDICATORS)} FROM snapshot")
ask("feature_snapshot_customers", snapshot_needs("_cust"), f"SELECT entity, as_of, {_SNAP} FROM snapshot_cust")
ask("home_rates", snapshot_needs(), f"SELECT entity AS home, as_of, {r6('real_rate_10y', 'home_real_rate')} FROM features WHERE entity IN ('NATION_5', 'NATION_8')")
_MEMBERS = "AUT BEL CYP DEU ESP EST FIN FRA GRC HRV IRL ITA LTU LUX LVA MLT NLD PRT SVK SVN".split()
_MEMBER_LIST = "[" + ", ".join(f"'{m}'" for m in _MEMBERS) + "]"
_EXPANDED = f"unnest(CASE WHEN n_nationkey = 4 THEN {_MEMBER_LIST} ELSE ['N' || n_nationkey] END)"
ask("bloc_expansion", decided_needs(""), f"""SELECT {_EXPANDED} AS map_iso3, entity, as_of, lt_phase FROM decided JOIN nation ON n_name = entity""")
ask("member_to_bloc", "", f"""SELECT map_iso3, CASE WHEN list_contains({_MEMBER_LIST}, map_iso3) THEN 'EU' WHEN map_iso3 = 'N1' THEN 'US'
  WHEN map_iso3 = 'N2' THEN 'CN' END AS basket_entity FROM (SELECT {_EXPANDED} AS map_iso3 FROM nation)""")


def _quantiles(source: str, keys: str = "entity, indicator") -> str:
    fields = ", ".join(r6(f"CASE WHEN count(*) >= 40 THEN quantile_cont(value, {p}) END", f"q{round(p * 100)}") for p in (0.5, 0.75, 0.9, 0.95))
    return f"SELECT {keys}, count(*) AS n_obs, {fields} FROM {source} GROUP BY 1, 2"


ask("series_quantile_table", PANEL, _quantiles("panel"))
ask("series_quantiles_large", "", _quantiles("(SELECT l_returnflag AS entity, 'price' AS indicator, l_extendedprice AS value FROM lineitem)"))
ask("expanding_quantile_table", "daily", _quantiles("(SELECT * FROM daily JOIN (SELECT CAST(g AS DATE) AS as_of FROM "
  "generate_series(DATE '1995-03-01', DATE '2001-12-01', INTERVAL 1 MONTH) t(g)) ON date <= as_of)", "entity, as_of"))
ask("expanding_entity_thresholds", f"{PANEL} grid own_grid", f"SELECT entity, as_of, {', '.join(r6(n) for n in THRESHOLDS)} FROM own_grid")
ask("entity_thresholds", f"{PANEL} own", f"SELECT entity, {', '.join(r6(n) for n in THRESHOLDS)} FROM own")
ask("threshold_fallback", "wide_customer panel_customer own_customer10", f"""SELECT CAST(c_custkey AS VARCHAR) AS entity,
  {', '.join(r6(f'coalesce({n}, {d}::DOUBLE)', n) for n, d in THRESHOLDS.items())}
  FROM customer LEFT JOIN own_customer10 ON entity = CAST(c_custkey AS VARCHAR)""")
_NEWEST = f"arg_max(value, (date, -({_RANK})))"
ask("trailing_zscores", "daily", f"""SELECT entity, n_obs, {r6('latest')}, {r6('z')} FROM
  ({zscore('entity', f'(SELECT * FROM daily WHERE date >= {TODAY} - 730)', _NEWEST)})""")
ask("trailing_zscores_on_grid", "daily", f"""SELECT entity, as_of, n_obs, {r6('latest')}, {r6('z')} FROM
  ({zscore('entity, as_of', "(SELECT * FROM daily JOIN (SELECT CAST(g AS DATE) AS as_of FROM generate_series(DATE '1997-01-01', DATE '2001-07-01', INTERVAL 3 MONTH) t(g)) ON date <= as_of AND date >= as_of - 365)", _NEWEST)})""")
ask("gated_credit_signal", f"{PANEL} signal_today", f"""SELECT n_name AS entity, {r6('latest', 'hy_spread')}, {r6('z', 'hy_spread_z')}
  FROM nation LEFT JOIN signal_today ON entity = n_name""")
ask("series_summaries", PANEL, "SELECT entity, indicator, count(*) AS n_obs, min(date) AS first_date, max(date) AS last_date FROM panel GROUP BY 1, 2")
ask("series_changes", PANEL, f"""SELECT entity, indicator, min(date) AS first_date, max(date) AS last_date, {r6('arg_min(value, date)', 'first_value')},
  {r6('arg_max(value, date)', 'last_value')}, {r6('arg_max(value, date) - arg_min(value, date)', 'change')},
  CAST(year(max(date)) AS INT) AS last_year, CAST(quarter(max(date)) AS INT) AS last_quarter FROM panel GROUP BY 1, 2""")
ask("series_tails", "daily canonical", f"""SELECT entity, date, {r6('value')} FROM canonical
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date DESC) <= 60""")
ask("series_changes_sources", "daily", f"""SELECT entity, min(date) AS first_date, max(date) AS last_date,
  {r6(f'arg_min(value, (date, {_RANK}))', 'first_value')}, {r6(_NEWEST, 'last_value')},
  {r6(f'{_NEWEST} - arg_min(value, (date, {_RANK}))', 'change')} FROM daily GROUP BY 1""")
ask("series_tails_sources", "daily", f"""SELECT entity, date, source, {r6('value')} FROM daily
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date DESC, {_RANK}) <= 25""")
ask("display_tails", PANEL, f"""SELECT entity, indicator, date, {r6('value')} FROM panel WHERE indicator <> 'hy_spread' AND indicator <> 'private_nonfin_pct_gdp'
  QUALIFY row_number() OVER (PARTITION BY entity, indicator ORDER BY date DESC) <= CASE
    WHEN indicator IN ('policy_rate', 'yield_10y', 'yield_2y') THEN 750 WHEN indicator IN ('cpi_yoy', 'unemployment_rate') THEN 60
    WHEN indicator = 'real_gdp_yoy' THEN 24 WHEN indicator = 'debt_service_ratio' THEN 36 ELSE 80 END""")


def _fired_long(rules: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT entity, as_of, '{n}' AS rule, {k} AS cls, {n} AS weight FROM fired_rules WHERE {n} IS NOT NULL" for n, (k, _) in rules.items())


ask("short_term_votes", decided_needs("_rules"), _fired_long(SHORT_RULES))
ask("long_term_votes", decided_needs("_rules"), _fired_long(LONG_RULES))
ask("class_weights", decided_needs("_rules"), "SELECT entity, as_of, " + ", ".join(
    [r6(f"st_w{k}") for k in STAGES] + [r6(f"lt_w{k}") for k in PHASES]) + ", st_n_votes, lt_n_votes FROM weighed_rules")
ask("short_term_stage", decided_needs("_default"), f"SELECT entity, as_of, st_stage, st_label, {r6('st_confidence')}, st_n_votes FROM decided_default")
_PATH = f"SELECT entity, as_of AS date, st_stage, st_label, {r6('st_confidence')}, lt_phase, lt_label, {r6('lt_confidence')} FROM "
ask("regime_replay", decided_needs(""), _PATH + "decided")
ask("regime_replay_point_in_time", decided_needs("_pit"), _PATH + "decided_pit")
ask("regime_replay_customers", decided_needs("_custq"), _PATH + "decided_custq")
ask("regime_replay_sources", decided_needs("_src"), _PATH + "decided_src")
ask("regime_replay_sources_point_in_time", decided_needs("_srcpit"), _PATH + "decided_srcpit")
ask("feature_snapshot_sources", snapshot_needs("_src"), f"SELECT entity, as_of, {_SNAP} FROM snapshot_src")
ask("entity_view_headers_sources", decided_needs("_src"), f"""SELECT entity, as_of, st_label, lt_label, {r6('st_confidence')}, {r6('lt_confidence')},
  {_CAUTION} AS caution_level, {_REGIME} AS real_yield_regime FROM decided_src""")
ask("regime_replay_user_rules", decided_needs("") + " fired_user weighed_user short_user", f"""SELECT s.entity, s.as_of AS date, s.st_stage,
  replace(s.st_label, 'Transition', 'Unclear') AS st_label, {r6('s.st_confidence', 'st_confidence')}, d.lt_phase
  FROM short_user s JOIN decided d ON d.entity = s.entity AND d.as_of = s.as_of""")
ask("phase_path_gate", decided_needs(""), "SELECT entity, count(DISTINCT lt_phase) AS n_phases FROM decided GROUP BY 1 HAVING count(DISTINCT lt_phase) > 1")

ask("asset_tilt_table", SEK, f"SELECT entity, as_of, asset, {r6('tilt')} FROM tilted_sek")
ask("asset_tilt_table_usd", USD, f"SELECT entity, as_of, asset, {r6('tilt')}, {_ARROW} AS direction FROM tilted_usd")
_RANKED = "row_number() OVER (PARTITION BY entity, as_of ORDER BY abs(tilt) DESC, pos)"
ask("viewer_tilt_table", f"{decided_needs('')} viewers viewed assets tilted_all",
    f"SELECT entity, as_of, home_currency, asset, {r6('tilt')} FROM tilted_all")
ask("top_tilt_table", USD, f"SELECT entity, as_of, {_RANKED} AS rank, asset, {r6('tilt')} FROM tilted_usd QUALIFY rank <= 3")
ask("ranked_tilts", USD, f"SELECT entity, as_of, {_RANKED} AS rank, asset, {r6('tilt')} FROM tilted_usd")
ask("entity_view_headers", decided_needs(""), f"""SELECT entity, as_of, st_stage, st_label, {r6('st_confidence')}, lt_phase, lt_label, {r6('lt_confidence')},
  {_CAUTION} AS caution_level, {_REGIME} AS real_yield_regime, 'SEK' AS home_currency FROM decided""")
ask("world_basket", decided_needs("_one"), f"""SELECT b.entity, iso3, name, CAST(d.entity IS NOT NULL AS INT) AS has_data, coalesce(lt_phase, 0) AS lt_phase,
  coalesce(lt_label, 'No data') AS lt_label, coalesce(st_stage, 0) AS st_stage, coalesce(st_label, 'No data') AS st_label, {_CAUTION} AS caution_level,
  {r6('total_credit_pct_gdp', 'total_debt_pct_gdp')}, {r6('debt_service_ratio')}, {r6('cpi_yoy')}, {r6('real_rate_10y')}
  FROM (SELECT n_name AS entity, 'N' || n_nationkey AS iso3, 'Nation ' || n_nationkey AS name FROM nation
    UNION ALL SELECT r_name, 'R' || r_regionkey, 'Region ' || r_regionkey FROM region) b LEFT JOIN decided_one d ON d.entity = b.entity""")
ask("panel_landing", PANEL, f"SELECT entity, indicator, date, {r6('value')}, 'STAR' AS source FROM panel")

# ---- reasons in words: printf rounds the exact value, ties to even

SHORT_TEXTS = {
    "negative_growth": "printf('growth %.2f%% below zero', real_gdp_yoy)",
    "unemployment_rise": "printf('unemployment %+.2fpp in 3 months', unemployment_change_3m)",
    "curve_inverted": "printf('yield curve inverted at %.2fpp', yield_curve_slope)",
    "inflation_level": """CASE WHEN cpi_yoy > cpi_peak THEN printf('inflation %.2f%% over its peak line of %.1f%%', cpi_yoy, cpi_peak)
      WHEN policy_rate_change_6m > 0.5 THEN printf('inflation %.2f%% over %.1f%% while the policy rate moved %+.2fpp in 6 months', cpi_yoy, cpi_elevated, policy_rate_change_6m)
      ELSE printf('inflation %.2f%% over %.1f%%', cpi_yoy, cpi_elevated) END""",
    "inflation_accelerating": "printf('inflation accelerating %+.2fpp in 3 months to %.2f%%', cpi_change_3m, cpi_yoy)",
    "policy_cut": """CASE WHEN cpi_yoy < 4 THEN printf('policy rate cut %.2fpp in 6 months with inflation at %.2f%%', policy_rate_change_6m, cpi_yoy)
      ELSE printf('policy rate cut %.2fpp in 6 months', policy_rate_change_6m) END""",
    "inflation_falling": "printf('inflation easing %.2fpp in 3 months', cpi_change_3m)",
    "healthy_growth": """CASE WHEN unemployment_change_3m <= 0.1 THEN printf('growth %.2f%%, inflation %.2f%%, unemployment not rising', real_gdp_yoy, cpi_yoy)
      ELSE printf('growth %.2f%% with inflation %.2f%%', real_gdp_yoy, cpi_yoy) END""",
    "curve_steep": "printf('yield curve steep at %.2fpp', yield_curve_slope)",
}
LONG_TEXTS = {
    "low_debt": f"printf('total debt %.0f%% below 100%%', {_TC})",
    "debt_outpacing": f"CASE WHEN {_C5} > 5 THEN printf('total debt %.0f%%, %+.0fpp in 5 years', {_TC}, {_C5}) ELSE printf('total debt %.0f%% in the middle range', {_TC}) END",
    "rapid_credit": f"""CASE WHEN {_TC} >= 200 AND {_C5} > 15 THEN printf('total debt %.0f%% expanding fast, %+.0fpp in 5 years', {_TC}, {_C5})
      ELSE printf('total debt %.0f%% in the late-cycle zone from %.0f%%', {_TC}, debt_late_cycle_low) END""",
    "spread_tight": "printf('credit spread unusually tight, z %+.2f', hy_spread_z)",
    "extreme_debt": f"""CASE WHEN {_DSR} > dsr_stretched THEN printf('total debt %.0f%% at or over %.0f%%, debt service %.1f%% over %.0f%%', {_TC}, debt_extreme, {_DSR}, dsr_stretched)
      ELSE printf('total debt %.0f%% at or over %.0f%%', {_TC}, debt_extreme) END""",
    "service_burden": f"printf('debt service %.1f%% over %.0f%% on debt of %.0f%%', {_DSR}, dsr_distress, {_TC})",
    "spread_wide": "printf('credit spread unusually wide, z %+.2f', hy_spread_z)",
    "painful_deleveraging": f"printf('debt %+.0fpp in 5 years to %.0f%%, debt service %.1f%%', {_C5}, {_TC}, {_DSR})",
    "service_extreme": f"printf('debt service %.1f%% over %.0f%%', {_DSR}, dsr_extreme)",
    "financial_repression": f"printf('real rate %+.1f%% on debt of %.0f%%', real_rate_10y, {_TC})",
    "inflated_away": f"printf('debt %.0f%%, %+.0fpp in 5 years, with inflation %.1f%%', {_TC}, {_C5}, cpi_yoy)",
}


def _told(texts: dict) -> str:
    return "'[' || concat_ws(', ', " + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN {t} END" for n, t in texts.items()) + ") || ']'"


ask("vote_reasons", decided_needs(""), f"""SELECT entity, as_of, 'Short term ' || lower(st_label) || ', long term ' || lower(lt_label) || ', caution ' || ({_CAUTION}) || '.' AS summary,
  {_told(SHORT_TEXTS)} AS st_reasons, {_told(LONG_TEXTS)} AS lt_reasons FROM decided""")
ask("tilt_reasons", f"{decided_needs('')} home assets layers_sek", f"""SELECT entity, as_of, asset, concat_ws(' · ',
    CASE WHEN abs(st_tilt) > 0.01 THEN printf('short term %s at %.0f%%: %+.2f', st_label, 100 * st_confidence, st_tilt * st_confidence) END,
    CASE WHEN abs(lt_tilt) > 0.01 THEN printf('long term %s at %.0f%%: %+.2f', lt_label, 100 * lt_confidence, lt_tilt * lt_confidence) END,
    CASE WHEN abs(ry_tilt) > 0.01 THEN printf('real yield %s, %+.1f%%: %+.2f', {_REGIME}, real_rate_10y, ry_tilt) END,
    CASE WHEN abs(hc_tilt) > 0.01 THEN printf('SEK view, real rates %+.1fpp apart: %+.2f', home_real_rate - real_rate_10y, hc_tilt) END) AS reasons
  FROM layers_sek""")

# ---- by date and load time: every revision against every quarter that knew it

_LOG_NAMES = ["real_gdp_yoy", "cpi_yoy", "unemployment_rate", "policy_rate", "yield_10y", "yield_2y", "total_credit_pct_gdp", "debt_service_ratio"]
_H = "CAST(round(o_totalprice * 100) AS BIGINT)"
cte("order_log", f"""SELECT entity, ({_LOG_NAMES})[o_orderkey % 8 + 1] AS indicator, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  CASE o_orderkey % 8 WHEN 6 THEN 100::DOUBLE + ({_H} % 25000)::DOUBLE / 100::DOUBLE WHEN 7 THEN 10::DOUBLE + ({_H} % 1500)::DOUBLE / 100::DOUBLE
    ELSE ({_H} % 1000)::DOUBLE / 100::DOUBLE - 3::DOUBLE END AS value,
  o_orderdate + to_days(CAST(o_custkey % 200 AS INT)) AS fetched_at, o_orderkey AS arrival FROM nation_orders""")
cte("visible", """SELECT entity, indicator, date, as_of, arg_max(value, (fetched_at, arrival)) AS value
  FROM order_log JOIN grid ON date <= as_of AND fetched_at <= as_of GROUP BY 1, 2, 3, 4""")
cte("found_vin", "SELECT entity, indicator, as_of, max(date) AS observed_on, arg_max(value, date) AS value FROM visible GROUP BY 1, 2, 3")
cte("lagged_vin", """SELECT f.entity, f.indicator, f.as_of, f.observed_on, any_value(f.value) AS value,
  arg_max(v.value, v.date) FILTER (v.date <= f.observed_on - 90) AS lag_90, arg_max(v.value, v.date) FILTER (v.date <= f.observed_on - 180) AS lag_180,
  arg_max(v.value, v.date) FILTER (v.date <= f.observed_on - 1825) AS lag_1825
  FROM found_vin f JOIN visible v ON v.entity = f.entity AND v.indicator = f.indicator AND v.as_of = f.as_of GROUP BY 1, 2, 3, 4""")
_PICKS = [f"max(value) FILTER (indicator = '{i}') AS {i}, max(observed_on) FILTER (indicator = '{i}') AS {i}_date" for i in INDICATORS]
_PICKS += [f"max(lag_{d}) FILTER (indicator = '{i}') AS {n}" for n, (i, d) in LAGS.items()]
cte("snapshot_vin", f"""SELECT e.entity, e.as_of, {', '.join(_PICKS)} FROM ({_ALL_NATIONS.format(grid='grid')}) e
  LEFT JOIN lagged_vin f ON f.entity = e.entity AND f.as_of = e.as_of GROUP BY 1, 2""")
cte("features_vin", f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in DERIVED.items())} FROM snapshot_vin")
cte("own_vin", _thresholds("visible", 40, "entity, as_of"))
_inputs("inputs_vin", "features_vin", "own_vin", None, "", "entity as_of")
_classification("_vin", "inputs_vin")
KNOWN = "nation_orders order_log grid visible"
ask("asof_by_vintage", f"{KNOWN} found_vin lagged_vin", f"""SELECT entity, indicator, as_of, {r6('value')}, observed_on, {r6('lag_90', 'lag_90d')}, {r6('lag_1825', 'lag_1825d')}
  FROM lagged_vin""")
ask("regime_replay_vintages", f"{KNOWN} found_vin lagged_vin snapshot_vin features_vin own_vin inputs_vin fired_vin weighed_vin short_vin long_vin decided_vin",
    _PATH + "decided_vin")
ask("trailing_zscores_vintages", KNOWN, f"""SELECT entity, indicator, as_of, n_obs, {r6('latest')}, {r6('z')} FROM
  ({zscore('entity, indicator, as_of', '(SELECT * FROM visible WHERE date >= as_of - 730)', minimum=3)})""")

# ---- on timestamps

cte("events_once", """SELECT CASE WHEN user_id % 3 = 0 THEN 'HOT' ELSE event_type END AS entity, ts, arg_max(value, event_id) AS value
  FROM events GROUP BY 1, 2""")
ask("asof_hourly", "events_once", f"""SELECT g.entity, g.as_of, {r6('e.value', 'value')}, e.ts AS observed_at
  FROM (SELECT entity, h AS as_of FROM (SELECT DISTINCT entity FROM events_once),
    generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) t(h)) g
  ASOF JOIN events_once e ON e.entity = g.entity AND g.as_of >= e.ts""")
ask("asof_event_probes", "events_once", f"""SELECT p.event_id, p.ts AS as_of, {r6('e.value', 'value')}, e.ts AS observed_at
  FROM (SELECT event_id, ts, 'HOT' AS entity FROM events WHERE user_id % 3 <> 0) p ASOF LEFT JOIN events_once e ON e.entity = p.entity AND p.ts >= e.ts""")
ask("event_time_lags", "events_once", f"""SELECT p.event_id, p.entity, {r6('p.value', 'value')}, {r6('a.value', 'lag_30m')}, {r6('b.value', 'lag_6h')}
  FROM (SELECT event_id, value, CASE WHEN user_id % 3 = 0 THEN 'HOT' ELSE event_type END AS entity, ts - INTERVAL 30 MINUTE AS t1, ts - INTERVAL 6 HOUR AS t2 FROM events) p
  ASOF LEFT JOIN events_once a ON a.entity = p.entity AND p.t1 >= a.ts ASOF LEFT JOIN events_once b ON b.entity = p.entity AND p.t2 >= b.ts""")

# ---- entities of three columns

cte("keyed_months", f"""SELECT entity AS nation, p_brand AS brand, l_returnflag AS flag, {_MONTH} AS date, count(*)::DOUBLE AS n,
  sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE AS d, sum(CAST(round(l_tax * 100) AS BIGINT))::DOUBLE AS t, sum(CAST(round(l_quantity * 100) AS BIGINT))::DOUBLE AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN nation_orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""")
cte("keyed", " UNION ALL ".join(f"SELECT nation, brand, flag, date, '{i}' AS indicator, {c} / n AS value FROM keyed_months"
                                for i, c in (("cpi_yoy", "d"), ("policy_rate", "t"), ("total_credit_pct_gdp", "q"))))
_KEY = "nation, brand, flag"
KEYED = "nation_orders keyed_months keyed"
cte("keyed_found", f"""SELECT {_KEY}, indicator, as_of, max(date) AS observed_on, arg_max(value, date) AS value
  FROM keyed JOIN (VALUES ({AS_OF}), ({TODAY})) g(as_of) ON date <= as_of GROUP BY 1, 2, 3, 4, 5""")
_SAME = " AND ".join(f"b.{k} = a.{k}" for k in ("nation", "brand", "flag", "indicator"))
cte("keyed_lagged", f"""SELECT a.*, b.value AS lag_90, c.value AS lag_180, d.value AS lag_1825
  FROM (SELECT *, observed_on - 90 AS d1, observed_on - 180 AS d2, observed_on - 1825 AS d3 FROM keyed_found) a
  ASOF LEFT JOIN keyed b ON {_SAME} AND a.d1 >= b.date ASOF LEFT JOIN keyed c ON {_SAME.replace('b.', 'c.')} AND a.d2 >= c.date
  ASOF LEFT JOIN keyed d ON {_SAME.replace('b.', 'd.')} AND a.d3 >= d.date""")
_THREE = ("cpi_yoy", "policy_rate", "total_credit_pct_gdp")
ask("keyed_snapshot", f"{KEYED} keyed_found keyed_lagged", f"SELECT {_KEY}, as_of, " + ", ".join(
    [r6(f"max(value) FILTER (indicator = '{i}')", i) for i in _THREE]
    + [r6(f"max(lag_{d}) FILTER (indicator = '{i}')", n) for n, (i, d) in LAGS.items() if i in _THREE])
    + ", max(observed_on) FILTER (indicator = 'cpi_yoy') AS cpi_yoy_date FROM keyed_lagged GROUP BY 1, 2, 3, 4")
ask("keyed_latest", f"{KEYED} keyed_found", f"SELECT {_KEY}, indicator, {r6('value')}, observed_on FROM keyed_found WHERE as_of = {AS_OF}")
ask("keyed_probe_join", KEYED, f"""SELECT l_orderkey, l_linenumber, a.nation, a.brand, a.flag, as_of, {r6('b.value', 'value')}, b.date AS observed_on
  FROM (SELECT l_orderkey, l_linenumber, entity AS nation, p_brand AS brand, l_returnflag AS flag, 'policy_rate' AS indicator, CAST(l_shipdate AS DATE) AS as_of
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN nation_orders ON l_orderkey = o_orderkey) a
  ASOF LEFT JOIN keyed b ON {_SAME} AND a.as_of >= b.date""")
ask("keyed_lags", KEYED, f"""SELECT a.nation, a.brand, a.flag, a.indicator, a.date, {r6('a.value', 'value')}, {r6('b.value', 'lag_90d')}, {r6('c.value', 'lag_365d')}
  FROM (SELECT *, date - 90 AS d1, date - 365 AS d2 FROM keyed) a ASOF LEFT JOIN keyed b ON {_SAME} AND a.d1 >= b.date
  ASOF LEFT JOIN keyed c ON {_SAME.replace('b.', 'c.')} AND a.d2 >= c.date""")
ask("keyed_quantiles", KEYED, _quantiles("keyed", f"{_KEY}, indicator").replace(">= 40", ">= 5").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3, 4"))
ask("bucketed_snapshot", snapshot_needs("_cust"), f"SELECT entity, as_of, {_SNAP} FROM snapshot_cust")
