"""Parsers on landed payloads."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcycle.catalog.series import debt_specs, select_specs, series_specs
from panelcycle.functions.periods import period_end, period_error, period_start
from panelcycle.sources.provider_series import faulty_specs, land_series
from panelcycle.sources.sdmx_csv import load_sdmx_csv, parse_sdmx, series_id_of
from panelcycle.sources.sdmx_xml import parse_sdmx_xml, read_sdmx_xml
from panelcycle.sources.worldbank import parse_worldbank_json, read_worldbank_json
from tests.conftest import months

CREDIT = """FREQ,BORROWERS_CTY,TC_BORROWERS,TC_LENDERS,VALUATION,UNIT_TYPE,TC_ADJUST,TIME_PERIOD,OBS_VALUE
Q,US,C,A,M,770,A,2025-Q1,139.1
Q,US,C,A,M,770,A,2025-Q2,140.4
Q,US,C,A,M,770,A,2024-Q4,
"""


@pytest.mark.parametrize(
    "period, start, end, fault",
    [
        ("2025-Q2", dt.date(2025, 4, 1), dt.date(2025, 6, 30), False),
        ("2025-Q4", dt.date(2025, 10, 1), dt.date(2025, 12, 31), False),
        ("2025-M03", dt.date(2025, 3, 1), None, False),
        ("2025-M3", dt.date(2025, 3, 1), None, False),
        ("2025", dt.date(2025, 1, 1), dt.date(2025, 12, 31), False),
        ("2025-Q5", None, None, True),
        ("2025-Qx", None, None, True),
        ("2025-M13", None, None, True),
        ("0000", None, None, True),
        ("20250", None, None, True),
        ("2025/03", None, None, False),
        ("", None, None, False),
        (None, None, None, False),
    ],
)
def test_periods(spark, period, start, end, fault):
    row = spark.createDataFrame([(period,)], "p string").select(
        period_start(F.col("p")).alias("s"), period_end(F.col("p")).alias("e"),
        period_error(F.col("p")).isNotNull().alias("f"),
    ).first()
    assert (row.s, row.e, row.f) == (start, end, fault)


def test_csv_file_takes_its_stamp_from_the_spec(spark, tmp_path):
    (tmp_path / "Q.US.C.A.M.770.A.csv").write_text(CREDIT)
    rows = load_sdmx_csv(spark, str(tmp_path), debt_specs(spark)).orderBy("date").collect()
    assert [(r.entity, r.indicator, r.date, r.value, r.source, r.error) for r in rows] == [
        ("US", "total_credit_pct_gdp", dt.date(2025, 1, 1), 139.1, "BIS_TC", None),
        ("US", "total_credit_pct_gdp", dt.date(2025, 4, 1), 140.4, "BIS_TC", None),
    ]


def test_csv_of_plain_years_keeps_its_rows(spark, tmp_path):
    (tmp_path / "Q.SE.P.csv").write_text("FREQ,TIME_PERIOD,OBS_VALUE\nA,2023,10\nA,2024,11\n")
    rows = load_sdmx_csv(spark, str(tmp_path), debt_specs(spark)).orderBy("date").collect()
    assert [(r.date.year, r.value, r.indicator) for r in rows] == [(2023, 10.0, "debt_service_ratio"), (2024, 11.0, "debt_service_ratio")]


def test_csv_with_header_only_or_without_required_columns_is_empty(spark, tmp_path):
    (tmp_path / "Q.US.P.csv").write_text("FREQ,TIME_PERIOD,OBS_VALUE\n")
    assert load_sdmx_csv(spark, str(tmp_path), debt_specs(spark)).count() == 0
    odd = spark.createDataFrame([("US", "x", "S", "I", "1")], "entity string, indicator string, source string, series_id string, OTHER string")
    empty = parse_sdmx(odd)
    assert empty.count() == 0 and empty.columns == ["entity", "indicator", "date", "value", "source", "series_id", "error"]


def test_csv_reports_bad_numbers_and_periods(spark):
    raw = spark.createDataFrame(
        [("2025-Q1", "abc"), ("2025-Q9", "1"), ("2025-Q2", "NaN"), ("x", "1"), ("2025-Q3", "1")], "TIME_PERIOD string, OBS_VALUE string"
    )
    parsed = parse_sdmx(raw, F.lit("US"), F.lit("i"), F.lit("s"), F.lit("id")).collect()
    assert sorted(str(r.error) for r in parsed) == ["None", "not a number: abc", "period out of range: 2025-Q9"]


def test_series_id_is_the_last_segment_cut_to_64(spark):
    url = "https://host/api/data/WS_TC/" + "K" * 80 + "?format=csv"
    assert spark.range(1).select(series_id_of(F.lit(url)).alias("s")).first().s == "K" * 64


def test_worldbank_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '[{"page":1},[{"date":"2021","value":39.7},{"date":"2020","value":null},{"date":"2019","value":41},{"date":"2018","value":41.4}]]'
    )
    payloads = read_worldbank_json(spark, str(tmp_path)).withColumn("entity", F.lit("US"))
    rows = parse_worldbank_json(payloads).orderBy("date").collect()
    assert [(r.date, r.value, r.indicator, r.source, r.error) for r in rows] == [
        (dt.date(y, 12, 31), v, "gini", "WORLD_BANK", None) for y, v in ((2018, 41.4), (2019, 41.0), (2021, 39.7))
    ]


@pytest.mark.parametrize(
    "payload, errors",
    [('[{"message":[{"id":"120"}]}]', []), ('[{"page":1},[]]', []), ('{"a":1}', []), ("<html>", ["payload is not JSON"]),
     ('[{},[{"date":"20x","value":1}]]', ["not a year: 20x"])],
)
def test_worldbank_other_shapes(spark, payload, errors):
    rows = parse_worldbank_json(spark.createDataFrame([("US", payload)], "entity string, payload string")).collect()
    assert [r.error for r in rows] == errors


def test_reserve_share_xml_is_read_in_pieces(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<Series A="1">\n<Obs TIME_PERIOD="2025-Q4" OBS_VALUE="56.77"/>\n<Obs TIME_PERIOD="2000-Q1"  OBS_VALUE="70.797"/>'
        '<Obs TIME_PERIOD="2001-M02" OBS_VALUE="1"/><Obs TIME_PERIOD="2001-Q2" OBS_VALUE="n/a"/>'
        '<Obs OBS_VALUE="3" TIME_PERIOD="2002-Q1"/><Obs TIME_PERIOD="2024" OBS_VALUE="58"/></Series>'
    )
    rows = parse_sdmx_xml(read_sdmx_xml(spark, str(tmp_path))).orderBy("date").collect()
    assert [(r.date, r.value) for r in rows] == [
        (dt.date(2000, 3, 31), 70.797), (dt.date(2024, 12, 31), 58.0), (dt.date(2025, 12, 31), 56.77)
    ]
    assert {(r.entity, r.indicator, r.source) for r in rows} == {("WLD", "cofer_usd_share", "IMF_COFER")}


def _specs(spark, *rows):
    return spark.createDataFrame(list(rows), "series_id string, entity string, indicator string, frequency string, transform string")


def test_raw_series_drops_missing_values(spark):
    raw = spark.createDataFrame([("S", d, v) for d, v in zip(months("2025-01-01", 3), (1.0, float("nan"), 3.0))], "series_id string, date date, value double")
    rows = land_series(raw, _specs(spark, ("S", "US", "policy_rate", "D", "raw"))).orderBy("date").collect()
    assert [r.value for r in rows] == [1.0, 3.0]


def test_yearly_growth_of_a_monthly_series(spark):
    raw = spark.createDataFrame([("S", d, 100.0 if i < 12 else 110.0) for i, d in enumerate(months("2024-01-01", 13))], "series_id string, date date, value double")
    rows = land_series(raw, _specs(spark, ("S", "US", "cpi_yoy", "M", "yoy"))).collect()
    assert len(rows) == 1 and rows[0].value == pytest.approx(10.0) and rows[0].date == dt.date(2025, 1, 1)


def test_impossible_specs_are_reported(spark):
    specs = _specs(spark, ("A", "US", "x", "D", "yoy"), ("B", "US", "y", "M", "bogus"), ("C", "US", "z", "D", "raw"))
    assert {r.series_id for r in faulty_specs(specs).collect()} == {"A", "B"}
    assert land_series(spark.createDataFrame([("A", dt.date(2025, 1, 1), 1.0)], "series_id string, date date, value double"), specs).count() == 0


def test_catalogue_selection(spark):
    specs = series_specs(spark)
    assert specs.count() == 37
    assert select_specs(specs, ["us"]).where("indicator = 'hy_spread'").count() == 1
    assert {r.entity for r in select_specs(specs, ["se", "Jp"]).collect()} == {"SE", "JP"}
    assert debt_specs(spark).count() == 48
    assert debt_specs(spark).where("series_id = 'Q.XM.H.A.M.770.A'").first().indicator == "hh_debt_pct_gdp"
