"""Series specifications: which provider series feeds which (entity, indicator)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcycle.catalog.entities import ENTITY_ROWS

# Indicator, provider series id, entity, frequency, transform.
TIER_1_SERIES: tuple[tuple[str, str, str, str, str], ...] = (
    ("policy_rate", "DFF", "US", "D", "raw"),
    ("cpi_yoy", "CPIAUCSL", "US", "M", "yoy"),
    ("unemployment_rate", "UNRATE", "US", "M", "raw"),
    ("yield_10y", "DGS10", "US", "D", "raw"),
    ("yield_2y", "DGS2", "US", "D", "raw"),
    ("real_gdp_yoy", "GDPC1", "US", "Q", "yoy"),
    ("policy_rate", "IRSTCI01CNM156N", "CN", "M", "raw"),
    ("cpi_yoy", "CHNCPIALLMINMEI", "CN", "M", "yoy"),
    ("unemployment_rate", "LMUNRRTTCNQ156S", "CN", "Q", "raw"),
    ("real_gdp_yoy", "NAEXKP01CNA657S", "CN", "A", "raw"),
    ("policy_rate", "ECBDFR", "EU", "D", "raw"),
    ("cpi_yoy", "CP0000EZ19M086NEST", "EU", "M", "yoy"),
    ("unemployment_rate", "LRHUTTTTEZM156S", "EU", "M", "raw"),
    ("yield_10y", "IRLTLT01EZM156N", "EU", "M", "raw"),
    ("real_gdp_yoy", "CLVMNACSCAB1GQEA19", "EU", "Q", "yoy"),
    ("policy_rate", "IRSTCI01GBM156N", "UK", "M", "raw"),
    ("cpi_yoy", "GBRCPIALLMINMEI", "UK", "M", "yoy"),
    ("unemployment_rate", "LRHUTTTTGBM156S", "UK", "M", "raw"),
    ("yield_10y", "IRLTLT01GBM156N", "UK", "M", "raw"),
    ("real_gdp_yoy", "NGDPRSAXDCGBQ", "UK", "Q", "yoy"),
    ("policy_rate", "IRSTCI01JPM156N", "JP", "M", "raw"),
    ("unemployment_rate", "LRUN64TTJPM156S", "JP", "M", "raw"),
    ("yield_10y", "IRLTLT01JPM156N", "JP", "M", "raw"),
    ("real_gdp_yoy", "JPNRGDPEXP", "JP", "Q", "yoy"),
    ("policy_rate", "IR3TIB01SEM156N", "SE", "M", "raw"),
    ("cpi_yoy", "SWECPIALLMINMEI", "SE", "M", "yoy"),
    ("unemployment_rate", "LRHUTTTTSEM156S", "SE", "M", "raw"),
    ("yield_10y", "IRLTLT01SEM156N", "SE", "M", "raw"),
    ("real_gdp_yoy", "CLVMNACSCAB1GQSE", "SE", "Q", "yoy"),
)
TIER_2_SERIES: tuple[tuple[str, str, str, str, str], ...] = (
    ("policy_rate", "INTDSRINM193N", "IN", "M", "raw"),
    ("cpi_yoy", "INDCPIALLMINMEI", "IN", "M", "yoy"),
    ("unemployment_rate", "SLUEM1524ZSIND", "IN", "A", "raw"),
    ("real_gdp_yoy", "NAEXKP01INA657S", "IN", "A", "raw"),
    ("policy_rate", "INTDSRBRM193N", "BR", "M", "raw"),
    ("cpi_yoy", "BRACPIALLMINMEI", "BR", "M", "yoy"),
    ("real_gdp_yoy", "NAEXKP01BRQ652S", "BR", "Q", "yoy"),
)
SIGNAL_SERIES: tuple[tuple[str, str, str, str, str], ...] = (
    ("hy_spread", "BAMLH0A0HYM2", "US", "D", "raw"),
)

# Sector code of each debt indicator, and the dataset names.
CREDIT_SECTORS: dict[str, str] = {
    "total_credit_pct_gdp": "C",
    "gov_debt_pct_gdp": "G",
    "private_nonfin_pct_gdp": "P",
    "hh_debt_pct_gdp": "H",
    "corp_debt_pct_gdp": "N",
}
CREDIT_DATASET, CREDIT_SOURCE = "WS_TC", "BIS_TC"
SERVICE_DATASET, SERVICE_SOURCE = "WS_DSR", "BIS_DSR"

SERIES_SCHEMA = "indicator string, series_id string, entity string, frequency string, transform string, position int"
DEBT_SCHEMA = "entity string, indicator string, dataset string, source string, series_id string, position int"


def series_specs(spark: SparkSession) -> DataFrame:
    """All provider series as one dimension; ``position`` keeps the catalogue order."""
    rows = TIER_1_SERIES + TIER_2_SERIES + SIGNAL_SERIES
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], SERIES_SCHEMA)


def debt_specs(spark: SparkSession) -> DataFrame:
    """Debt and debt-service series: five sectors and one service ratio for every entity."""
    rows: list[tuple] = []
    for entity, _, _, _, _, _, bis_code, _ in ENTITY_ROWS:
        for indicator, sector in CREDIT_SECTORS.items():
            key = f"Q.{bis_code}.{sector}.A.M.770.A"
            rows.append((entity, indicator, CREDIT_DATASET, CREDIT_SOURCE, key))
    for entity, _, _, _, _, _, bis_code, _ in ENTITY_ROWS:
        rows.append((entity, "debt_service_ratio", SERVICE_DATASET, SERVICE_SOURCE, f"Q.{bis_code}.P"))
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], DEBT_SCHEMA)


def select_specs(specs: DataFrame, entities: Iterable[str] | None = None) -> DataFrame:
    """Keep the specs of the given entity codes, any case; None keeps all."""
    if entities is None:
        return specs
    return specs.where(F.col("entity").isin([code.upper() for code in entities]))
