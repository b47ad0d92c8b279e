"""The entity basket, provider codes, currency homes and bloc membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, iso3, name, tier, central bank, currency, BIS code, World Bank code.
ENTITY_ROWS: tuple[tuple[str, str, str, int, str, str, str, str], ...] = (
    ("US", "USA", "United States", 1, "Federal Reserve", "USD", "US", "USA"),
    ("CN", "CHN", "China", 1, "People's Bank of China", "CNY", "CN", "CHN"),
    ("EU", "EMU", "Eurozone", 1, "European Central Bank", "EUR", "XM", "EMU"),
    ("UK", "GBR", "United Kingdom", 1, "Bank of England", "GBP", "GB", "GBR"),
    ("JP", "JPN", "Japan", 1, "Bank of Japan", "JPY", "JP", "JPN"),
    ("SE", "SWE", "Sweden", 1, "Riksbank", "SEK", "SE", "SWE"),
    ("IN", "IND", "India", 2, "Reserve Bank of India", "INR", "IN", "IND"),
    ("BR", "BRA", "Brazil", 2, "Banco Central do Brasil", "BRL", "BR", "BRA"),
)
ENTITY_SCHEMA = (
    "entity string, iso3 string, name string, tier int, central_bank string, "
    "currency string, bis_code string, wb_code string"
)

# The home entity whose real rate stands for a currency.
HOME_ENTITY_BY_CURRENCY: dict[str, str] = {
    "USD": "US", "SEK": "SE", "EUR": "EU", "GBP": "UK", "JPY": "JP", "CNY": "CN",
}

# Members of the euro bloc, sorted by code.
BLOC_MEMBERS: dict[str, tuple[str, ...]] = {
    "EMU": (
        "AUT", "BEL", "CYP", "DEU", "ESP", "EST", "FIN", "FRA", "GRC", "HRV",
        "IRL", "ITA", "LTU", "LUX", "LVA", "MLT", "NLD", "PRT", "SVK", "SVN",
    ),
}

# Entities for which the credit-spread signal is published.
SIGNAL_ENTITIES: tuple[str, ...] = ("US",)


def entity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTITY_ROWS), ENTITY_SCHEMA)


def iso3_to_entity() -> dict[str, str]:
    """Map-code lookup: every basket iso3 except the bloc's own code, plus the bloc's members."""
    lookup = {row[1]: row[0] for row in ENTITY_ROWS if row[1] not in BLOC_MEMBERS}
    by_iso3 = {row[1]: row[0] for row in ENTITY_ROWS}
    for bloc, members in BLOC_MEMBERS.items():
        lookup.update({member: by_iso3[bloc] for member in members})
    return lookup
