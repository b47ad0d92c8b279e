"""Class labels and asset tilt tables."""

from __future__ import annotations

# Labels by class id.
STAGE_LABELS: dict[int, str] = {
    0: "Transition",
    1: "Expansion",
    2: "Inflationary peak",
    3: "Recession",
    4: "Reflation",
}

PHASE_LABELS: dict[int, str] = {
    0: "Transition",
    1: "Sound money",
    2: "Debt outpaces income",
    3: "Bubble",
    4: "Top — peak debt service",
    5: "Deleveraging",
    6: "Reflation / financial repression",
    7: "Reset",
}

# The eight asset classes in display order, with their labels.
ASSET_LABELS: dict[str, str] = {
    "equities": "Equities (broad market)",
    "long_bonds": "Long-duration govt bonds (10y+)",
    "short_bonds": "Short-duration govt bonds (1–3y) / cash equivalents",
    "credit": "Investment-grade corporate bonds",
    "tips": "Inflation-linked bonds (TIPS)",
    "gold": "Gold",
    "commodities": "Broad commodities",
    "real_estate": "Real estate / REITs",
}
ASSETS: tuple[str, ...] = tuple(ASSET_LABELS)

# Growth x inflation quadrants and their tilts.
GROWTH_UP_INFLATION_DOWN = "G↑I↓"
GROWTH_UP_INFLATION_UP = "G↑I↑"
GROWTH_DOWN_INFLATION_DOWN = "G↓I↓"
GROWTH_DOWN_INFLATION_UP = "G↓I↑"
REFLATION_HYBRID = "G↓→↑ I↓"

QUADRANT_TILTS: dict[str, dict[str, float]] = {
    GROWTH_UP_INFLATION_DOWN: {
        "equities": 1.0, "credit": 0.5, "real_estate": 0.5,
        "long_bonds": -0.3, "gold": -0.3, "commodities": -0.2,
    },
    GROWTH_UP_INFLATION_UP: {
        "commodities": 1.0, "gold": 0.7, "tips": 1.0, "real_estate": 0.3,
        "long_bonds": -1.2, "credit": -0.5, "equities": -0.3,
    },
    GROWTH_DOWN_INFLATION_DOWN: {
        "long_bonds": 1.2, "short_bonds": 0.5, "gold": 0.3,
        "equities": -1.0, "credit": -1.0, "commodities": -0.8, "real_estate": -0.5,
    },
    GROWTH_DOWN_INFLATION_UP: {
        "gold": 1.2, "commodities": 1.0, "tips": 1.0, "short_bonds": 0.5, "real_estate": 0.3,
        "long_bonds": -1.7, "credit": -1.0, "equities": -0.7,
    },
    REFLATION_HYBRID: {
        "equities": 0.5, "gold": 0.7, "tips": 0.5, "real_estate": 0.3,
        "credit": 0.3, "short_bonds": -0.3,
    },
}

# The quadrant of each stage.
STAGE_QUADRANTS: dict[int, str] = {
    1: GROWTH_UP_INFLATION_DOWN,
    2: GROWTH_UP_INFLATION_UP,
    3: GROWTH_DOWN_INFLATION_DOWN,
    4: REFLATION_HYBRID,
}

SHORT_TERM_TILTS: dict[int, dict[str, float]] = {
    stage: QUADRANT_TILTS[quadrant] for stage, quadrant in STAGE_QUADRANTS.items()
}

# Tilts by long-term phase. Phases not listed are neutral.
LONG_TERM_TILTS: dict[int, dict[str, float]] = {
    3: {"gold": 0.5, "short_bonds": 0.3, "equities": -0.3, "credit": -0.3},
    4: {
        "gold": 1.0, "short_bonds": 0.7, "tips": 0.3,
        "equities": -0.7, "credit": -0.7, "real_estate": -0.3, "long_bonds": -0.3,
    },
    5: {
        "long_bonds": 1.5, "short_bonds": 1.0, "gold": 0.7,
        "credit": -1.5, "equities": -1.0, "real_estate": -1.2, "commodities": -0.5,
    },
    6: {
        "gold": 1.2, "tips": 1.2, "real_estate": 0.7, "commodities": 0.5, "equities": 0.3,
        "long_bonds": -1.2, "short_bonds": -0.5,
    },
}

# Overlay strengths at full intensity.
REAL_YIELD_TILTS: dict[str, float] = {
    "gold": 0.4, "commodities": 0.3, "real_estate": 0.2, "long_bonds": -0.4,
}
HOME_CURRENCY_TILTS: dict[str, float] = {
    "gold": -0.3, "equities": -0.15, "long_bonds": -0.2, "commodities": -0.15,
}

# Caution level by long-term phase, anything else is moderate.
CAUTION_BY_PHASE: dict[int, str] = {
    0: "moderate", 1: "low", 2: "low", 3: "moderate",
    4: "elevated", 5: "high", 6: "elevated", 7: "high",
}
DEFAULT_CAUTION = "moderate"

# Status bands as (metric, lower bound, upper bound, label); a value on an
# edge belongs to the band that names it as lower bound unless upper_closed says otherwise.
STATUS_BANDS: tuple[tuple[str, float | None, float | None, str], ...] = (
    ("total_debt", None, 100.0, "very low"),
    ("total_debt", 100.0, 200.0, "low"),
    ("total_debt", 200.0, 250.0, "medium"),
    ("total_debt", 250.0, 300.0, "high"),
    ("total_debt", 300.0, None, "very high"),
    ("yield_curve", None, 0.0, "inverted"),
    ("yield_curve", 0.0, 0.5, "flat"),
    ("yield_curve", 0.5, None, "normal"),
    ("real_rate", None, -1.0, "financial repression"),
    ("real_rate", -1.0, 0.0, "mildly negative"),
    ("real_rate", 0.0, None, "positive"),
    ("credit_spread_z", None, -1.5, "unusually tight"),
    ("credit_spread_z", -1.5, 2.0, "normal range"),
    ("credit_spread_z", 2.0, None, "unusually wide"),
)
# Bands whose upper bound belongs to them (z of exactly 2 is still normal).
UPPER_CLOSED_BANDS: frozenset[tuple[str, str]] = frozenset({("credit_spread_z", "normal range")})
