"""Weighted rules of the two cycles, as SQL expressions over a feature row.

A rule is a class, a weight that is NULL while the rule does not fire, and a reason. A comparison
with a missing input is NULL and ``CASE`` treats NULL as "not fired", so missing data never casts
a vote unless a rule says so. Weights are doubles (``D``), not decimals. A rule set is an ordered
list with the labels of its classes; users may pass their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from panelcycle.catalog.tilts import PHASE_LABELS, STAGE_LABELS
from panelcycle.functions.text import worded


@dataclass(frozen=True)
class Rule:
    name: str
    cls: int
    weight: str
    reason: str


@dataclass(frozen=True)
class RuleSet:
    """One cycle: its rules in voting order and a label per class, 0 standing for a transition."""

    rules: Sequence[Rule]
    labels: Mapping[int, str]

    @property
    def classes(self) -> tuple[int, ...]:
        return tuple(sorted({r.cls for r in self.rules}))

    @property
    def voting_order(self) -> tuple[int, ...]:
        """The classes in the order in which they first vote, which is that of a blend's sums."""
        return tuple(dict.fromkeys(r.cls for r in self.rules))


def case(*steps: tuple[str, float]) -> str:
    """First matching step's weight as a double, NULL when none matches."""
    whens = " ".join(f"WHEN {condition} THEN {float(weight)}D" for condition, weight in steps)
    return f"CASE {whens} END"


def text(template: str, *values: str) -> str:
    return worded(template, *values)


def either(condition: str, then: str, otherwise: str) -> str:
    """One of two texts; an unknown condition takes the second."""
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


# Feature columns of the short cycle.
_GROWTH, _CPI, _SLOPE = "real_gdp_yoy", "cpi_yoy", "yield_curve_slope"
_JOBLESS, _CPI_CHANGE, _RATE_CHANGE = "unemployment_change_3m", "cpi_change_3m", "policy_rate_change_6m"

_HOT = "cpi_yoy > cpi_elevated"
_STRONG_CUT = "policy_rate_change_6m < -0.5D"
_MODERATE_CUT = "policy_rate_change_6m >= -0.5D AND policy_rate_change_6m < -0.25D"
_HEALTHY = "real_gdp_yoy > 1.5D AND cpi_yoy < 3D"

# Expansion 1, inflationary peak 2, recession 3, reflation 4; in voting order.
SHORT_TERM_RULES: tuple[Rule, ...] = (
    Rule("negative_growth", 3, case((f"{_GROWTH} < 0D", 1.0)), text("growth %.2f%% below zero", _GROWTH)),
    Rule("unemployment_rise", 3, case((f"{_JOBLESS} > 0.5D", 1.0), (f"{_JOBLESS} > 0.3D", 0.5)),
         text("unemployment %+.2fpp in 3 months", _JOBLESS)),
    Rule("curve_inverted", 3, case((f"{_SLOPE} < 0D", 0.4)), text("yield curve inverted at %.2fpp", _SLOPE)),
    Rule("inflation_level", 2,
         case(("cpi_yoy > cpi_peak", 1.0), (f"{_HOT} AND {_RATE_CHANGE} > 0.5D", 0.9), (_HOT, 0.5)),
         either("cpi_yoy > cpi_peak", text("inflation %.2f%% over its peak line of %.1f%%", _CPI, "cpi_peak"),
                either(f"{_RATE_CHANGE} > 0.5D",
                       text("inflation %.2f%% over %.1f%% while the policy rate moved %+.2fpp in 6 months",
                            _CPI, "cpi_elevated", _RATE_CHANGE),
                       text("inflation %.2f%% over %.1f%%", _CPI, "cpi_elevated")))),
    Rule("inflation_accelerating", 2,
         case((f"{_CPI_CHANGE} > 0.5D AND cpi_yoy > greatest(cpi_elevated - 0.5D, 2.0D)", 0.4)),
         text("inflation accelerating %+.2fpp in 3 months to %.2f%%", _CPI_CHANGE, _CPI)),
    Rule("policy_cut", 4,
         case((f"{_STRONG_CUT} AND cpi_yoy < 4D", 1.0), (_STRONG_CUT, 0.6),
              (f"{_MODERATE_CUT} AND cpi_yoy < 4D", 0.6), (_MODERATE_CUT, 0.4)),
         either("cpi_yoy < 4D", text("policy rate cut %.2fpp in 6 months with inflation at %.2f%%", _RATE_CHANGE, _CPI),
                text("policy rate cut %.2fpp in 6 months", _RATE_CHANGE))),
    Rule("inflation_falling", 4, case((f"{_CPI_CHANGE} < -0.3D", 0.4)),
         text("inflation easing %.2fpp in 3 months", _CPI_CHANGE)),
    # an unknown change in unemployment does not contradict an expansion
    Rule("healthy_growth", 1,
         case((f"{_HEALTHY} AND {_JOBLESS} <= 0.1D", 1.0),
              (f"{_HEALTHY} AND NOT coalesce({_JOBLESS} > 0.3D, false)", 0.6)),
         either(f"{_JOBLESS} <= 0.1D", text("growth %.2f%%, inflation %.2f%%, unemployment not rising", _GROWTH, _CPI),
                text("growth %.2f%% with inflation %.2f%%", _GROWTH, _CPI))),
    Rule("curve_steep", 1, case((f"{_SLOPE} > 1D", 0.3)), text("yield curve steep at %.2fpp", _SLOPE)),
)

# Feature columns of the long cycle.
_DEBT, _DEBT_CHANGE, _SERVICE = "total_credit_pct_gdp", "total_credit_5y_change_pp", "debt_service_ratio"
_REAL, _SPREAD_Z = "real_rate_10y", "hy_spread_z"

_MIDDLE = f"{_DEBT} >= 100D AND {_DEBT} < 200D"
_SHRINKING = f"{_DEBT_CHANGE} < -10D AND {_DEBT} > 150D"
_REPRESSED = f"{_REAL} < -1D AND {_DEBT} > 150D"

# Debt-cycle phases 1 to 6 in voting order; phase 7 is never voted for.
LONG_TERM_RULES: tuple[Rule, ...] = (
    Rule("low_debt", 1, case((f"{_DEBT} < 100D", 1.0)), text("total debt %.0f%% below 100%%", _DEBT)),
    Rule("debt_outpacing", 2, case((f"{_MIDDLE} AND {_DEBT_CHANGE} > 5D", 1.0), (_MIDDLE, 0.4)),
         either(f"{_DEBT_CHANGE} > 5D", text("total debt %.0f%%, %+.0fpp in 5 years", _DEBT, _DEBT_CHANGE),
                text("total debt %.0f%% in the middle range", _DEBT))),
    Rule("rapid_credit", 3,
         case((f"{_DEBT} >= 200D AND {_DEBT} < debt_extreme AND {_DEBT_CHANGE} > 15D", 1.0),
              (f"{_DEBT} >= debt_late_cycle_low AND {_DEBT} < debt_extreme", 0.5)),
         either(f"{_DEBT} >= 200D AND {_DEBT_CHANGE} > 15D",
                text("total debt %.0f%% expanding fast, %+.0fpp in 5 years", _DEBT, _DEBT_CHANGE),
                text("total debt %.0f%% in the late-cycle zone from %.0f%%", _DEBT, "debt_late_cycle_low"))),
    Rule("spread_tight", 3, case((f"{_SPREAD_Z} < -1.5D", 0.5)),
         text("credit spread unusually tight, z %+.2f", _SPREAD_Z)),
    Rule("extreme_debt", 4,
         case((f"{_DEBT} >= debt_extreme AND {_SERVICE} > dsr_stretched", 0.8), (f"{_DEBT} >= debt_extreme", 0.6)),
         either(f"{_SERVICE} > dsr_stretched",
                text("total debt %.0f%% at or over %.0f%%, debt service %.1f%% over %.0f%%",
                     _DEBT, "debt_extreme", _SERVICE, "dsr_stretched"),
                text("total debt %.0f%% at or over %.0f%%", _DEBT, "debt_extreme"))),
    Rule("service_burden", 4, case((f"{_SERVICE} > dsr_distress AND {_DEBT} > debt_late_cycle_low", 0.7)),
         text("debt service %.1f%% over %.0f%% on debt of %.0f%%", _SERVICE, "dsr_distress", _DEBT)),
    Rule("spread_wide", 4, case((f"{_SPREAD_Z} > 2.0D", 0.4)),
         text("credit spread unusually wide, z %+.2f", _SPREAD_Z)),
    Rule("painful_deleveraging", 5,
         case((f"{_SHRINKING} AND {_SERVICE} > dsr_distress AND cpi_yoy < cpi_elevated", 1.0)),
         text("debt %+.0fpp in 5 years to %.0f%%, debt service %.1f%%", _DEBT_CHANGE, _DEBT, _SERVICE)),
    Rule("service_extreme", 5, case((f"{_SERVICE} > dsr_extreme", 0.7)),
         text("debt service %.1f%% over %.0f%%", _SERVICE, "dsr_extreme")),
    Rule("financial_repression", 6, case((f"{_REPRESSED} AND {_REAL} < -2D", 1.0), (_REPRESSED, 0.7)),
         text("real rate %+.1f%% on debt of %.0f%%", _REAL, _DEBT)),
    Rule("inflated_away", 6, case((f"{_SHRINKING} AND cpi_yoy > cpi_elevated", 0.7)),
         text("debt %.0f%%, %+.0fpp in 5 years, with inflation %.1f%%", _DEBT, _DEBT_CHANGE, _CPI)),
)

SHORT_TERM = RuleSet(SHORT_TERM_RULES, STAGE_LABELS)
LONG_TERM = RuleSet(LONG_TERM_RULES, PHASE_LABELS)
