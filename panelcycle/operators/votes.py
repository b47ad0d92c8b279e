"""From fired rules to a class with a confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.operators.rules import Rule

# A lead smaller than this is a transition; the confidence denominator's floor.
TRANSITION_MARGIN = 0.3
CONFIDENCE_FLOOR = 1.0


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def votes_array(rules: Sequence[Rule], prefix: str) -> str:
    """The fired votes in rule order, from the ``<prefix>_w_<rule>`` weight columns."""
    slots = ", ".join(
        f"CASE WHEN {prefix}_w_{r.name} IS NOT NULL THEN "
        f"named_struct('cls', {r.cls}, 'weight', {prefix}_w_{r.name}, 'reason', {r.reason}) END"
        for r in rules
    )
    return f"array_compact(array({slots}))"


def class_weight(rules: Sequence[Rule], cls: int, prefix: str) -> str:
    """Sum of one class's weights, added one by one in rule order.

    The transition margin sits on differences such as 0.7 - 0.4, where the order of double
    additions decides, so this is a fixed expression and not an aggregate over exploded votes.
    """
    return " + ".join(["0D", *[f"coalesce({prefix}_w_{r.name}, 0D)" for r in rules if r.cls == cls]])


def cast_votes(features: DataFrame, rules: Sequence[Rule], prefix: str, with_reasons: bool = True,
               keep_rules: bool = False) -> DataFrame:
    """Evaluate the rules once; add ``<prefix>_w<class>``, ``<prefix>_n_votes`` and ``<prefix>_votes``."""
    weighed = features.selectExpr("*", *[f"{r.weight} AS {prefix}_w_{r.name}" for r in rules])
    fired = " + ".join(f"int({prefix}_w_{r.name} IS NOT NULL)" for r in rules)
    added = [f"{class_weight(rules, cls, prefix)} AS {prefix}_w{cls}" for cls in sorted({r.cls for r in rules})]
    added.append(f"{fired} AS {prefix}_n_votes")
    if with_reasons:
        added.append(f"{votes_array(rules, prefix)} AS {prefix}_votes")
    voted = weighed.selectExpr("*", *added)
    return voted if keep_rules else voted.drop(*[f"{prefix}_w_{r.name}" for r in rules])


def long_votes(voted: DataFrame, rules: Sequence[Rule], prefix: str, keys: Sequence[str]) -> DataFrame:
    """One row per fired rule: keys, rule, position in voting order, class and weight."""
    slots = ", ".join(
        f"named_struct('position', {i}, 'rule', '{r.name}', 'cls', {r.cls}, 'weight', {prefix}_w_{r.name})"
        for i, r in enumerate(rules)
    )
    return voted.selectExpr(*keys, f"inline_outer(array({slots}))").where(F.col("weight").isNotNull())


def decide(voted: DataFrame, classes: Sequence[int], labels: Mapping[int, str], prefix: str,
           class_column: str, label_column: str, confidence_column: str) -> DataFrame:
    """Top class, or class 0 when the runner-up is too close, with label and confidence.

    Ties go to the lower class id, for the top and for the runner-up: the first class that has
    the largest weight. With so few classes, comparing columns beats sorting an array per row.
    """
    classes = sorted(classes)
    w = {k: f"{prefix}_w{k}" for k in classes}
    total = " + ".join(w.values())
    names = "map(" + ", ".join(f"{k}, {quoted(v)}" for k, v in labels.items()) + ")"
    none = f"{prefix}_n_votes = 0"
    torn = f"_top_w - _second_w < {TRANSITION_MARGIN}D AND _second_w > 0D"

    def largest(values: list[str]) -> str:
        return f"greatest({', '.join(values)})" if len(values) > 1 else values[0]

    def first_with(value: str, skip: str = "") -> str:
        return "CASE " + " ".join(f"WHEN {w[k]} = {value}{skip.format(k=k)} THEN {k}" for k in classes) + " END"

    # a rule set with a single class has no runner-up: its weight is NULL, so nothing is torn
    rest = [f"CASE WHEN _top <> {k} THEN {w[k]} END" for k in classes]
    ranked = (
        voted.selectExpr("*", f"{largest(list(w.values()))} AS _top_w", f"{total} AS _total")
        .selectExpr("*", f"{first_with('_top_w')} AS _top")
        .selectExpr("*", f"{largest(rest)} AS _second_w")
        .selectExpr("*", f"{first_with('_second_w', ' AND _top <> {k}')} AS _second", f"coalesce({torn}, false) AS _torn")
    )
    return ranked.selectExpr(
        "*",
        f"CASE WHEN {none} OR _torn THEN 0 ELSE _top END AS {class_column}",
        f"CASE WHEN {none} THEN {quoted(labels[0] + ' (insufficient data)')} "
        f"WHEN _torn THEN concat({quoted(labels[0] + ' (')}, {names}[_top], ' ↔ ', {names}[_second], ')') "
        f"ELSE {names}[_top] END AS {label_column}",
        f"CASE WHEN {none} THEN 0D ELSE _top_w / (_total + {CONFIDENCE_FLOOR}D) END AS {confidence_column}",
    ).drop("_top", "_top_w", "_second", "_second_w", "_total", "_torn")
