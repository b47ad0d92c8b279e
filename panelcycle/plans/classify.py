"""Classify entities at one or many dates: snapshot, thresholds, rules, decision.

One wide row per entity and date feeds both cycles, so joining their results needs no join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.catalog.entities import SIGNAL_ENTITIES
from panelcycle.operators.rules import LONG_TERM, SHORT_TERM, RuleSet
from panelcycle.operators.signals import credit_signal
from panelcycle.operators.snapshot import feature_snapshots, with_derived_features
from panelcycle.operators.thresholds import calibrated_thresholds, expanding_thresholds, with_thresholds
from panelcycle.operators.votes import cast_votes, decide
from panelcycle.schema import PANEL, PanelColumns

SIGNAL_COLUMNS = ("hy_spread", "hy_spread_z")


def classify_short_term(features: DataFrame, cycle: RuleSet = SHORT_TERM, with_reasons: bool = True) -> DataFrame:
    """Add ``st_stage``, ``st_label``, ``st_confidence``, ``st_votes`` and the class weights."""
    voted = cast_votes(features, cycle.rules, "st", with_reasons)
    return decide(voted, cycle.classes, cycle.labels, "st", "st_stage", "st_label", "st_confidence")


def classify_long_term(features: DataFrame, cycle: RuleSet = LONG_TERM, with_reasons: bool = True) -> DataFrame:
    """Add ``lt_phase``, ``lt_label``, ``lt_confidence``, ``lt_votes`` and the class weights."""
    voted = cast_votes(features, cycle.rules, "lt", with_reasons)
    return decide(voted, cycle.classes, cycle.labels, "lt", "lt_phase", "lt_label", "lt_confidence")


def attach_signal(snapshots: DataFrame, signal: DataFrame | None, on: Sequence[str]) -> DataFrame:
    """Add the credit-signal columns, NULL where there is no signal."""
    if signal is None:
        return snapshots.withColumns({c: F.lit(None).cast("double") for c in SIGNAL_COLUMNS})
    return snapshots.join(signal, list(on), "left")


def classify(
    panel: DataFrame,
    grid: Sequence[dt.date],
    today: dt.date | None = None,
    entities: DataFrame | None = None,
    thresholds: DataFrame | Mapping[str, float] | str | None = "calibrated",
    signal_asof: str = "today",
    signal_entities: Sequence[str] = SIGNAL_ENTITIES,
    priority: Sequence[str] = (),
    one_row_per_day: bool = False,
    with_reasons: bool = True,
    short_term: RuleSet = SHORT_TERM,
    long_term: RuleSet = LONG_TERM,
    every_date: bool = False,
    known_by: Sequence[dt.date | dt.datetime] | None = None,
    colocated: bool = False,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """Both classifications of every entity on every grid date.

    ``thresholds``: ``"calibrated"`` derives them from each entity's full history, ``"expanding"``
    from its history up to each date; a frame or a mapping is used as given; None means the defaults.
    ``signal_asof``: ``"today"`` gives every date the score as of ``today`` (default: last grid date), ``"as_of"`` the score of that date,
    ``"none"`` no signal. ``short_term`` and ``long_term`` are the rule sets. ``every_date``, ``known_by`` and
    ``colocated``: see ``feature_snapshots``. A log of revisions (``known_by``) has no full history and no score of
    today, so it takes expanding or given thresholds and the score of each date or none. Series never cross an
    entity, so the job scales with entities.
    """
    if known_by is not None and (thresholds == "calibrated" or signal_asof == "today"):
        raise ValueError("with known_by, thresholds must be 'expanding' or given and signal_asof 'as_of' or 'none'")
    snapshots = feature_snapshots(
        panel, grid, entities, priority=priority, one_row_per_day=one_row_per_day, every_date=every_date, known_by=known_by,
        colocated=colocated, cols=cols
    )
    if signal_asof == "today":
        signal = credit_signal(panel, today or grid[-1], enabled=signal_entities, priority=priority, cols=cols)
        on = cols.entity_key
    elif signal_asof == "as_of":
        signal = credit_signal(panel, grid=grid, enabled=signal_entities, priority=priority, known_by=known_by, cols=cols)
        on = [*cols.entity_key, "as_of"]
    elif signal_asof == "none":
        signal, on = None, []
    else:
        raise ValueError(f"signal_asof must be 'today', 'as_of' or 'none', not {signal_asof!r}")
    threshold_keys = tuple(cols.entity_key)
    # one row per day bounds a series by the calendar, so the series need not be counted
    limit = {"large_series_rows": None} if one_row_per_day else {}
    if isinstance(thresholds, str):
        if thresholds == "calibrated":
            thresholds = calibrated_thresholds(panel, **limit, cols=cols)
        elif thresholds == "expanding":
            thresholds = expanding_thresholds(panel, grid, **limit, known_by=known_by, cols=cols)
            threshold_keys = (*cols.entity_key, "as_of")
        else:
            raise ValueError(f"thresholds must be 'calibrated' or 'expanding' when a word, not {thresholds!r}")
    features = with_thresholds(
        with_derived_features(attach_signal(snapshots, signal, on)), thresholds, threshold_keys
    )
    return classify_long_term(classify_short_term(features, short_term, with_reasons), long_term, with_reasons)
