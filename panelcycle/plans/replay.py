"""Replay both classifiers over a date grid, all entities and dates in one job."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.plans.classify import classify
from panelcycle.schema import PANEL, PanelColumns

# Months per step; an unknown step counts as a quarter.
STEP_MONTHS: dict[str, int] = {"M": 1, "Q": 3, "Y": 12}
CALIBRATIONS = {"full": "calibrated", "expanding": "expanding"}
REPLAY_COLUMNS = ("st_stage", "st_label", "st_confidence", "lt_phase", "lt_label", "lt_confidence")


def date_grid(start: dt.date, end: dt.date, step: str = "Q") -> list[dt.date]:
    """Dates from start to end, each a step after the previous one.

    A day lost at a short month stays lost: Jan 31, Apr 30, Jul 30, Oct 30.
    """
    months = STEP_MONTHS.get(step.upper(), STEP_MONTHS["Q"])
    dates = []
    at = start
    while at <= end:
        dates.append(at)
        year, month = divmod(at.year * 12 + at.month - 1 + months, 12)
        at = dt.date(year, month + 1, min(at.day, calendar.monthrange(year, month + 1)[1]))
    return dates


def replay(
    panel: DataFrame,
    start: dt.date,
    end: dt.date,
    step: str = "Q",
    today: dt.date | None = None,
    entities: DataFrame | None = None,
    calibration: str = "full",
    signal_asof: str = "today",
    publication_lag_days: int = 0,
    cols: PanelColumns = PANEL,
    **options,
) -> DataFrame:
    """One row per entity and grid date: stage, phase, labels and confidences.

    By default thresholds see the full history and the credit signal is today's, as documented
    in the README; ``calibration="expanding"``, ``signal_asof="as_of"`` and
    ``publication_lag_days`` make a replay see only what was known. Every entity has a row on
    every date: those listed in ``entities``, else those of the panel; without data it says so.
    With ``known_by`` (``"as_of"``, or one load time per date) the panel is a log of revisions and
    every date sees the values that were loaded by then, not those they were revised to later.
    """
    grid = date_grid(start, end, step)
    if not grid:
        raise ValueError("the replay's end lies before its start")
    if calibration not in CALIBRATIONS:
        raise ValueError(f"calibration must be one of {sorted(CALIBRATIONS)}, not {calibration!r}")
    options = {"thresholds": CALIBRATIONS[calibration], "every_date": True, **options}
    if isinstance(options.get("known_by"), str):
        if options["known_by"] != "as_of":
            raise ValueError(f"known_by must be 'as_of' when a word, not {options['known_by']!r}")
        options["known_by"] = grid
    if publication_lag_days:
        panel = panel.withColumn(cols.date, F.date_add(cols.date, publication_lag_days))
    classified = classify(panel, grid, today, entities, signal_asof=signal_asof, with_reasons=False, cols=cols, **options)
    return classified.select(*cols.entity_key, F.col("as_of").alias("date"), *REPLAY_COLUMNS)


def entities_with_a_path(replayed: DataFrame, entity: str = PANEL.entity) -> DataFrame:
    """Entities whose long-term phase takes more than one value over the replay."""
    return (
        replayed.groupBy(entity)
        .agg(F.countDistinct("lt_phase").alias("n_phases"))
        .where(F.col("n_phases") > 1)
    )
