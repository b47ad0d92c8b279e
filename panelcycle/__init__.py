"""Regime analytics over entity x indicator panels, written as Spark DataFrame jobs."""

from panelcycle.schema import OBSERVATION_SCHEMA, PANEL, PanelColumns

__all__ = ["OBSERVATION_SCHEMA", "PANEL", "PanelColumns"]
