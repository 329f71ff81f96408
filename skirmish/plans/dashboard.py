"""The tables behind the run and boss pages, each built once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skirmish import fixed
from skirmish.operators.runs import assign_runs, encounter_summary
from skirmish.session import cut


def encounter_table(events: DataFrame, gap_minutes: int = fixed.RUN_GAP_MINUTES) -> DataFrame:
    """Encounters with run_id, kept as a table.

    Numbering the runs reads the encounters twice and every run query reads the
    result several times; the events are read once.
    """
    return cut(assign_runs(cut(encounter_summary(events)), gap_minutes))
