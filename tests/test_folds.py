"""The exact folds of all alarms come from a narrow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import DATA
from towerlens.catalog import base, evaluation


def test_folds_read_two_columns(spark, monkeypatch):
    seen = []
    real = evaluation.split.exact_folds
    monkeypatch.setattr(evaluation.split, "exact_folds", lambda df, *a, **k: seen.append(df) or real(df, *a, **k))
    assert evaluation.k9_exact(spark, DATA).agg(F.sum("n")).first()[0] == base.alarms(spark, DATA).count()
    assert seen[0].columns == ["is_cell_unavailable", "log_serial_number"] and seen[0].inputFiles()
