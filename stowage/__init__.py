"""Snapshot, restore, relocate and verify whole Spark databases."""

from stowage.operators.checks import Check, run_checks
from stowage.plans.archive import archive_dataset, snapshot_of
from stowage.plans.restore import restore_dataset

__all__ = ["Check", "archive_dataset", "restore_dataset", "run_checks", "snapshot_of"]
