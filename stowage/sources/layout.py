"""Where things lie in a snapshot.

    <prefix>/project=P/dataset=D/archive_ts=YYYYMMDDHHMMSS/dataset.json
       tables/table=T/{part-*.json, data/*}
       views/view=V/part-*.json            ... and so on for every kind of object

The tree follows Spark's partition naming, so one read over the prefix sees project, dataset
and archive_ts as columns and prunes on them.
"""

from __future__ import annotations

import datetime

# Sub-directory and partition key of each kind of object.
KIND_DIRECTORIES = {
    "table": ("tables", "table"),
    "view": ("views", "view"),
    "materialized_view": ("materialized_views", "view"),
    "function": ("functions", "function"),
    "stored_procedure": ("stored_procedures", "stored_procedure"),
    "external_table": ("external_tables", "external_table"),
}
MANIFEST = "dataset.json"
COMMITS = "commits"


def format_archive_ts(moment: datetime.datetime | None = None) -> str:
    """``YYYYMMDDHHMMSS`` in UTC; now if no moment is given."""
    moment = moment or datetime.datetime.now(datetime.timezone.utc)
    if moment.tzinfo is not None:
        moment = moment.astimezone(datetime.timezone.utc)
    return moment.strftime("%Y%m%d%H%M%S")


def snapshot_path(prefix: str, project: str, dataset: str, archive_ts: str) -> str:
    return f"{prefix.rstrip('/')}/project={project}/dataset={dataset}/archive_ts={archive_ts}"


def prefix_of(snapshot: str) -> str:
    """The prefix a snapshot path lies under."""
    head, found, _ = snapshot.rstrip("/").rpartition("/project=")
    if not found:
        raise ValueError(f"not a snapshot path: {snapshot}")
    return head


def address_of(snapshot: str) -> tuple[str, str]:
    """Project and dataset of a snapshot path."""
    parts = dict(p.partition("=")[::2] for p in snapshot.rstrip("/").split("/") if "=" in p)
    return parts["project"], parts["dataset"]


def data_path(table: str) -> str:
    """Data directory of a table, relative to its snapshot, so that a snapshot may be moved."""
    directory, key = KIND_DIRECTORIES["table"]
    return f"{directory}/{key}={table}/data"
