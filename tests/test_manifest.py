from pyspark.sql import functions as F

from stowage.plans.archive import archive_dataset, snapshot_of
from stowage.sources import manifest


def test_commit_index(spark, database, tmp_path):
    prefix = str(tmp_path / "archive")
    assert manifest.commits(spark, prefix).count() == 0
    spark.range(3).write.saveAsTable(f"{database}.t")
    first, second = (snapshot_of(archive_dataset(spark, database, prefix, archive_ts=f"2024010{i}000000")) for i in (1, 2))
    rows = {(r.dataset, r.archive_ts, r.metadata_version, r.object_count) for r in manifest.commits(spark, prefix).collect()}
    count = manifest.read_manifest(spark, first).count()
    assert rows == {(database, f"2024010{i}000000", "v1", count) for i in (1, 2)}
    for stamp, change in (("20240103000000", {"object_count": F.lit(99)}), ("20240104000000", {"metadata_version": F.lit("v9")})):
        spark.read.json(f"{second}/dataset.json").withColumns(change).write.json(f"{second.replace('20240102000000', stamp)}/dataset.json")
    # The short one is not committed; the other one is, and this version cannot read it.
    assert manifest.rebuild_commits(spark, prefix) == 1 and manifest.rebuild_commits(spark, prefix) == 0
    newest = manifest.newest_snapshots(spark, prefix).collect()
    assert [(r.dataset, r.archive_ts, r.object_count) for r in newest] == [(database, "20240102000000", count)]
    assert [r.archive_ts for r in manifest.latest_snapshots(manifest.read_manifests(spark, prefix)).collect()] == ["20240102000000"]
