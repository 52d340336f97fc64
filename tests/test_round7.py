"""Changes of many items by one row of a unit."""

from itertools import groupby

from workgraph.operators import registry


def test_changes_of_one_row_stand_together(spark, monkeypatch):
    log = [("w", "u", "", 2 * k, "ST"[k % 2], f"a{k % 3}") for k in range(40)] + [("w", "", "i7", 11, "X", "b"), ("w", "u", "i9", 21, "Y", "c"), ("w", "", "i7", 31, "S", "b")]
    log = spark.createDataFrame(log, "workflow_id string, unit_id string, target_id string, seq long, status string, actor string")
    items = spark.createDataFrame([(f"i{i}", "u") for i in range(300)] + [("i7", "v"), ("alone", None)], "id string, unit_id string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        found = [tuple(r) for r in registry.status_changes(log, items).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(found) == 298 * 40 + (6 + 2) + 2 + (11 + 1)  # i7 has its target's rows from 11 on, also in v, and i9 its own from 21 on
    # files of them hold runs: a run for each row and block of its unit, not a row for each item
    assert len(list(groupby(found, lambda r: (r[1], r[3])))) <= 43 * registry.SALTS < len(found) / 10
    monkeypatch.setattr(registry, "BLOCK", 7)  # 43 blocks for 16
    assert sorted(map(str, registry.status_changes(log, items).collect())) == sorted(str(r) for r in spark.createDataFrame(found, registry.status_changes(log, items).schema).collect())
