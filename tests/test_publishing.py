"""Published versions and derived label versions."""

import pytest
from pyspark.sql import functions as F

from hubbub.operators import publishing as p


def test_a_failed_panel_leaves_the_old_version_readable(spark, tmp_path):
    root, good = f"file://{tmp_path}", spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    with pytest.raises(ValueError):
        p.current_manifest(spark, root)
    p.publish({"one": good, "two": good.where("id = 1")}, root, "v1")
    broken = good.withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        p.publish({"one": good.where("id = 2"), "two": broken}, root, "v2")
    assert p.published_versions(spark, root) == ["v1"] and p.read_panel(spark, root, "one").count() == 2
    p.publish({"one": good.where("id = 2"), "two": good.limit(0)}, root, "v2")
    assert [tuple(r) for r in p.read_panel(spark, root, "one").collect()] == [(2, None)] and p.read_panel(spark, root, "two").count() == 0
    assert {(r.panel, r.rows, r.columns, r.version) for r in p.current_manifest(spark, root).collect()} == {("one", 1, 2, "v2"), ("two", 0, 2, "v2")}
    with pytest.raises(ValueError):
        p.publish({"one": good}, root, "v2")
    with pytest.raises(ValueError):
        p.read_panel(spark, root, "three")
    good.write.mode("append").parquet(f"{root}/panels/v2/one")
    with pytest.raises(ValueError):
        p.read_panel(spark, root, "one")


def test_a_derived_version_is_written_beside_its_source(spark, tmp_path):
    path = f"file://{tmp_path}/labels"
    rows = [
        (1, True, True, True, "t", ["a", "b"], [], ["rules"]), (2, True, True, True, "t", ["c"], ["old"], None), (3, None, True, None, None, ["a"], None, []), (4, True, False, False, None, [], [], []),
    ]
    p.write_version(spark.createDataFrame(rows, p.LABEL), path, "v2")
    checked = spark.createDataFrame([(1, "a", None), (1, "b", "not_in_text"), (2, "c", "not_in_text"), (3, "a", None), (9, "z", None)], "post_id long, entity string, fault string")

    def derive():
        before = p.read_version(spark, path, "v2")
        p.write_version(p.derived_labels(before, checked, "v2"), path, "v3")
        return before, p.read_version(spark, path, "v3")

    for _ in range(2):  # a rerun changes nothing
        before, after = derive()
        got = {r.post_id: tuple(r)[1:] for r in after.collect()}
        assert got == {
            1: (True, True, True, None, ["a"], ["b"], ["rules", "v2"]), 2: (True, False, False, None, [], ["old", "c"], ["v2"]), 3: (None, True, False, None, ["a"], [], ["v2"]), 4: (True, False, False, None, [], [], ["v2"]),
        }
        assert tuple(p.derivation_counts(before, after).first()) == (4, 1, 2, 1) and before.count() == 4
