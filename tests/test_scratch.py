"""Where queries may write."""

from __future__ import annotations

import pytest

from aneroid.scratch import drop_scratch, folder_for, scratch_path, stored


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_only_a_local_master_has_a_folder_of_its_own(master):
    assert folder_for(master, None) == folder_for(master, None)
    assert folder_for(master, "file:/shared/") == "file:/shared"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]", ""])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError):
        folder_for(master, None)
    assert folder_for(master, "hdfs://host/shared") == "hdfs://host/shared"


def test_a_cluster_refuses_a_folder_of_each_machine():
    with pytest.raises(ValueError):
        folder_for("yarn", "file:///tmp/x")
    assert folder_for("local-cluster[2,1,1024]", "file:///tmp/x") == "file:///tmp/x"


def test_what_was_written_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("aneroid.scratch.shared_folder", lambda _: str(tmp_path))
    assert scratch_path(spark, "x").startswith(str(tmp_path)) and scratch_path(spark, "x") != scratch_path(spark, "x")
    assert stored(spark.range(5), "five").count() == 5
    assert drop_scratch(spark) and not list(tmp_path.iterdir())
    assert not drop_scratch(spark)
