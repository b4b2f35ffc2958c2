"""Queries that once left rows out."""

from veraframe.plans import catalog
from veraframe.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def test_gap_tracker_links_all_detections(spark):
    key = ("video_id", "frame_index", "det_key")
    got = catalog.QUERIES["j11_gap_tracker"](spark, SF).select(*key).collect()
    assert sorted(got) == sorted(view(spark, SF, "faces").select(*key).collect())
