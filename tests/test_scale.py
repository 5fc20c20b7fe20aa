"""What the plans move, on the smallest driver tables: shuffles and broadcasts that grow with data."""

import os
import re

import pytest
from plan_helpers import plan_text

from workloads import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


def physical(spark, name):
    return plan_text(queries.REGISTRY[name](spark, SF_DIR)).split("== Physical Plan ==")[-1]


def below(text, node):
    """The lines under each line of the plan that holds `node`."""
    lines = text.splitlines()
    depth = [len(re.match(r"[\s:+\-|*]*(\(\d+\) )?", line).group()) for line in lines]
    found = []
    for at, line in enumerate(lines):
        if node in line:
            end = next((k for k in range(at + 1, len(lines)) if depth[k] <= depth[at]), len(lines))
            found.append("\n".join(lines[at + 1 : end]))
    return found


def test_the_observation_grid_is_not_broadcast(spark):
    text = physical(spark, "q_valid_obs")
    assert "explode(__periods" in text
    assert not any("explode(__periods" in part for part in below(text, "BroadcastExchange"))


def shuffles(text):
    """Shuffles that the plan makes, without those of broadcasts and of the summaries below them."""
    inner = "\n".join(below(text, "BroadcastExchange"))
    found = [x for x in text.splitlines() if "Exchange " in x and "BroadcastExchange" not in x and x not in inner]
    return [re.search(r"Exchange (.*?), \d+\)|Exchange (\w+)", x).group() for x in found]


def test_pixels_join_their_scores_where_their_scenes_were_dealt(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("q_link_cloud", "q_prepare_optical"):
            found = shuffles(physical(spark, name))
            assert len(found) == 2 and all("hashpartitioning(scene_id" in x for x in found), found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_resampling_shuffles_no_targets(spark):
    found = shuffles(physical(spark, "q_optical_resampled"))
    assert len(found) == 1 and "hashpartitioning(scene_id" in found[0], found


def test_zones_are_summed_where_their_cells_are(spark):
    text = physical(spark, "q_zonal_stats")
    found = [x for x in shuffles(text) if "period_start" in x]
    # Only moments are shuffled by period: pixels go by patch, and no state of eight days does.
    assert found and all("geom_id" in x for x in found), found
    assert any("hashpartitioning(patch_x" in x for x in shuffles(text))


def test_zones_of_one_patch_are_not_shuffled(spark):
    text = physical(spark, "q_zonal_stats")
    moved = [[x for x in shuffles(part) if "period_start" in x] for part in below(text, "FullOuter")]
    # One way for zones that are whole in their patch, another one whose moments are merged.
    assert sorted(len(found) for found in moved) == [0, 2], moved


def test_unfolded_pixels_are_composed_where_their_rows_were_dealt(spark):
    for name in ("q_zonal_stats", "q_local_stats"):
        dealt = below(physical(spark, name), "Exchange hashpartitioning(patch_x")
        # Items are dealt by patch before they unfold; their pixels are not dealt again.
        assert any("l_extendedprice" in part for part in dealt)
        assert not any("l_extendedprice" in part and "explode(" in part for part in dealt)


def test_needed_cells_meet_the_pixels_without_a_shuffle(spark):
    lines = physical(spark, "q_export_select").splitlines()
    assert not [x for x in lines if "LeftSemi" in x and "period_start" in x]
    met = [x for x in lines if "Join [period_start" in x and "patch_x" in x]
    assert met and all("BroadcastHashJoin" in x for x in met), met


def test_observations_unfold_where_their_sites_were_dealt(spark):
    text = physical(spark, "q_availability")
    assert "explode(__periods" in text
    assert not any("explode(__periods" in part for part in below(text, "Exchange"))


def test_zones_are_dealt_once_by_patch_and_once_by_geometry(spark):
    for name in ("q_availability", "q_scene_dates"):
        found = [x for x in shuffles(physical(spark, name)) if "patch_x" in x or "period_start" in x]
        # The stand-in's ET table is grouped by period before it is read.
        found = [x for x in found if "_groupingexpression" not in x and "l_suppkey" not in x]
        assert len(found) == 2 and all(re.search(r"\(patch_x#\w+, patch_y#\w+, \d+\)$", x) for x in found), found
