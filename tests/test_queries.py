"""Registered queries against DuckDB on the smallest tables; SILTMARK_ALL=1 runs every one at sf0.01."""

import os
import re

import pytest

import oracle_check
import registry

registry.load_all()
EVERY = os.environ.get("SILTMARK_ALL") == "1"
SF = "/root/testdata/sf0.01" if EVERY else "/root/testdata/sf0.001"
SOME = [
    "search_best_scene_per_side", "search_cloud_cap", "one_frame_per_pass", "nearest_scene_outside_window",
    "strip_circle_cover", "strip_best_pair", "strip_stereo_mates", "radar_pair_bracket", "change_detection_plan",
    "corrupt_scenes_dropped", "change_layers", "cloud_vote_mask", "window_sum_and_mean", "speckle_median", "edge_padded_mean",
    "detector_log_ratio", "evidence_percentile_rank", "fuse_mean", "merge_strongest_signed", "blob_labels",
    "radar_layover_mask", "dem_zonal_volume", "polygon_cells_by_centre", "volume_from_outlines", "ledger_find",
    "ledger_newest_by_side", "strip_json_to_rows", "manifest_radar_rows", "key_scrub_in_text", "tone_hdr",
    "strip_triage", "strip_stereo_mate_ids", "rule_variant_table", "fusion_scores",
    "ledger_ingest_in_two_passes", "score_table_rewrites_one_event", "keys_of_one_host_removed", "known_key_hidden_however_spelled",
    "swath_incidence_at_point", "footprint_best_partner", "fill_summary",
]


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ALL) if EVERY else SOME)
def test_query_matches_sql(spark, con, name):
    ok, msg = oracle_check.compare(spark, con, name, registry.ALL[name], registry.SQL.get(name), SF)
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_names_are_plain():
    for name in registry.ALL:
        assert "pipeline" not in name and not re.match(r"op\d+_", name)


def test_events_of_variant_maps_are_semi_joined(spark):
    from registry.measure import variant_maps
    plan = variant_maps(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 4
