"""Shapes of physical plans: what reaches the scan, what shuffles, what never appears."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from nitrogrid.operators import grid as G
from nitrogrid.registry import grids, observations, preparation, scoring
from nitrogrid.registry import views as V
from nitrogrid.session import shared_dir, work_path
from tests.conftest import plan_text

SF = "/root/testdata/sf0.001"
RUN_FREE = [
    name for m in contract.MODULES if m.__name__.startswith("nitrogrid.registry.") for name in m.QUERIES
    if not name.startswith(("csv_", "stream_", "model_", "forest_", "scenario_c", "scenario_s", "scenario_w"))
    and name not in {"cross_validation", "bulk_score", "saved_model_scores"}
]


@pytest.mark.parametrize("name", RUN_FREE)
def test_no_cross_join_and_no_python(spark, name):
    text = plan_text(contract.queries()[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in text, f"{name}: {word}"


@pytest.mark.parametrize("query", [
    grids.flatten_grid, grids.flatten_steps, grids.flatten_bbox, grids.flatten_tiles, grids.flatten_lenient,
    observations.temporal_features_orders, observations.expected_field_orders, observations.hotspot_influence_events,
    observations.model_features_orders, preparation.split_three_way, scoring.score_requests, scoring.score_json,
    observations.drop_missing_rows,
])
def test_row_wise_queries_do_not_shuffle(spark, query):
    assert "Exchange" not in plan_text(query(spark, SF))


def test_scan_reads_only_used_columns(spark):
    text = plan_text(observations.expected_field_orders(spark, SF))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>", text)


def test_flattening_is_one_generated_stage(spark):
    text = plan_text(G.flatten_grid(V.grid(spark, SF), keep=["vec_id"]))
    generate = next(line for line in text.splitlines() if "Generate posexplode" in line)
    assert generate.lstrip(" :+-").startswith("*(")


def test_box_filter_reaches_the_tile_scan(spark, tmp_path):
    tiles = G.tile_blocks(V.grid(spark, SF), 2, keep=["vec_id"])
    tiles.write.parquet(str(tmp_path / "tiles"))
    rows = G.flatten_grid(G.tiles_in_box(spark.read.parquet(str(tmp_path / "tiles")), (26.0, 27.0, -124.0, -123.0)),
                          bbox=(26.0, 27.0, -124.0, -123.0), keep=["vec_id"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan_text(rows)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lat_max,26.0)" in text and "LessThanOrEqual(lon_min,-123.0)" in text
    assert "Exchange" not in text


def test_dense_tiles_use_one_shuffle_for_both_aggregates(spark):
    text = plan_text(grids.dense_tiles(spark, SF))
    assert text.count("REPARTITION_BY_COL") == 1
    # partial and final aggregate of the placed cells share that partitioning
    after = text[: text.index("REPARTITION_BY_COL")]
    assert "ENSURE_REQUIREMENTS" not in re.sub(r"Subquery.*", "", after.split("Exchange")[0])


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    else:
        assert shared_dir(spark) == shared_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert work_path(spark, "x") != work_path(spark, "x")
