import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitrogrid.plans import scoring as S
from nitrogrid.schemas import BATCH_REQUEST, GRID_BLOCK, OBSERVATION
from nitrogrid.streaming import batches as B
from nitrogrid.streaming import pipelines as P
from tests.test_grid import block, blocks

AS_OF = "2024-01-20 10:00:00"
REPLY = B.reply_schema(("request_id", T.LongType()))


def tables(spark, out):
    return {
        "files": sorted((r.source_file, r.file_index) for r in B.committed(spark, out, "files", B.FILES).collect()),
        "rows": sorted((r.source_file, r.file_index, r.no2, r.batch_id) for r in B.committed(spark, out, "rows", OBSERVATION).collect()),
        "rejects": sorted((r.source_file, r.error, r.batch_id) for r in B.committed(spark, out, "rejects", B.REJECTS).collect()),
    }


def test_batches_are_written_once(spark, tmp_path):
    out = str(tmp_path / "out")
    first, second = blocks(spark, block("b"), block("c", no2=[1.0])), blocks(spark, block("a"), block("b"))
    assert tables(spark, out) == {"files": [], "rows": [], "rejects": []}
    B.ingest_batch(first, 0, out, "strict")
    B.ingest_batch(second, 1, out, "strict")
    found = tables(spark, out)
    # numbered by batch, by name within one; a file that comes again keeps its number
    assert found["files"] == [("a", 2), ("b", 0), ("c", 1)]
    assert sorted(r[:2] + r[3:] for r in found["rows"]) == [("a", 2, 1)] * 6 + [("b", 0, 0)] * 6 + [("b", 0, 1)] * 6
    assert found["rejects"] == [("c", "sizes of variables differ", 0)]
    for again in (0, 1):
        B.ingest_batch(first.unionByName(second), again, out, "strict")
    assert tables(spark, out) == found


def test_a_batch_that_broke_is_repeated(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    B.ingest_batch(blocks(spark, block("a")), 0, out, "strict")
    whole = tables(spark, out)

    def broken(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(B, "_commit", broken)
        try:
            B.ingest_batch(blocks(spark, block("b")), 1, out, "strict")
        except OSError:
            pass
    # nothing of the broken batch is seen, and its file gets the same number in the next try
    assert tables(spark, out) == whole
    B.ingest_batch(blocks(spark, block("b")), 1, out, "strict")
    assert tables(spark, out)["files"] == [("a", 0), ("b", 1)] and len(tables(spark, out)["rows"]) == 12


def test_blocks_without_a_file_name(spark, tmp_path):
    out = str(tmp_path / "out")
    B.ingest_batch(blocks(spark, block(None), block("a")), 0, out, "strict")
    found = tables_with_null(spark, out)
    assert found == {(None, None): 6, ("a", 0): 6}
    B.ingest_batch(blocks(spark, block("a")).limit(0), 1, out, "strict")
    assert tables_with_null(spark, out) == found


def tables_with_null(spark, out):
    rows = B.committed(spark, out, "rows", OBSERVATION).groupBy("source_file", "file_index").count().collect()
    return {(r.source_file, r.file_index): r["count"] for r in rows}


def test_ingest_stream_goes_on_after_a_restart(spark, tmp_path):
    source, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    blocks(spark, block("a"), block("x", no2=[1.0])).write.parquet(source)
    B.start_ingest(P.read_block_stream(spark, source, GRID_BLOCK), out, mark, "strict").awaitTermination()
    blocks(spark, block("b")).write.mode("append").parquet(source)
    B.start_ingest(P.read_block_stream(spark, source, GRID_BLOCK), out, mark, "strict").awaitTermination()
    found = tables(spark, out)
    assert found["files"] == [("a", 0), ("b", 2), ("x", 1)] and len(found["rows"]) == 12
    assert [r[0] for r in found["rejects"]] == ["x"]


def test_replies(spark, tmp_path):
    place = {"latitude": 40.0, "longitude": -74.0}
    source, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    bodies = [
        {"request_id": 1, "locations": [{**place, "name": n} for n in "zay"], "month": 8},
        {"request_id": 2, "locations": []}, {"request_id": 3},
        {"request_id": 4, "locations": [{"name": "x"}, {"latitude": 99.0, "longitude": -74.0}]},
        {"request_id": 1, "locations": [place]}, {"locations": [place]},
    ]
    (tmp_path / "in").mkdir()
    for i, part in enumerate((bodies[:4], bodies[4:])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
    schema = T.StructType([T.StructField("request_id", T.LongType()), *BATCH_REQUEST.fields])
    stream = P.read_request_stream(spark, source, schema)
    B.start_replies(stream, out, mark, S.formula_predictor(), as_of=AS_OF).awaitTermination()
    rows = B.committed(spark, out, "replies", REPLY).collect()
    got = sorted((r.request_id or 0, r.success, r["count"] if r.success else -1, r.error or "") for r in rows)
    missing = "locations array is required"
    assert got == [(0, True, 1, ""), (1, True, 1, ""), (1, True, 3, ""), (2, True, 0, ""), (3, False, -1, missing), (4, True, 0, "")]
    # predictions come in the order of the request
    long = next(r for r in rows if r["count"] == 3)
    assert [p.name for p in long.predictions] == ["z", "a", "y"] and long.predictions[0].no2_value > 1e15
    B.reply_batch(spark.read.schema(schema).json(source), 0, out, S.formula_predictor())
    assert B.committed(spark, out, "replies", REPLY).count() == 6
