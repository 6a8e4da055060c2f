"""Readers, sinks and streaming on small files."""

import json

import pytest

from scantable.sources import readers
from scantable.streaming import scores


def test_candidates_and_lines(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text(json.dumps({"scene_name": "s", "candidates": [{"candidate_id": 1, "score": 0.5, "support_views": [{"frame_index": 3}]}, {"candidate_id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"scene_name": "t", "candidates": []}))
    got = readers.read_candidates(spark, str(tmp_path / "*.json"))
    assert rows(got, "scene_name", "candidate_id", "score") == [("s", 1, 0.5), ("s", 2, None)]
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n{"id": 2, "x": "y"}\n')
    (tmp_path / "d.json").write_text('[{"id": 3}]')
    both = readers.read_json_or_lines(spark, [str(tmp_path / "d.json")], [str(tmp_path / "c.jsonl")], "id long, x string")
    assert rows(both) == [(1, None), (2, "y"), (3, None)]
    assert readers.read_json_or_lines(spark, [], [], "id long").count() == 0
    readers.append_lines(both, str(tmp_path / "out"))
    readers.append_lines(both, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_evaluation_and_report(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "sink", 0.5, 0.6, 0.7), (2, "tap", -0.25, None, None)], "class_id int, class_name string, ap double, ap50 double, ap25 double")
    readers.write_evaluation(df, str(tmp_path / "e"))
    assert rows(readers.read_evaluation(spark, str(tmp_path / "e")), "class", "ap", "ap50") == [("sink", 0.5, 0.6), ("tap", -0.25, None)]
    assert "| sink | +0.5000 |" in readers.markdown_report(df, "class_name", "ap", 1)


def test_label_text_and_meshes(spark, tmp_path, rows):
    (tmp_path / "scene1.txt").write_text("1001\n0\n2003\n")
    assert rows(readers.read_label_text(spark, str(tmp_path / "scene1.txt"))) == [("scene1", 0, 1001), ("scene1", 1, 0), ("scene1", 2, 2003)]
    (tmp_path / "m.ply").write_bytes(readers.write_ply([(0, 0, 0, 255, 0, 0), (1, 0, 0, 0, 255, 0), (0, 1, 0, 0, 0, 51)], [(0, 1, 2)]))
    p = rows(readers.read_points(spark, str(tmp_path / "m.ply")), "scene", "point_id", "x", "r", "b")
    assert p[0] == ("m", 0, 0.0, 1.0, 0.0) and abs(p[2][4] - 0.2) < 1e-6
    assert rows(readers.read_faces(spark, str(tmp_path / "m.ply")), "v0", "v1", "v2") == [(0, 1, 2)]
    (tmp_path / "n.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    assert rows(readers.read_points(spark, str(tmp_path / "n.ply")), "point_id", "z", "r") == [(0, 3.0, 0.0), (1, 6.0, 0.0)]


def test_signature_and_completeness(spark, tmp_path):
    df = spark.range(3)
    readers.write_signed(df, str(tmp_path / "c"), {"a": 1, "b": 2})
    assert readers.read_signed(spark, str(tmp_path / "c"), {"b": 2, "a": 1}).count() == 3
    with pytest.raises(ValueError, match="another version"):
        readers.read_signed(spark, str(tmp_path / "c"), {"a": 2})
    readers.require_complete(df, df, ["id"])
    with pytest.raises(ValueError, match="missing"):
        readers.require_complete(df, df.limit(1), ["id"])


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([("2025-01-01 00:10:00", "a", 0.5, 1), ("2025-01-01 00:20:00", "a", float("nan"), 1), ("2025-01-01 03:00:00", "b", 0.9, 2)], "t string, label string, v double, id long").selectExpr("timestamp(t) t", "label", "v", "id")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert run(scores.scored(stream, "v", 0.6), "kept", "append").count() == 1
    ev = {(r.label, r.n): r.evidence for r in run(scores.windowed_evidence(stream, "t", "label", "v"), "evidence", "update").collect()}
    assert ev == {("a", 2): 0.5, ("b", 1): 0.9}
    assert run(scores.distinct_records(stream, "id", "t"), "once", "append").count() == 2
