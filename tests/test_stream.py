import json

from spinelens import vocab
from spinelens.operators import metrics as X
from spinelens.sources import documents as D
from spinelens.streaming import metrics_stream as S


def document(name, labels, keypoints=4, cfh=True):
    return {
        "image_id": name, "image_width": 1920, "image_height": 1080,
        "vertebrae": [{"label": l, "confidence": 0.9, "bbox": [0.1, 0.1, 0.2, 0.2], "keypoints": [
            {"x": 0.1 + 0.1 * (k % 2), "y": 0.1 * i + 0.05 * (k // 2) + 0.01 * k} for k in range(keypoints)]}
            for i, l in enumerate(labels)],
        "cfh": {"confidence": 0.9, "bbox": [0.5, 0.9, 0.1, 0.1], "center": {"x": 0.5, "y": 0.95}} if cfh else None,
    }


def write(folder, docs):
    folder.mkdir()
    for name, content in docs.items():
        (folder / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))


def test_stream_equals_batch_and_rejects_are_kept_apart(spark, tmp_path):
    docs = {
        "S0001": document("S0001", vocab.MEASURED_LABELS),
        "S0002": document("S0002", ["T1", "L5", "T1"], cfh=False),
        "S0003": document("S0003", ["T1"], keypoints=3),
        "S0004": "{broken",
        "S0005": {"image_id": "S0005", "image_width": 10, "image_height": 10},
        "S0006": {**document("S0006", ["T1"]), "vertebrae": [{"label": "T1"}]},
    }
    write(tmp_path / "in", docs)
    stream = S.stream_detections(spark, str(tmp_path / "in"), files_per_trigger=2)
    query = S.start_metrics(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True)
    query.awaitTermination()
    out = {r["imageId"]: r["metrics"].asDict() for r in spark.read.json(str(tmp_path / "out")).collect()}

    checked = D.check_detections(D.read_detections(spark, str(tmp_path / "in")))
    problems = {r.problem for r in D.rejected_detections(checked).collect()}
    assert problems == {"not a detection document", "vertebrae missing", "incomplete vertebra"}
    batch = S.metrics_of(S.measurements_of(checked))
    want = {r.imageId: r.metrics for r in batch.collect()}
    assert set(out) == set(want) == {"S0001", "S0002"}
    for key, metrics in want.items():
        assert {k: v for k, v in out[key].items() if v is not None} == metrics
    assert set(want["S0001"]) == set(vocab.METRICS) and "PI" not in want["S0002"]
    text = batch._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    rejects = S.start_rejects(S.stream_detections(spark, str(tmp_path / "in")), str(tmp_path / "bad"),
                              str(tmp_path / "bad_checkpoint"), available_now=True)
    rejects.awaitTermination(120)
    assert {r.problem for r in spark.read.json(str(tmp_path / "bad")).collect()} == problems


def test_last_vertebra_of_a_document_wins(spark, tmp_path):
    doc = document("S0001", ["T1", "T1"])
    doc["vertebrae"][1]["keypoints"] = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 2.0}, {"x": 1.0, "y": 3.0}]
    write(tmp_path / "in", {"a": doc})
    checked = D.check_detections(D.read_detections(spark, str(tmp_path / "in")))
    nested = S.metrics_of(S.measurements_of(checked)).first().metrics["T1_Slope"]
    from spinelens.plans import composites as C
    long = C.detections_to_metrics(D.explode_detections(D.valid_detections(checked))).first().T1_Slope
    assert nested == long and 29 < nested < 30


def test_keypoints_documents(spark, tmp_path):
    write(tmp_path / "in", {
        "a": {"imageWidth": 10, "imageHeight": 10, "measurements": [
            {"type": "SVA", "points": [{"x": 1, "y": 1}, {"x": 5, "y": 1}]}]},
        "b": {"imageId": "S2", "measurements": []},
    })
    docs = D.keypoint_doc_problem(D.read_keypoint_docs(spark, str(tmp_path / "in")))
    got = {r.imageId: r for r in docs.collect()}
    assert got["S2"].problem == "image size missing"
    assert got["lateral_spine"].problem is None and got["lateral_spine"].standardDistance == 100.0
    valid = docs.filter("problem IS NULL")
    assert X.with_sva_mm(X.metrics_from_documents(valid)).first().sva_mm == 2.0
    assert D.explode_measurements(valid).first().type == "SVA"
    stream = S.metrics_of(S.stream_keypoint_docs(spark, str(tmp_path / "in")).filter("problem IS NULL"))
    query = stream.writeStream.format("memory").queryName("docs").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("docs").first().metrics == {"SVA": 4.0}


def test_one_query_writes_both_sinks_and_a_replay_adds_nothing(spark, tmp_path):
    docs = {f"S{i:04d}": document(f"S{i:04d}", vocab.MEASURED_LABELS) for i in range(5)}
    docs |= {"T1": document("T1", ["T1"], keypoints=3), "T2": "{broken", "T3": {"image_id": "T3", "image_width": 10, "image_height": 10}}
    write(tmp_path / "in", docs)
    out, bad, checkpoint = str(tmp_path / "out"), str(tmp_path / "bad"), tmp_path / "checkpoint"

    def run():
        stream = S.stream_detections(spark, str(tmp_path / "in"), files_per_trigger=3)
        query = S.start_documents(stream, out, bad, str(checkpoint), available_now=True)
        query.awaitTermination(240)
        assert query.exception() is None
        return query

    query = run()
    assert sum(p["numInputRows"] for p in query.recentProgress) == len(docs)  # each file once
    first = sorted(r.imageId for r in spark.read.json(out).collect())
    assert first == sorted(d for d in docs if d.startswith("S"))
    rejected = sorted((r.image_id or "", r.problem) for r in spark.read.json(bad).collect())
    assert [p for _, p in rejected] == ["not a detection document", "keypoint count is not 4: T1", "vertebrae missing"]
    run()  # nothing new
    assert sorted(r.imageId for r in spark.read.json(out).collect()) == first
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the job had stopped before it noted the last batch
    for crc in (checkpoint / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    run()
    assert sorted(r.imageId for r in spark.read.json(out).collect()) == first
    assert sorted((r.image_id or "", r.problem) for r in spark.read.json(bad).collect()) == rejected
