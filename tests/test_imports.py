"""Manifests from metadata files and plans of imports."""

import json

from metrum.sources import files


def test_manifest_from_metadata(spark, tmp_path):
    whole = {"case_id": "one", "approval": {"by": "x", "ok": True}, "reviewer": "r", "summary": {"n": 3}, "more": [1]}
    texts = {"a": json.dumps(whole), "b": "\ufeff{}", "c": "no json", "d": '{"case_id": null, "reviewer": "é"}'}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(text)
    got = {r.case_id: r for r in files.metadata_manifest(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["b", "c", "d", "one"]
    assert (json.loads(got["one"].approval), got["one"].reviewer, json.loads(got["one"].summary), got["one"].review_layers) == (whole["approval"], "r", {"n": 3}, "{}")
    assert got["one"].path.endswith("/a") and got["d"].reviewer == "é" and (got["c"].approval, got["c"].reviewer) == ("{}", "")


def test_import_plan(spark):
    wanted = spark.createDataFrame([("a", " x y\n"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "x"), ("f", None)], "case_id string, transcript string")
    every = ("wav", "grid", "transcript")
    found = [(c, k) for c in "abcf" for k in every] + [("a", "wav"), ("d", "wav"), ("d", "grid"), ("d", "other"), ("z", "wav")]
    kept = spark.createDataFrame([("a", "x y"), ("b", "other"), ("d", "x"), ("f", None), ("z", "x")], "case_id string, text string")
    plan = files.import_plan(wanted, spark.createDataFrame(found, "case_id string, kind string"), kept)
    assert {r.case_id: r.action for r in plan.collect()} == {"a": "keep", "b": "differs", "c": "copy", "d": "missing", "e": "missing", "f": "keep"}
    assert files.import_plan(wanted.limit(0), spark.createDataFrame(found, "case_id string, kind string"), kept).count() == 0
