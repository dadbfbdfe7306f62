import gzip
import json
import struct

import pytest

from sessionlab.sources import captures as C, findings as L


SAMPLES = {"t": "here", "?": True, "d": 0.25, "Q": 31, "I": 8, "i": -4, "B": 2}


def encoded(kind, ordinal, **given):
    """A record of the format's own table of bodies, with the sample values where none is given."""
    parts = [C.HEADER.pack(C.MAGIC, C.VERSION, kind, 5, ordinal, 7 * ordinal, 3, 4)]
    for code, name in C.BODIES[kind]:
        value = given.get(name, SAMPLES[code])
        parts.append(struct.pack("<H", len(value)) + value.encode() if code == "t" else struct.pack("<" + code, value))
    raw = b"".join(parts)
    return struct.pack("<I", len(raw)) + raw


START = encoded(1, 1, player="someone", protocol=47)
MOVE = encoded(11, 3, y=2.0, has_look=False, friction=0.6)


def test_captures_from_files(spark, tmp_path):
    good = tmp_path / "run-a" / "trial-t1"
    good.mkdir(parents=True)
    (good / "events-0001.acbin.gz").write_bytes(gzip.compress(START + encoded(4, 2) + MOVE))
    (good / "events-0002.acbin.gz").write_bytes(gzip.compress(encoded(13, 4, token=77) + b"\x30\x00"))
    (good / "manifest.json").write_text(json.dumps({"trial_id": "t1", "records": 4, "status": "complete"}))
    bad = tmp_path / "run-a" / "trial-t2"
    bad.mkdir()
    (bad / "manifest.json").write_text("{not json")
    rows = C.read_captures(spark, str(tmp_path)).orderBy("path", "position").collect()
    ok = [r for r in rows if r.error is None]
    assert [(r.trial, r.kind, r.ordinal) for r in ok] == [("t1", 1, 1), ("t1", 4, 2), ("t1", 11, 3), ("t1", 13, 4)]
    assert (ok[0].player, ok[0].protocol, ok[2].y, ok[2].has_look, ok[2].friction, ok[3].token) == ("someone", 47, 2.0, False, 0.6, 77)
    assert [r.error for r in rows if r.error] == ["chunk: cut prefix"]
    manifests = {r.manifest_path.split("/")[-2]: r for r in C.read_manifests(spark, str(tmp_path)).collect()}
    assert manifests["trial-t1"].records == 4 and manifests["trial-t2"].trial_id is None and manifests["trial-t2"]._corrupt


@pytest.mark.parametrize("raw,message", [
    (C.HEADER.pack(1, 3, 4, 1, 1, 1, 1, 1), "magic"), (C.HEADER.pack(C.MAGIC, 3, 99, 1, 1, 1, 1, 1), "kind"),
    (C.HEADER.pack(C.MAGIC, 3, 4, 1, 1, 1, 1, 1) + b"x", "trailing"), (MOVE[4:-3], "body"), (MOVE[4:].replace(b"\x00\x01\x04\x00here", b"\x05\x01\x04\x00here", 1), "boolean")])
def test_broken_records_are_refused(raw, message):
    with pytest.raises(ValueError, match=message):
        C.decode_record(raw)


def test_hashes(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two")
    files = C.hash_files(spark, str(tmp_path))
    catalog = files.selectExpr("path", "CASE WHEN path LIKE '%a' THEN sha256 ELSE 'x' END AS sha256").union(spark.createDataFrame([("gone", "y")], "path string, sha256 string"))
    assert {(r.path.split("/")[-1], r.problem) for r in C.verify_hashes(files, catalog).collect()} == {("b", "changed"), ("gone", "missing")}


def test_export_keeps_only_approved_recordings(spark, tmp_path):
    windows = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 2.0), ("b", "q", 3.0)], "trial string, player_group string, movement_pps double")
    sheet = spark.createDataFrame([("a", "legit", "legit_control", None), ("b", "legit", "x", "conflict")], "trial_id string, verified_label string, verification string, error string")
    r = L.export_windows(windows, sheet, str(tmp_path / "out")).first()
    assert (r.windows, r.players, r.skipped, r.exported) == (2, 1, 1, 1)
    with pytest.raises(Exception, match="nonfinite"):
        L.write_table(windows.selectExpr("trial", "CAST('NaN' AS DOUBLE) AS x"), str(tmp_path / "nan"), "json")


def test_findings_and_sinks(spark, tmp_path):
    good = {"level": "new", "check": "c", "player": "p", "session": "1", "event": "2", "message": "m", "evidence": {"reason": "r"}, "epoch_ms": "1000"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.jsonl").write_text("\n".join([json.dumps(good), "[1]", json.dumps({"level": "x"}), json.dumps({**good, "message": "x" * 70000})]))
    rows = L.read_findings(spark, str(tmp_path / "in"))
    assert sorted(str(r.error) for r in rows.collect()) == ["None", "line_too_long", "missing_field", "not_an_object"]
    L.write_table(rows.filter("error IS NULL").select("level", "event"), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    live = L.stream_findings(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    live.awaitTermination()
    assert spark.table("found").count() == 1
    assert "| level |" in L.report_table(rows.groupBy("level").count(), "t")


def test_equal_lines_are_parsed_one_by_one(spark, tmp_path):
    """Equal lines do not meet each other: each keeps its own event, and a repeated event counts once."""
    import __spark_entry__ as entry

    events = [(i, i % 3, "view" if i != 20 else None) for i in range(60)] + [(4, 1, "view"), (None, 1, "view")]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    out = entry.queries()["parse_findings"](spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = [(i, {0: "not_object", 1: "missing_field"}.get(i % 10), "view" if i % 10 > 1 else None) for i in range(60) if i != 20] + [(None, "missing_field", None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_parsed_findings_keep_named_columns(spark):
    lines = spark.createDataFrame([(1, "oops"), (2, "oops"), (3, None)], "n int, value string")
    got = L.parse_findings(lines, keep=("n",)).select("n", "json", "error").collect()
    assert sorted(map(tuple, got)) == [(1, "oops", "not_an_object"), (2, "oops", "not_an_object"), (3, None, "missing_field")]
