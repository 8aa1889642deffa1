"""Scans and sinks on small files."""

import json
import shutil

import pytest

from driftline import contract
from driftline.sources import documents as doc, manifest as mf, tables as st


def test_contract_csv(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(",".join(contract.EVENT_FIELDS) + "\n"
                    'e1,s,1,ALERT_RAISED,"{""a"":1}"\n'
                    "e2,s,2,ALERT_RAISED,\n"
                    "e3,s,3\n"
                    "e4,s,4,ALERT_RAISED,{},extra\n")
    clean, corrupt = st.split_quarantine(
        st.scan_contract_csv(spark, str(path), contract.EVENT_FIELDS))
    assert [(r.event_id, r.event_metadata) for r in clean.orderBy("event_id").collect()] == [
        ("e1", '{"a":1}'), ("e2", "")]
    assert sorted(r.row_text[:2] for r in corrupt.collect()) == ["e3", "e4"]
    assert {r.file_name for r in corrupt.collect()} == {"events.csv"}


def test_wrong_header_fails(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("event_id,timestamp,session_id,event_type,event_metadata\ne1,1,s,X,{}\n")
    with pytest.raises(Exception):
        st.scan_contract_csv(spark, str(path), contract.EVENT_FIELDS).collect()


def test_logger_with_byte_order_mark(spark, tmp_path):
    for name in ("P001", "P002"):
        (tmp_path / f"{name}.csv").write_bytes(
            b"\xef\xbb\xbfsample_no,elapsed_ms,a,a_status\n0,100,1.5,OK\n")
    rows = st.scan_logger_csv(spark, str(tmp_path), channels=("a",)).orderBy("session_id").collect()
    assert [(r.session_id, r.sample_no, r.a) for r in rows] == [("P001", "0", "1.5"), ("P002", "0", "1.5")]
    configured = spark.createDataFrame([("P001.csv",), ("P003.csv",)], "file_name string")
    got = {(r.file_name, r.problem) for r in st.scan_session_files(
        st.files_present(spark, str(tmp_path)), configured).collect()}
    assert got == {("P002.csv", "unexpected"), ("P003.csv", "missing")}


def test_append_checks_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    st.append_table(df, path, ["k", "v"])
    st.append_table(df, path, ["k", "v"])
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        st.append_table(df.select("v", "k"), path, ["k", "v"])
    with pytest.raises(ValueError):
        st.append_table(df.selectExpr("k", "cast(v as string) v"), path, ["k", "v"])


def test_refuse_or_replace(spark, tmp_path):
    folder = str(tmp_path / "out")
    one, two = spark.range(1), spark.range(2)
    st.write_refuse_or_replace({"a": one, "b": one}, folder)
    with pytest.raises(FileExistsError):
        st.write_refuse_or_replace({"a": two, "c": two}, folder)
    assert spark.read.parquet(f"{folder}/a").count() == 1
    failing = spark.range(3).selectExpr("raise_error('no') as id")
    with pytest.raises(Exception):
        st.write_refuse_or_replace({"a": two, "b": failing}, folder, overwrite=True)
    assert spark.read.parquet(f"{folder}/a").count() == 1
    st.write_refuse_or_replace({"a": two, "b": two}, folder, overwrite=True)
    assert spark.read.parquet(f"{folder}/b").count() == 2


def test_model_documents(spark, tmp_path):
    from driftline.functions.ordinal import ENGINEERING_MODEL as m
    from driftline.operators.model import model_parameter_checks

    def document(**kw):
        return json.dumps({"scaler": {"mean": list(m.mean), "scale": list(m.scale)},
                           "beta": list(m.beta), "theta": list(m.theta), **kw}, indent=2)

    (tmp_path / "good.json").write_text(document())
    (tmp_path / "bad.json").write_text(document(theta=[1.0, 1.0, 2.0]))
    rows = doc.model_rows(doc.scan_json_documents(spark, str(tmp_path), doc.MODEL_SCHEMA))
    assert [(r.model_id, r.rule) for r in model_parameter_checks(rows).collect()] == [
        ("bad.json", "theta_increasing")]


def test_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "k string, v int")
    base = mf.table_fingerprint(df).first()
    assert mf.table_fingerprint(df.orderBy("k", ascending=False).repartition(3)).first() == base
    assert mf.table_fingerprint(df.fillna("", ["k"]).fillna(0, ["v"])).first() != base
    assert mf.table_fingerprint(df.distinct()).first() != base
    (tmp_path / "f.txt").write_bytes(b"abc")
    row = mf.file_fingerprints(spark, str(tmp_path)).first()
    assert row.sha256.startswith("ba7816bf") and row.length == 3


def test_event_metadata_json(spark):
    from pyspark.sql import functions as F

    from driftline.functions.parsing import json_object_is_finite

    texts = ['{"a": 1, "b": {"c": [1, 2]}}', "{}", '{"a": NaN}', "[1]", "oops", '{"a": 1e999}', '""', "{",
             '{"a": {"b": [-1e999]}}', '{"a": "Infinity"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r.ok for r in df.select("i", json_object_is_finite(F.col("t")).alias("ok")).orderBy("i").collect()]
    assert got == [True, True] + [False] * 7 + [True]


def test_intake_types_and_rejects(spark):
    from driftline.sources.intake import type_rows

    good = ("1000", "s", "1.5", "2", "OK", "OK", "NORMAL", "", "")
    rows = [good, ("x", *good[1:]), (*good[:2], "NaN", *good[3:]), (*good[:4], "FINE", *good[5:])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in contract.SAMPLE_FIELDS))
    typed, rejected = type_rows(df, contract.SAMPLE_FIELDS)
    assert [(r.timestamp, r.capacitance_raw, r.lig_raw) for r in typed.collect()] == [(1000, 1.5, 2.0)]
    assert sorted(r.rejected_fields for r in rejected.collect()) == [
        ["cap_quality"], ["capacitance_raw"], ["timestamp"]]


def test_settings_are_checked():
    from driftline.operators.qc import QcConfig
    from driftline.operators.windows import WindowSpec

    for build in (lambda: QcConfig(jitter_tolerance_ms=1000),
                  lambda: QcConfig(unmarked_gap_threshold_ms=1200),
                  lambda: QcConfig(minimum_pre_injection_dry_s=59),
                  lambda: WindowSpec(stride=0), lambda: WindowSpec(expected=None)):
        with pytest.raises(ValueError):
            build()


def test_file_digests_do_not_show_splits(spark, tmp_path):
    lines = b"\n".join(b"line %d \xff\r" % (i % 700) * (i % 9) for i in range(4000))
    files = {"a": lines, "b": lines + b"\n", "c": b"", "d": b"\n", "e": b"\0" * 5000,
             "f": lines[:999] + b"!" + lines[1000:], "g": b"x\ny\n", "h": b"y\nx\n"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)

    def digests():
        return {r.file_name: (r.length, r.digest)
                for r in mf.file_digests(spark, str(tmp_path)).collect()}

    whole = digests()
    assert {n: v[0] for n, v in whole.items()} == {n: len(b) for n, b in files.items() if b}
    assert len(set(whole.values())) == len(files) - 1
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    try:
        spark.conf.set(key, "7000")
        spark.conf.set(cost, "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert digests() == whole
    finally:
        spark.conf.unset(key)
        spark.conf.unset(cost)


def test_a_changed_input_is_found_two_stages_later(spark, tmp_path):
    one, two, three = (str(tmp_path / n) for n in ("one", "two", "three"))
    rows = mf.write_stage(spark.createDataFrame(
        [(i, "" if i % 3 else ("A" if i % 2 else "B")) for i in range(30)], "k int, why string"),
        one, "one", "v1", reason="why", reasons=("A",))
    kept = mf.write_stage(rows.where("why = ''"), two, "two", "v1", [one], columns=["k"])
    mf.write_stage(kept.groupBy().count(), three, "three", "v2", [two, one])
    document = mf.read_manifest(spark, one)
    assert (document.candidate_count, document.valid_count, document.exclusion_counts) == (
        30, 20, {"A": 5, "OTHER": 5})
    assert [i.stage for i in mf.read_manifest(spark, three).inputs] == ["two", "one"]
    assert document.digest == mf.table_fingerprint(rows).first().digest
    assert mf.chain_problems(spark, three) == []
    # the rows change, and then their manifest as well
    rows.where("k <> 29").write.parquet(f"{one}-new")
    shutil.rmtree(f"{one}/rows")
    shutil.copytree(f"{one}-new", f"{one}/rows")
    assert mf.chain_problems(spark, three) == [(one, "one", "ROWS_CHANGED")]
    shutil.rmtree(one)
    mf.write_stage(spark.read.parquet(f"{one}-new"), one, "one", "v1")
    assert mf.chain_problems(spark, three) == [
        (three, "three", "INPUT_REPLACED"), (two, "two", "INPUT_REPLACED")]


def test_a_stage_is_scanned_once_while_it_is_written(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    stored = mf.write_stage(frame, str(tmp_path / "out"), "s", "v")
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert stored.count() == 50 and len(jobs) <= 2  # the rows, and the one-line manifest


def test_logger_intake_types_all_channels_and_lists_rejects(spark, tmp_path):
    from driftline.sources.intake import channel_rows, logger_intake

    (tmp_path / "P001.csv").write_bytes(
        b"\xef\xbb\xbfsample_no,elapsed_ms,a,a_status,b,b_status\n"
        b"0,100,1.5,OK,-2e3,IDLE\n1,200,inf,OK,2,OK\n2,300,7,BAD,,OK\n3.0,400,7,OK,1,OK\n4,500,1,OK,2,\n")
    rows = st.scan_logger_csv(spark, str(tmp_path), channels=("a", "b"))
    clean, _ = st.split_quarantine(rows)
    typed, rejected = logger_intake(clean, ("a", "b"), {"a": ("OK",), "b": ("OK", "IDLE")})
    assert [tuple(r) for r in typed.collect()] == [("P001", 0, 100, 1.5, -2000.0, "OK", "IDLE")]
    assert sorted((r.sample_text, r.field, r.text, r.problem) for r in rejected.collect()) == [
        ("1", "a", "inf", "NUMBER"), ("2", "a_status", "BAD", "STATUS"), ("2", "b", "", "NUMBER"),
        ("3.0", "sample_no", "3.0", "NUMBER"), ("4", "b_status", "", "STATUS")]
    assert [(r.channel, r.value, r.status) for r in channel_rows(typed, ("a", "b")).orderBy(
        "channel").collect()] == [("a", 1.5, "OK"), ("b", -2000.0, "IDLE")]
    with pytest.raises(ValueError):
        logger_intake(clean, ("a", "b"), {"a": ("OK",)})


def test_pilot_lists_broken_cadence(spark):
    from driftline.operators.windows import WindowSpec
    from driftline.plans.pipelines import pilot

    rows = [("ok", n, 100 * n, 1.0, "OK") for n in range(30)]
    rows += [("gap", n + (n > 4), 100 * (n + (n > 4)), 1.0, "OK") for n in range(30)]
    rows += [("slow", n, 100 * n + (n == 7), 1.0, "OK") for n in range(30)]
    df = spark.createDataFrame(
        rows, "session_id string, sample_no long, elapsed_ms long, a double, a_status string")
    found = pilot(df, {"a": "a_status"}, ["a"], 10, 1, WindowSpec(window=2000, stride=1000,
                                                                  expected=2)).cadence.collect()
    assert {(r.session_id, r.problem) for r in found} == {("gap", "SAMPLE_NO"), ("slow", "ELAPSED")}


def test_whole_documents(spark, tmp_path):
    body = {"good": {"name": "x", "n": 3, "f": 1.5, "more": [1, {"k": None}]},
            "types": {"name": 4, "n": 3, "f": 1.0}, "null": {"name": None, "n": 1, "f": 1},
            "missing": {"name": "x", "f": 2}, "whole": {"name": "", "n": -1, "f": 2}}
    for name, value in body.items():
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    (tmp_path / "array").write_text(json.dumps([body["good"]]))
    (tmp_path / "scalar").write_text("17")
    (tmp_path / "broken").write_text('{"name": "x", ')
    (tmp_path / "huge").write_text(json.dumps({**body["good"], "pad": "y" * 12_000_000}))
    found = {r.file_name: (r.problem, r.name, r.n, r.f) for r in doc.scan_whole_documents(
        spark, str(tmp_path), {"name": "string", "n": "bigint", "f": "double"}).drop("document").collect()}
    nothing = (None, None, None)
    assert found == {
        "good": ("", "x", 3, 1.5), "whole": ("", "", -1, 2.0), "huge": ("", "x", 3, 1.5),
        "types": ("SCHEMA", *nothing), "null": ("SCHEMA", *nothing), "missing": ("SCHEMA", *nothing),
        "array": ("NOT_OBJECT", *nothing), "scalar": ("NOT_OBJECT", *nothing),
        "broken": ("NOT_JSON", *nothing)}


def test_shared_files_hold_many_sessions_and_documents(spark, tmp_path):
    (tmp_path / "logger").mkdir()
    (tmp_path / "logger" / "part.csv").write_text(
        "session_id,sample_no,elapsed_ms,a,a_status\nP001,0,100,1.5,OK\nP002,0,100,,OK\nP002,1,200\n")
    rows = st.scan_logger_csv(spark, str(tmp_path / "logger"), channels=("a",), shared=True)
    clean, broken = st.split_quarantine(rows)
    assert sorted((r.session_id, r.sample_no, r.a) for r in clean.collect()) == [("P001", "0", "1.5"), ("P002", "0", "")]
    assert [r.row_text for r in broken.collect()] == ["P002,1,200"]
    texts = [(1, '{"name": "x",\n "n": 3}'), (2, '{"name": "x"}'), (3, "[1]"), (4, '{"name"'), (5, None)]
    spark.createDataFrame(texts, "doc long, value string").write.parquet(str(tmp_path / "documents"))
    found = doc.scan_whole_documents(spark, str(tmp_path / "documents"), {"name": "string", "n": "bigint"}, shared=True)
    assert sorted((r.doc, r.problem, r.n) for r in found.collect()) == [
        (1, "", 3), (2, "SCHEMA", None), (3, "NOT_OBJECT", None), (4, "NOT_JSON", None), (5, "NOT_JSON", None)]


def test_scan_queries_write_no_file_per_session_or_document(spark, tmp_path, monkeypatch):
    from driftline.catalog import storage

    spark.createDataFrame([(i, f"S{i}", i % 5, 1.0) for i in range(300)],
                          "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(
        str(tmp_path / "in" / "supplier.parquet"))
    lines = [(i // 3, i % 3, i % 300, i % 7, 5.0, 9.5, 0.0, 0.01, "N", "O", i) for i in range(900)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                          "l_linestatus string, l_shipdate long").write.parquet(str(tmp_path / "in" / "lineitem.parquet"))
    for name, count in (("scan_logger_csv", 900 * 4), ("scan_json_documents", 300)):
        monkeypatch.setattr(storage, "_folder", lambda _, name=name: str(tmp_path / name))
        assert getattr(storage, name)(spark, str(tmp_path / "in")).count() == count
        assert 0 < len([p for p in (tmp_path / name).rglob("part-*")]) < 50
