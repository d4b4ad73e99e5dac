import hashlib

import pytest
from pyspark.sql import functions as F, types as T

from nightframe.operators import audits, cleaning, engineering as G, epochs as E, snapshots
from nightframe.schemas import DROPPED_FEATURES, FEATURES, LEGACY_TABLE, MODEL_INPUT_COLUMNS, SELECTED_FEATURES
from nightframe.sources import files, tables

NAN = float("nan")


def segments(spark, *rows):
    return spark.createDataFrame([("A", float(o), float(d), label) for o, d, label in rows], "recording_id string, onset double, duration double, label string")


# --- contracts ---------------------------------------------------------------------------


def test_contract_sizes():
    assert len(FEATURES) == 35 and len(SELECTED_FEATURES) == 28 and len(MODEL_INPUT_COLUMNS) == 35
    roles = G.classify_roles(FEATURES, SELECTED_FEATURES, DROPPED_FEATURES)
    assert sum(r == "dropped" for _, r in roles) == 7


def test_roles_must_be_exclusive_and_complete():
    with pytest.raises(ValueError, match="both"):
        G.classify_roles(["a", "b"], ["a", "b"], {"b": "x"})
    with pytest.raises(ValueError, match="neither"):
        G.classify_roles(["a", "b"], ["a"], {})


def test_exact_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert G.require_exact_columns(df, ["a", "b"], ["c"]) is df
    with pytest.raises(ValueError, match="missing=\\['z'\\] unexpected=\\['b', 'c'\\]"):
        G.require_exact_columns(df, ["a", "z"])


# --- cleaning ----------------------------------------------------------------------------


def test_clean_dedupes_completes_and_drops_negatives_and_nan(spark):
    rows = [(1, 2.0, "x"), (1, 2.0, "x"), (2, None, "x"), (3, -1.0, "x"), (4, NAN, "x"), (5, 0.0, None), (6, 0.0, "x")]
    df = spark.createDataFrame(rows, "id int, delta_power double, s string")
    assert sorted(r.id for r in cleaning.clean(df).collect()) == [1, 6]
    copies = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, delta_power double")
    assert cleaning.clean(copies).count() == 2
    assert cleaning.clean(copies, surrogate_keys=["id"]).count() == 1


def test_unsupported_and_null_labels_fall_out(spark):
    df = spark.createDataFrame([("Wake",), ("N9",), (None,)], "sleep_stage string")
    assert [r.sleep_stage for r in cleaning.supported_labels(df).collect()] == ["Wake"]


def test_recording_requests(spark):
    df = spark.createDataFrame([("R1", 1), ("R2", 2)], "recording_id string, v int")
    assert [r.v for r in cleaning.select_recordings(df, [" r2", "R2 ", "r1"]).orderBy("position").collect()] == [2, 1]
    assert cleaning.select_recordings(df).count() == 2
    with pytest.raises(ValueError, match="R9"):
        cleaning.select_recordings(df, ["r9"])


def test_gates(spark):
    df = spark.createDataFrame([(1, 0, False, 1.0), (2, 1, True, float("inf"))], "subject_id int, sleep_stage_encoded int, quality_issue_flag boolean, f double")
    with pytest.raises(ValueError, match="1 rows"):
        cleaning.reject_flagged(df)
    assert cleaning.reject_flagged(df, allowed=True) is df
    with pytest.raises(ValueError, match="f"):
        cleaning.require_finite(df, ["f"])
    assert cleaning.subject_partition(df, [1]).count() == 1
    for bad in ([], [1, 1], [7]):
        with pytest.raises(ValueError):
            cleaning.subject_partition(df, bad)
    with pytest.raises(ValueError, match="classes"):
        cleaning.subject_partition(df, [1], [0, 1])
    with pytest.raises(ValueError, match="no rows"):
        cleaning.keep_statuses(df.withColumn("status", F.lit("new")), ["verified"])


# --- engineering ---------------------------------------------------------------------------


def legacy(spark):
    return spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0, 4.0, 9.0, "Wake"), (2, 2.0, 2.0, 1.0, 0.0, 9.0, "REM")],
        "subject_id int, delta_power double, theta_power double, alpha_power double, beta_power double, signal_energy double, sleep_stage string",
    )


def test_power_features_by_hand(spark):
    rows = {r.subject_id: r for r in G.power_features(legacy(spark)).collect()}
    assert rows[1].total_power == 10 and rows[1].relative_delta_power == pytest.approx(0.1) and rows[1].sleep_stage_encoded == 0
    assert rows[1].log_signal_energy == pytest.approx(2.302585093) and rows[2].alpha_beta_ratio == pytest.approx(1e8)


def test_scaling_uses_population_deviation_and_only_centres_constants(spark):
    out = {r.subject_id: r for r in G.engineer(legacy(spark)).collect()}
    assert (out[1].delta_power, out[2].delta_power) == (-1.0, 1.0)
    assert (out[1].theta_power, out[1].signal_energy) == (0.0, 0.0)
    assert list(G.engineer(legacy(spark)).columns)[:2] == ["subject_id", "signal_energy"]


def test_unmapped_label_stops_the_job(spark):
    with pytest.raises(Exception, match="unmapped stage label: N7"):
        G.power_features(legacy(spark).withColumn("sleep_stage", F.lit("N7"))).collect()
    with pytest.raises(ValueError, match="missing columns"):
        G.power_features(legacy(spark).drop("beta_power"))


def test_derived_share(spark):
    df = spark.createDataFrame([(0.2, 0.3), (0.5, 0.5 + 1e-12)], "a double, b double")
    assert [round(r.rest, 9) for r in G.derived_share(df, ["a", "b"], "rest").collect()] == [0.5, 0.0]
    with pytest.raises(Exception, match="outside"):
        G.derived_share(df, ["a", "b", "b", "b"], "rest").collect()


# --- epochs -------------------------------------------------------------------------------


def test_segments_are_mapped_clamped_and_expanded(spark):
    an = segments(
        spark, (-30, 60, "Sleep stage W"), (30, 95, "Sleep stage 4"), (125, 30, "Sleep stage ?"), (155, 20, "Sleep stage R"), (180, 90, "Sleep stage R"),
        (270, 30, "Movement time"),
    )
    got = E.expand(E.clamp_segments(E.map_labels(an), F.lit(240.0))).orderBy("start_time_sec").collect()
    assert [(r.start_time_sec, r.sleep_stage) for r in got] == [(0.0, "Wake"), (30.0, "N3"), (60.0, "N3"), (90.0, "N3"), (180.0, "REM"), (210.0, "REM")]
    assert (got[1].start_sample, got[1].stop_sample) == (3000, 6000)
    assert E.inside_recording(E.expand(E.clamp_segments(E.map_labels(an), F.lit(240.0))), F.lit(240.0), F.lit(21000)).count() == 5


def test_wake_trim_keeps_the_padding_and_numbers_from_zero(spark):
    an = segments(spark, (0, 7200, "Sleep stage W"), (7200, 60, "Sleep stage 2"), (7260, 7200, "Sleep stage W"))
    expanded = E.expand(E.clamp_segments(E.map_labels(an), F.lit(20000.0)))
    kept = E.number_epochs(E.trim_wake(expanded)).orderBy("start_time_sec").collect()
    assert kept[0].start_time_sec == 5400.0 and kept[-1].end_time_sec == 9060.0
    assert [r.epoch_id for r in kept] == list(range(122))
    s = E.epoch_summary(expanded).first()
    assert (s.epochs_before, s.epochs_after, s.epochs_removed, s.count_n2) == (482, 122, 360, 2)


def test_recording_without_sleep_is_an_error(spark):
    an = segments(spark, (0, 600, "Sleep stage W"))
    with pytest.raises(Exception, match="no sleep"):
        E.trim_wake(E.expand(E.clamp_segments(E.map_labels(an), F.lit(600.0)))).collect()


def test_epoch_audit_counts_each_fault(spark):
    rows = [("A", 0, 0.0, 30.0, 0, 3000, "Wake"), ("A", 0, 31.0, 60.0, 3000, 3000, "N5")]
    df = spark.createDataFrame(rows, "recording_id string, epoch_id int, start_time_sec double, end_time_sec double, start_sample int, stop_sample int, sleep_stage string")
    got = {r.check_name: r.violations for r in audits.epoch_audit(df, 30.0).collect()}
    assert got == {"duration": 1, "known_label": 1, "sample_order": 1, "grid": 1, "unique_key": 1}
    with pytest.raises(ValueError, match="grid: 1"):
        audits.require_clean(audits.epoch_audit(df, 30.0))


def test_dataset_and_identifier_audits(spark):
    rows = [(1, "A", 1, 0, "Wake", 0, 1.0), (1, "A", 1, 0, "N1", 4, NAN), (1, " ", 1, -1, None, 0, 1.0)]
    df = spark.createDataFrame(rows, "subject_id int, recording_id string, night int, epoch_id int, sleep_stage string, sleep_stage_encoded int, f double")
    got = {r.check_name: r.violations for r in audits.dataset_audit(df, ["f"], ["subject_id", "recording_id", "night", "epoch_id"]).collect()}
    assert got == {"null_cell": 1, "finite_features": 1, "integer_codes": 0, "label_mapping": 2, "non_empty": 0, "two_subjects": 1, "unique_key": 1}
    ids = {r.check_name: r.violations for r in audits.identifier_audit(df).collect()}
    assert ids["epoch_id_integer"] == 1 and ids["recording_present"] == 1 and ids["unique_key"] == 1


# --- files and snapshots --------------------------------------------------------------------


def test_checksum_listing(spark):
    h1, h2 = "a" * 64, "B" * 64
    lines = [f"{h1} *dir\\one.edf", f"{h2}  two.edf", "not a digest  three.edf", f"{'c' * 63}  short.edf", f"{h2} dir/one.edf"]
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    got = {r.path: r.sha256 for r in files.checksum_lines(df, position="line").collect()}
    assert got == {"dir/one.edf": "b" * 64, "two.edf": "b" * 64}


def test_links(spark):
    html = '<a href="/x/SC4001E0-PSG.edf">a</a> <a class="k" href="https://h.org/d/a%20b.txt?q=1">b</a> <a href="../">up</a>'
    df = spark.createDataFrame([(html,), (html,)], "html string")
    assert sorted(r.filename for r in files.linked_names(df).collect()) == ["SC4001E0-PSG.edf", "a b.txt"]


def test_file_digests(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"abc")
    (tmp_path / "two.bin").write_bytes(b"xyz")
    found = files.digest_files(spark, str(tmp_path))
    assert {r.name: (r.size, r.sha256) for r in found.collect()}["one.bin"] == (3, hashlib.sha256(b"abc").hexdigest())
    expected = spark.createDataFrame(
        [("one.bin", hashlib.sha256(b"abc").hexdigest().upper()), ("two.bin", "0" * 64), ("gone.bin", "0" * 64)], "name string, sha256 string"
    )
    got = {r.name: (r.is_valid, r.actual_sha256 is None) for r in files.validate_digests(found, expected).collect()}
    assert got == {"one.bin": (True, False), "two.bin": (False, False), "gone.bin": (False, True)}


def test_recording_names_and_pairs(spark):
    names = ["SC4001E0-PSG.edf", "SC4001EC-Hypnogram.edf", "SC4012E0-PSG.edf", "readme.txt"]
    df = files.name_parts(spark.createDataFrame([(n,) for n in names], "filename string")).withColumn("path", F.col("filename"))
    got = {(r.recording_id, r.file_type): (r.subject_code, r.subject_id, r.night) for r in df.collect()}
    assert got[("SC4001", "psg")] == ("00", 0, 1) and got[("SC4012", "psg")] == ("01", 1, 2) and len(got) == 3
    with pytest.raises(Exception, match="incomplete file pair: SC4012"):
        files.paired(df).collect()
    whole = files.paired(df.filter("recording_id = 'SC4001'")).first()
    assert whole.psg_path == "SC4001E0-PSG.edf" and whole.hypnogram_path == "SC4001EC-Hypnogram.edf"


def test_snapshot_changes(spark):
    before = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], "path string, size int, digest string")
    after = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("d", 1, "x")], "path string, size int, digest string")
    changes = snapshots.diff(before, after)
    assert {r.path: r.change_type for r in changes.collect()} == {"a": "reused", "b": "modified", "c": "removed", "d": "created"}
    need = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert snapshots.change_counts(changes, need("a", "d")).first().status == "valid"
    bad = snapshots.change_counts(changes, need("a", "c", "z")).first()
    assert (bad.status, bad.missing_required, bad.removed_count) == ("invalid", 2, 1)


def test_upsert_keeps_the_latest_row(spark):
    now = spark.createDataFrame([(1, 10, "old"), (2, 10, "keep")], "k int, checked_at int, status string")
    new = spark.createDataFrame([(1, 20, "new"), (3, 5, "add")], "k int, checked_at int, status string")
    assert {r.k: r.status for r in files.upsert(now, new, ["k"], "checked_at").collect()} == {1: "new", 2: "keep", 3: "add"}


# --- tables -------------------------------------------------------------------------------


def test_csv_contract(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("a,code\n1.5,007\n,010\n")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("code", T.StringType())])
    rows = tables.read_csv(spark, str(good), schema).orderBy("code").collect()
    assert [(r.a, r.code) for r in rows] == [(1.5, "007"), (None, "010")]
    with pytest.raises(ValueError, match="missing columns: \\['delta_power'"):
        tables.read_csv(spark, str(good), LEGACY_TABLE, ["delta_power"])
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "absent.csv"), schema)
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("a,code\n1.5,007,9\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(ragged), schema).collect()


def test_nan_becomes_null(spark):
    row = tables.nan_as_null(spark.createDataFrame([(NAN, 1)], "a double, b int")).first()
    assert row.a is None and row.b == 1


def test_parts_are_resumed(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "recording_id string, v int")
    path = str(tmp_path / "parts")
    assert tables.write_parts(df.filter("recording_id = 'A'"), path) == 1
    changed = df.withColumn("v", F.col("v") * 10)
    assert tables.write_parts(changed, path) == 1
    assert {r.recording_id: r.v for r in spark.read.parquet(path).collect()} == {"A": 1, "B": 20}
    assert tables.write_parts(changed, path, overwrite=True) == 2
    assert {r.recording_id: r.v for r in spark.read.parquet(path).collect()} == {"A": 10, "B": 20}


def test_damaged_parts_are_written_again(spark, tmp_path):
    rows = [(k, i, float(i) / 3) for k in ("A", "B", "C", "D") for i in range(50)]
    df = spark.createDataFrame(rows, "recording_id string, v int, w double")
    path = str(tmp_path / "parts")
    assert tables.write_parts(df, path) == 4 and tables.write_parts(df, path) == 0
    files_of = lambda k: sorted((tmp_path / "parts" / f"recording_id={k}").glob("*.parquet"))
    files_of("B")[0].write_bytes(b"no parquet")  # cannot be read
    for f in (tmp_path / "parts" / "recording_id=B").glob(".*.crc"):
        f.unlink()
    one = df.filter("recording_id = 'C'").withColumn("v", F.when(F.col("v") == 7, 8).otherwise(F.col("v")))  # one value differs
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").parquet(path)
    assert tables.write_parts(df, path) == 2 and tables.write_parts(df, path) == 0
    back = spark.read.parquet(path)
    assert sorted((r.recording_id, r.v, r.w) for r in back.collect()) == sorted(rows)


def test_parts_take_one_file_unless_they_are_large(spark, tmp_path):
    rows = [(k, i) for k, n in (("A", 10), ("B", 200), ("C", 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "recording_id string, v int").repartition(4)
    path = str(tmp_path / "parts")
    assert tables.write_parts(df, path, file_rows=100) == 3 and tables.write_parts(df, path, file_rows=100) == 0
    files_of = lambda k: len(list((tmp_path / "parts" / f"recording_id={k}").glob("*.parquet")))
    assert (files_of("A"), files_of("C")) == (1, 1) and files_of("B") > 1
    assert not list((tmp_path / "parts" / tables.DIGESTS).glob("recording_id=*"))  # one table, not a folder for each part
    once = df.filter("recording_id <> 'B' or v > 0")
    assert tables.write_parts(once, path, overwrite=True, file_rows=100) == 3 and tables.write_parts(once, path) == 0
    df.filter("recording_id = 'B'").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").parquet(path)
    assert tables.write_parts(once, path) == 1  # what an earlier generation noted is no longer valid
    assert sorted(map(tuple, spark.read.parquet(path).select("recording_id", "v").collect())) == sorted(r for r in rows if r != ("B", 0))


def test_links_in_any_spelling(spark):
    html = """<A HREF='x/one.edf'> <a class="b" href=two.edf?v=1> <a
      href = "d/three%20b.edf#top"> <a href="bad%zz.edf"> <area href="no.edf"> <a data-href="no2.edf" title='>' href='four.edf'>"""
    got = {r.filename for r in files.linked_names(spark.createDataFrame([(html,)], "html string")).collect()}
    assert got >= {"one.edf", "two.edf", "three b.edf", "bad%zz.edf", "four.edf"} and "no.edf" not in got


def test_parts_keep_text_keys(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("012", 2), ("012", 3)], "recording_id string, v int")
    path = str(tmp_path / "parts")
    assert tables.write_parts(df, path) == 2 and tables.write_parts(df, path) == 0


def test_recordings_share_folders(spark, tmp_path):
    """Files follow the folders, not the recordings; a damaged recording is written again and the others of its folder stay."""
    rows = [(f"R{k}", i) for k in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, "recording_id string, v int").repartition(3)
    path = str(tmp_path / "parts")
    kept = df.filter("recording_id <> 'R7'")
    assert tables.write_parts(kept, path, folders=4) == 39 and tables.write_parts(kept, path, folders=4) == 0
    found = sorted((tmp_path / "parts").glob("part_folder=*/*.parquet"))
    assert len(found) == 4
    changed = df.withColumn("v", F.col("v") * 10)
    assert tables.write_parts(changed, path, folders=4) == 1  # R7 is new; what is there and whole is kept
    back = lambda: sorted((r.recording_id, r.v) for r in spark.read.parquet(path).collect())
    assert back() == sorted((k, v * 10 if k == "R7" else v) for k, v in rows)
    tables.replace_folders(tables.in_folders(spark.read.parquet(path).drop(tables.FOLDER).filter("recording_id <> 'R3' or v > 2"), "recording_id", 4), path)
    hit = sorted((tmp_path / "parts").glob("part_folder=*/*.parquet"))[0]
    lost = {r.recording_id for r in spark.read.parquet(str(hit)).collect()} | {"R3"}
    hit.write_bytes(b"no parquet")
    for f in hit.parent.glob(".*.crc"):
        f.unlink()
    assert tables.write_parts(df, path, folders=4) == len(lost) and tables.write_parts(df, path, folders=4) == 0
    assert back() == sorted((k, v * 10 if k == "R7" and k not in lost else v) for k, v in rows)
    assert tables.write_parts(df.filter("recording_id = 'R5'").withColumn("v", F.lit(1)), path, overwrite=True, folders=4) == 1
    assert [v for k, v in back() if k == "R5"] == [1] * 5 and len(back()) == 200
