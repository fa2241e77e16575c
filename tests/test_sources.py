"""File readers and writers."""

import gzip
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from epochwise.operators import profile
from epochwise.sources import annotations, files, samples


def test_wide_csv_with_a_repeated_header_and_a_bad_file(spark, tmp_path):
    header = "time_s,A-B (uV),C-D (uV),A-B (uV)"
    for name in ("p01_1", "p01_2"):
        lines = [header] + [f"{i / 4},{i},{i + 10},{i + 20}" for i in range(4)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    (tmp_path / "p02_1.csv").write_text("not a sample file\nnothing here\n")
    got = samples.read_wide_csv(spark, str(tmp_path), header.split(","), 4.0, subject=r"([a-z]\d+)_[^/]*$")
    assert got.columns == samples.SAMPLES.fieldNames()
    assert {r.channel for r in got.select("channel").distinct().collect()} == {"A-B", "C-D", "A-B_2"}
    assert got.count() == 24
    row = got.filter("recording = 'p01_2' AND idx = 3 AND channel = 'A-B_2'").first()
    assert (row.subject, row.value) == ("p01", 23.0)
    bad = samples.damaged_csv(spark, str(tmp_path), header.split(",")).collect()
    assert [(os.path.basename(r.path), r.reason) for r in bad] == [("p02_1.csv", "malformed lines")]


def test_cut_gzip_is_left_out_whole(spark, tmp_path):
    header = "time_s,A"
    text = "\n".join([header] + [f"{i / 4},{i * 7919 % 1000}" for i in range(20_000)])
    packed = gzip.compress(text.encode())
    (tmp_path / "p01_1.csv.gz").write_bytes(packed)
    (tmp_path / "p02_1.csv.gz").write_bytes(packed[: len(packed) // 2])
    bad = samples.damaged_csv(spark, str(tmp_path), header.split(",")).collect()
    assert [(os.path.basename(r.path), r.reason) for r in bad] == [("p02_1.csv.gz", "cut short")]
    got = samples.read_wide_csv(spark, str(tmp_path), header.split(","), 4.0, recording=r"([^/.]+)\.[^/]*$")
    assert {r.recording: r["count"] for r in got.groupBy("recording").count().collect()} == {"p01_1": 20_000}


def test_damaged_parquet_is_left_out_whole(spark, tmp_path):
    good = spark.createDataFrame([("s", "r", "c", 0, 1.0)], samples.SAMPLES)
    good.coalesce(1).write.parquet(str(tmp_path / "d"))
    (tmp_path / "d" / "bad.parquet").write_bytes(b"not parquet at all")
    n = 40_000
    table = pa.table({"subject": ["s"] * n, "recording": ["half"] * n, "channel": ["c"] * n, "idx": range(n), "value": [float(i * 37 % 1009) for i in range(n)]})
    half = tmp_path / "d" / "half.parquet"
    pq.write_table(table, half, row_group_size=5000, compression="snappy", use_dictionary=False)
    meta = pq.ParquetFile(half).metadata
    at = meta.row_group(5).column(4).data_page_offset  # a page of a later row group; the footer stays whole
    raw = bytearray(half.read_bytes())
    raw[at : at + 400] = b"\xff" * 400
    half.write_bytes(bytes(raw))
    assert samples.read_parquet(spark, str(tmp_path / "d")).count() == 1
    bad = {os.path.basename(r.path): (r.reason, r.lost) for r in samples.damaged_parquet(spark, str(tmp_path / "d")).collect()}
    assert bad["bad.parquet"] == ("no rows", None)
    assert bad["half.parquet"][0] == "rows missing" and 0 < bad["half.parquet"][1] <= n


def test_same_names_in_two_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "abc01_01.edf").write_text("x")
    found = files.discover(files.list_files(spark, str(tmp_path), "*.edf"))
    assert found.count() == 2 and found.select("path").distinct().count() == 2


def test_only_a_missing_path_means_no_results(spark, tmp_path):
    schema = spark.createDataFrame([], "a long").schema
    assert files.read_results(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(AnalysisException):
        files.read_results(spark, "nosuchscheme" + "://x", "a notatype")


def test_segment_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,X1,X2,X3,y\nV1,1,2,3,1\nV2,4,5,6,4\n")
    got = samples.read_segment_csv(spark, str(tmp_path / "s.csv"), 3).orderBy("id").collect()
    assert [(r.x, r.cls, r.y) for r in got] == [([1.0, 2.0, 3.0], 1, 1), ([4.0, 5.0, 6.0], 4, 0)]


def test_discovery(spark, tmp_path):
    for name in ("abc17a_03.edf", "abc17b_57.edf", "abc17b_57.edf.1", "abc01_01.edf", "notes.txt"):
        (tmp_path / name).write_text("x")
    found = files.discover(files.list_files(spark, str(tmp_path), "*.edf*"))
    got = {(r.subject, r.recording) for r in found.collect()}
    assert got == {("abc17", "abc17a_03.edf"), ("abc17", "abc17b_57.edf"), ("abc01", "abc01_01.edf")}


def test_cache_prunes_folders(spark, hub, tmp_path):
    path = str(tmp_path / "cache")
    files.write_cache(hub.emb, path, id_col="id")
    back = files.read_cache(spark, path, hub.emb.schema, ["s2"])
    assert back.count() == hub.emb.filter("subject = 's2'").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subject" in plan
    one = [f for f in os.listdir(os.path.join(path, "subject=s2")) if f.endswith(".parquet")]
    assert 1 <= len(one) <= 8


def test_bibliography(spark, tmp_path):
    (tmp_path / "r.bib").write_text(
        '@article{k1,\n  author = {A. B.},\n  title = {A {Big} study of {{two}} things},\n  journal={J. of X},\n  year=2020,\n}\n'
        '@inproceedings{k2,\n  booktitle = "Proc. of Y",\n  title = "Plain\n   title",\n  year = {2021}\n}\n'
    )
    raw = annotations.read_text_files(spark, str(tmp_path / "r.bib"))
    got = [tuple(r) for r in files.parse_bib(raw).orderBy("key").collect()]
    assert got == [
        ("k1", "A Big study of two things", "J. of X", "2020", "A Big study of two things J. of X 2020"),
        ("k2", "Plain title", "Proc. of Y", "2021", "Plain title Proc. of Y 2021"),
    ]


def test_results_default(spark, tmp_path):
    schema = spark.range(1).withColumn("m", F.struct(F.lit(1.5).alias("x"))).schema
    fallback = spark.range(1).withColumn("m", F.struct(F.lit(0.0).alias("x")))
    missing = str(tmp_path / "none")
    assert files.read_results(spark, missing, schema).count() == 0
    assert files.read_results(spark, missing, schema, fallback).first().m.x == 0.0
    files.write_results(spark.range(3).withColumn("m", F.struct(F.lit(1.5).alias("x"))), str(tmp_path / "r"))
    assert files.read_results(spark, str(tmp_path / "r"), schema).filter("m.x = 1.5").count() == 3


def test_audit_only_grows(spark, tmp_path):
    path = str(tmp_path / "audit")
    for run in ("a", "b", "b"):
        files.append_audit(files.audit_rows(spark.range(2), "check", run), path)
    got = files.read_audit(spark, path)
    assert {r.run_id: r["count"] for r in got.groupBy("run_id").count().collect()} == {"a": 2, "b": 4}


def test_manifest_and_norm_stats(spark, tmp_path):
    split = {"subject_ids": ["p1", "p2"], "n_subjects": 2, "n_windows": 9, "class_counts": {"x": 9}}
    (tmp_path / "m.json").write_text(json.dumps({"_metadata": {"v": 1}, "datasets": {"d": {"total_subjects": 2, "splits": {"train": split}}}}, indent=1))
    got = files.manifest_rows(files.read_manifest(spark, str(tmp_path / "m.json"))).collect()
    assert sorted(map(tuple, got)) == [("d", "train", "p1"), ("d", "train", "p2")]
    long = spark.createDataFrame([("c", float(v)) for v in (1, 2, 3, 4, 100)], "channel string, value double")
    row = files.norm_stats_rows(files.norm_stats_json(profile.robust_stats(long, ["channel"]))).first()
    assert (row.median, row.iqr, row.n_samples) == (3.0, 2.0, 5)
    assert row["mean"] == pytest.approx(22.0)


def test_ledger_validates_each_file_once(spark, tmp_path):
    from epochwise.sources import ingest

    folder, ledger = tmp_path / "d", str(tmp_path / "ledger")
    spark.createDataFrame([("s", "r", "c", 0, 1.0)], samples.SAMPLES).coalesce(1).write.parquet(str(folder))
    assert ingest.validate(spark, str(folder), ledger) == 1 and ingest.validate(spark, str(folder), ledger) == 0
    (folder / "bad.parquet").write_bytes(b"not parquet at all")
    n = 40_000
    table = pa.table({"subject": ["s"] * n, "recording": ["half"] * n, "channel": ["c"] * n, "idx": range(n), "value": [float(i * 37 % 1009) for i in range(n)]})
    half = folder / "half.parquet"
    pq.write_table(table, half, row_group_size=5000, compression="snappy", use_dictionary=False)
    whole = half.read_bytes()
    at = pq.ParquetFile(half).metadata.row_group(5).column(4).data_page_offset
    half.write_bytes(whole[:at] + b"\xff" * 400 + whole[at + 400 :])
    assert ingest.read_samples(spark, str(folder), ledger).count() == 1
    bad = {os.path.basename(r.path): (r.reason, r.lost) for r in ingest.damaged(spark, str(folder), ledger).collect()}
    assert bad["bad.parquet"] == ("no rows", None)
    assert bad["half.parquet"][0] == "rows missing" and 0 < bad["half.parquet"][1] <= n
    assert ingest.validate(spark, str(folder), ledger) == 0
    # the same file, mended: another version of it
    half.write_bytes(whole)
    os.utime(half, (1, 1))
    assert ingest.validate(spark, str(folder), ledger) == 1
    assert ingest.read_samples(spark, str(folder), ledger).count() == n + 1
    assert [os.path.basename(r.path) for r in ingest.damaged(spark, str(folder), ledger).collect()] == ["bad.parquet"]


def test_unreadable_text_files_are_found_among_many(spark, tmp_path):
    packed = gzip.compress(b"some line\n" * 5000)
    for i in range(9):
        (tmp_path / f"f{i}.gz").write_bytes(packed if i not in (2, 7) else packed[:-12])
    found = samples.unreadable(spark, [str(tmp_path / f"f{i}.gz") for i in range(9)])
    assert [os.path.basename(p) for p in found] == ["f2.gz", "f7.gz"]
    assert samples.unreadable(spark, []) == []
