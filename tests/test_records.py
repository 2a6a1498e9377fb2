import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmill.functions.binary import prefix_number, unsigned_bytes
from brookmill.operators import records as ops
from brookmill.sources import fixedwidth, records_gen
from brookmill.sources.records_gen import record_block, states_at, states_from

KEYS = {0: "4a696d47726179524950", 1: "95e0e48262b3edfe0447", 2: "45979353dbed5329365c", 999: "4d15a82070c03ee39bf5"}
FIRST = (
    "4a696d477261795249500011" + "30" * 32 + "8899aabb" + "32323232303030303232323230303030" * 2
    + "32323232303030303030303031313131" + "ccddeeff"
)


def test_golden_records():
    block = record_block(np.arange(1000))
    assert bytes(block[0]).hex() == FIRST
    assert {n: bytes(block[n, :10]).hex() for n in KEYS} == KEYS
    sums = [sum(zlib.crc32(bytes(r[:10])) for r in block[:n]) for n in (10, 1000)]
    assert [f"{s:x}" for s in sums] == ["562dc112f", "1eea4a93bef"]


def test_any_start_gives_the_same_sequence():
    assert (states_from(500, 77) == states_from(0, 577)[500:]).all()
    numbers = np.array([3, 999, 0, 12345])
    assert (states_at(numbers) == np.vstack([states_from(int(n), 1) for n in numbers])).all()


def test_generated_table_does_not_depend_on_partitions(spark):
    a = records_gen.generate_records(spark, 100_000, 4)
    b = records_gen.generate_records(spark, 100_000, 1)
    assert a.count() == b.count() == 1000
    assert a.exceptAll(b).isEmpty()
    assert ops.checksum(a).first()[0] == "1eea4a93bef"
    assert records_gen.generate_records(spark, 10_750, 3).count() == 105


def test_write_sort_read_validate(spark, tmp_path):
    folder, ordered = str(tmp_path / "raw"), str(tmp_path / "sorted")
    fixedwidth.write_records(records_gen.generate_records(spark, 600_000, 3), folder)
    raw = fixedwidth.read_records(spark, folder, splitBytes=70_000)
    assert raw.count() == 6000 and raw.rdd.getNumPartitions() > 3
    report = ops.validate_records(raw).first()
    assert (report["records"], report["checksum"]) == (6000, "bbc6c699432")
    assert report["inside_disorders"] > 0
    for sampled in (False, True):
        fixedwidth.write_records(ops.sort_records(raw, 4, sampled), ordered, sync="true")
        report = ops.validate_records(fixedwidth.read_records(spark, ordered, splitBytes=50_000)).first()
        assert tuple(report) == (6000, "bbc6c699432", 0, 0)
    keys = [r["key"] for r in fixedwidth.read_records(spark, ordered).orderBy("path", "record").select("key").collect()]
    assert keys == sorted(keys)


def test_border_and_inside_disorder_are_told_apart(spark):
    rows = [("a", 0, b"\x01"), ("a", 1, b"\x05"), ("a", 2, b"\x04"), ("b", 0, b"\x03"), ("b", 1, b"\xff")]
    df = spark.createDataFrame(rows, "path string, record bigint, key binary").coalesce(1).withColumn("value", F.lit(b""))
    report = ops.validate_records(df).first()
    assert (report["records"], report["inside_disorders"], report["border_disorders"]) == (5, 1, 1)
    assert [r["path"] for r in ops.border_violations(df).collect()] == ["b"]
    assert [r["record"] for r in ops.adjacent_violations(df, "path", "record").collect()] == [2]


def test_append_keeps_and_overwrite_replaces(spark, tmp_path):
    folder, some = str(tmp_path / "r"), records_gen.generate_records(spark, 1000, 1)
    fixedwidth.write_records(some, folder)
    fixedwidth.write_records(some, folder, mode="append")
    assert fixedwidth.read_records(spark, folder).count() == 20
    fixedwidth.write_records(some, folder)
    assert fixedwidth.read_records(spark, folder).count() == 10


def files_of(folder):
    return sorted(f.name for f in folder.iterdir() if f.is_file())


def test_only_what_a_manifest_lists_is_read(spark, tmp_path):
    folder, some = tmp_path / "r", records_gen.generate_records(spark, 3000, 3)
    fixedwidth.write_records(some, str(folder))
    assert len(files_of(folder)) == 3
    (folder / "part-000000-lost-17").write_bytes(b"x" * 100)  # left by an attempt that failed
    assert fixedwidth.read_records(spark, str(folder)).count() == 30
    fixedwidth.write_records(some, f"file://{folder}", mode="append", sync="true")
    assert fixedwidth.read_records(spark, f"file:{folder}").count() == 60
    fixedwidth.write_records(some.limit(0), str(folder))
    assert fixedwidth.read_records(spark, str(folder)).count() == 0 and files_of(folder) == ["part-000000-lost-17"]


def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path):
    folder, some = tmp_path / "r", records_gen.generate_records(spark, 3000, 3)
    fixedwidth.write_records(some, str(folder))
    before = files_of(folder)
    bad = some.unionByName(spark.createDataFrame([(b"short", b"d" * 90)], "key binary, value binary").withColumn("value", F.col("value")), allowMissingColumns=True)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="expected 10 bytes"):
            fixedwidth.write_records(bad, str(folder), mode=mode)
    assert files_of(folder) == before and fixedwidth.read_records(spark, str(folder)).count() == 30


def test_files_without_a_manifest_are_read_and_kept_by_an_append(spark, tmp_path):
    folder, some = tmp_path / "r", records_gen.generate_records(spark, 1000, 1)
    folder.mkdir()
    (folder / "old.bin").write_bytes(b"k" * 200)
    assert fixedwidth.read_records(spark, str(folder)).count() == 2
    fixedwidth.write_records(some, str(folder), mode="append")
    assert fixedwidth.read_records(spark, str(folder)).count() == 12


def test_of_two_jobs_at_once_one_commits(tmp_path):
    make = lambda: fixedwidth._Writer(str(tmp_path), 10, 100, 0, 1, False, False)
    first, second = make(), make()
    first.commit([fixedwidth._Written("part-a", 0)])
    with pytest.raises(RuntimeError, match="another job"):
        second.commit([])


def test_truncated_file_and_bad_width_raise(spark, tmp_path):
    (tmp_path / "bad").write_bytes(b"x" * 150)
    with pytest.raises(Exception, match="whole number"):
        fixedwidth.read_records(spark, str(tmp_path / "bad")).count()
    short = spark.createDataFrame([(b"abc", b"d" * 90)], "key binary, value binary")
    with pytest.raises(Exception, match="expected 10 bytes"):
        fixedwidth.write_records(short, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        fixedwidth.write_records(short, "")


def test_prefix_partition_is_clamped(spark):
    keys = [b"\x00" * 10, b"\x7f" + b"\xff" * 9, b"\xff" * 10]
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    got = [r[0] for r in df.select(ops.prefix_partition(F.col("key"), 8)).collect()]
    assert got == [0, 4, 7] or got == [0, 3, 7]
    assert df.select(F.max(prefix_number(F.col("key")))).first()[0] == 2**56 - 1
    assert df.select(unsigned_bytes(F.col("key"), 2)).collect()[1][0] == "127 255"


def test_wide_hex_is_exact_near_multiples_of_its_base(spark):
    from brookmill.functions.binary import wide_hex

    for n in (0, 1, 2**48 - 1, 2**48, 5 * 2**48 - 1, 5 * 2**48 - 10**8, 2**56 + 5, 2**100 + 7):
        assert spark.range(1).select(wide_hex(F.lit(str(n)).cast("decimal(38,0)"))).first()[0] == f"{n:x}"
