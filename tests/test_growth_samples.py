import contextlib
import io

from brookmill.sources import samples


def test_places_are_searched_in_the_end_of_a_path_only(spark, tmp_path):
    deep = tmp_path / ("x" * 60) / "part-of-a-long-name" / "k=v"
    for place in ("host=n1/instance=cpu-a/file=percent-idle/part-0.txt", "n2/disk-b/disk_octets"):
        (deep / place).parent.mkdir(parents=True)
        (deep / place).write_text("5: 1 2\n")
    rows = samples.read_samples(spark, str(tmp_path))
    got = sorted((r["host"], r["instance"], r["metric"], r["metric_path"], r["ts"], r["v1"], r["v2"]) for r in rows.collect())
    assert got == [("n1", "cpu-a", "cpu", "n1/cpu-a/percent-idle", 5, 1.0, 2.0), ("n2", "disk-b", "disk", "n2/disk-b/disk_octets", 5, 1.0, 2.0)]
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        rows.explain()
    assert "substring_index" in plan.getvalue()
