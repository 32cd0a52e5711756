"""Headers of many files in one job."""

import gzip

import pytest

from flowlens.sources import tables


def test_a_thousand_files_of_three_headers(spark, tmp_path):
    heads = ["Flow Duration,Label,Label", "Label,Flow Duration", '"Flow, Duration",Label']
    for i in range(1000):
        (tmp_path / f"f {i:04d}.csv").write_text(f"{heads[i % 3]}\n{i},x,y\n" if i % 3 == 0 else f"\n{heads[i % 3]}\r\nx,{i}\r\n")
    paths = tables.discover(spark, str(tmp_path))
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (300, 1000):
        spark.sparkContext.setJobGroup(f"headers-{n}", "headers")
        try:
            parts = tables.scan(spark, paths[:n])
            jobs.append(len(tracker.getJobIdsForGroup(f"headers-{n}")))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] and [len(p.columns) for p in parts] == [3, 3, 3]  # with the file
    assert sorted(tuple(p.columns[:2]) for p in parts) == [("Flow Duration", "Label"), ("Flow, Duration", "Label"), ("Label", "Flow Duration")]
    first = next(p for p in parts if p.columns[0] == "Flow Duration")
    assert {int(r[0]) for r in first.collect()} == set(range(0, 1000, 3))


def test_heads_by_charset_compression_and_length(spark, tmp_path):
    """Latin letters, a packed file, a header beyond one read, a file of a header alone; an empty file is an error."""
    wide = ",".join(f"column {i}" for i in range(9000))
    (tmp_path / "a.csv").write_bytes("Größe,Label\n1,x\n".encode("latin-1"))
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    (tmp_path / "c.csv").write_text(f"{wide}\n")
    (tmp_path / "d.csv").write_text("a,,b")
    (tmp_path / "e.csv").write_text("\n \n")
    got = {r["path"].rpartition("/")[2]: r["header"] for r in tables.headers(spark, [str(p) for p in tmp_path.iterdir()]).collect()}
    assert got == {"a.csv": ["Größe", "Label"], "b.csv.gz": ["a", "b"], "c.csv": wide.split(","), "d.csv": ["a", "", "b"], "e.csv": None}
    for name in ("a.csv", "d.csv"):
        assert tables.header(spark, str(tmp_path / name)) == got[name]
    with pytest.raises(ValueError, match="empty"):
        tables.scan(spark, [str(tmp_path / "e.csv"), str(tmp_path / "a.csv")])
