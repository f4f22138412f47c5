import json

from sitewright.sources import readers, writers


def test_design_inputs_from_csv_and_json(spark, tmp_path):
    (tmp_path / "recipients.csv").write_text('gene,start,note\nA,10,"x, y"\nB,,\n')
    rows = readers.design_inputs(spark, str(tmp_path / "recipients.csv"), "gene string, start bigint, note string").collect()
    assert [tuple(r) for r in rows] == [("A", 10, "x, y"), ("B", None, None)]
    (tmp_path / "tracks.json").write_text(json.dumps([{"name": "t", "strand": "+"}, {"name": "u"}], indent=1))
    rows = readers.design_inputs(spark, str(tmp_path / "tracks.json"), "name string, strand string", fmt="json").collect()
    assert sorted((r.name, r.strand) for r in rows) == [("t", "+"), ("u", None)]


def test_whole_texts_and_manifest(spark, tmp_path):
    import hashlib

    for name, text in (("a.txt", "one\ntwo"), ("b.txt", "three"), ("c.log", "no")):
        (tmp_path / name).write_text(text)
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in readers.whole_texts(spark, str(tmp_path), pattern="*.txt").collect()}
    assert texts == {"a.txt": "one\ntwo", "b.txt": "three"}
    found = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in readers.file_manifest(spark, str(tmp_path)).collect()}
    assert found["b.txt"] == (5, hashlib.sha256(b"three").hexdigest()) and len(found) == 3


def test_manifest_of_a_file_above_two_gigabytes(spark, tmp_path):
    import hashlib

    size, last = (1 << 31) + 5, b"the end"
    (tmp_path / "sub dir").mkdir()
    with open(tmp_path / "sub dir" / "large%20é.bin", "wb") as file:  # a sparse file takes no room
        file.seek(size)
        file.write(last)
    (tmp_path / "small.bin").write_bytes(b"small")
    expected, zeros = hashlib.sha256(), bytes(1 << 20)
    for at in range(0, size, len(zeros)):
        expected.update(zeros[: size - at])
    expected.update(last)
    found = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in readers.file_manifest(spark, str(tmp_path)).collect()}
    assert found == {"large%20é.bin": (size + len(last), expected.hexdigest()), "small.bin": (5, hashlib.sha256(b"small").hexdigest())}
    assert readers.file_manifest(spark, str(tmp_path), pattern="*.none").collect() == []


def test_manifest_of_a_store_that_only_spark_reads(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"\n\x00\xff")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.manifest.link./in", f"file://{tmp_path}")
    try:
        rows = readers.file_manifest(spark, "viewfs://manifest/in").collect()
    finally:
        conf.unset("fs.viewfs.mounttable.manifest.link./in")
    assert [(r.path, r.bytes, r.sha256) for r in rows] == [("viewfs://manifest/in/a.bin", 3, hashlib.sha256(b"\n\x00\xff").hexdigest())]


def test_manifest_of_large_files_of_a_store_that_only_spark_reads(spark, tmp_path):
    import hashlib

    import pytest

    rng = __import__("random").Random(5)
    files = {
        "random.bin": rng.randbytes(300_000), "ends.bin": b"a\n\nb\r\n\xff\xfe\n", "no end.bin": b"\n\n\x00\r" * 9 + b"z", "newlines.bin": b"\n" * 25_000,
        "one%20line.bin": b"x" * 70_000, "small.bin": b"small",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    conf, mount = spark.sparkContext._jsc.hadoopConfiguration(), "fs.viewfs.mounttable.large.link./in"
    conf.set(mount, f"file://{tmp_path}")
    try:
        found = {r.path: (r.bytes, r.sha256) for r in readers.file_manifest(spark, "viewfs://large/in", largest_value=8).collect()}
        assert found == {f"viewfs://large/in/{n}": (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
        (tmp_path / "marked.bin").write_bytes(b"\xef\xbb\xbf" + b"x" * 20)
        with pytest.raises(Exception, match="its lines"):  # never another file's digest
            readers.file_manifest(spark, "viewfs://large/in", largest_value=8)
    finally:
        conf.unset(mount)


def test_appended_results(spark, tmp_path):
    first = spark.createDataFrame([(1, "a")], "k int, v string")
    for df in (first, spark.createDataFrame([(2, "b")], "k int, v string")):
        writers.append_results(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b")]


def test_general_floats_are_rounded_from_their_exact_value(spark):
    from pyspark.sql import functions as F

    from sitewright.functions.expressions import format_general

    values = [16516654225.0, 2395.2356725, 1e-5, -0.5, 0.0, 1e23, 123.0, None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", format_general(F.col("x")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: None if v is None else "%.10g" % v for i, v in enumerate(values)}


def test_repair_shares_do_not_send_an_experiment_to_one_task(spark):
    rows = spark.createDataFrame([("e", str(10 + i % 7), str(i), "*/+A") for i in range(50)] + [(None, "3", "1", "*/-C")], ["experiment", "Reads", "Position (hg18)", "Cons"])
    found = readers.repair_outcomes(rows, experiment="experiment")
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert sorted(r.rank_in_experiment for r in got if r.experiment) == list(range(1, 51))
    assert abs(sum(r.share for r in got if r.experiment) - 1) < 1e-12 and [r.share for r in got if r.experiment is None] == [1.0]
