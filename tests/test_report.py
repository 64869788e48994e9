"""Counts of stages, failures as rows, worker logs, batches of fixed size, and files in tasks."""

from __future__ import annotations

import os

import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from millrace.operators import frame, native, report, sequence
from millrace.plans.runner import modify
from millrace.sources import local


def test_counts_of_every_stage_without_a_job(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") % 10).write.parquet(f"{tmp_path}/in")
    counts = report.Counts()
    spark.sparkContext.setJobGroup("counted", "the run")
    modify(spark, f"{tmp_path}/in", f"{tmp_path}/out", [lambda df: df.filter("id >= 30"), frame.deduplicate("v"), frame.rename({"v": "w"})], counts=counts)
    spark.sparkContext.setJobGroup("report", "the report")
    rows = [tuple(r) for r in counts.table(spark).select("stage", "name", "rows").orderBy("stage").collect()]
    assert [r[2] for r in rows] == [100, 70, 10, 10] and [r[1] for r in rows[2:]] == ["deduplicate", "rename"]
    counts = report.Counts()
    df = spark.range(50).transform(counts.watch("odd ones", odd=F.col("id") % 2 == 1)).filter("id < 0")
    df.write.format("noop").mode("overwrite").save()
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("report"))
    assert counts.stages[0][1].get == {"rows": 50, "odd": 25}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("report")) == before


def test_failures_stand_beside_results(spark):
    df = spark.createDataFrame([(1, "2", "x"), (2, None, "x"), (3, "no", "x"), (4, "0", "x")], "id long, v string, error string").repartition(2)

    def parts(row):
        n = int(row["v"])
        for k in range(n):
            yield {"k": k}
        if n == 0:
            yield {"error": "nothing in it"}

    tried = report.attempt(df, parts, "k long")
    assert tried.columns == ["id", "v", "k", "error"]
    good, bad = report.divided(tried)
    assert sorted(map(tuple, good.collect())) == [(1, "2", 0), (1, "2", 1)]
    errors = {r.id: r.error for r in bad.collect()}
    assert errors[3].startswith("ValueError: ") and errors[2].startswith("TypeError: ") and errors[4] == "nothing in it"
    assert report.attempt(df.limit(0), parts, "k long").count() == 0


def test_a_row_that_fails_late_keeps_none_of_its_results(spark):
    def late(row):
        yield {"k": 1}
        raise KeyError("late")

    rows = report.attempt(spark.range(3), late, "k long").collect()
    assert [(r.id, r.k, r.error) for r in sorted(rows)] == [(k, None, "KeyError: 'late'") for k in range(3)]


def test_disassembly_says_what_was_dropped(spark):
    def disassembler(binary):
        if binary == b"bad":
            raise native.UnhandledToken("odd token")
        yield "good", binary[:1], ["mov eax 1", "ret"]
        yield "invalid", binary[1:], None

    df = spark.createDataFrame([("1", bytearray(b"ok")), ("2", bytearray(b"bad"))], "id string, binary binary")
    rows = {(r.id, r.name): r for r in native.disassembly_attempts(df, disassembler).collect()}
    assert rows["1", "good"].disassembly == "mov eax 1 [NEXT] ret" and rows["1", "good"].error is None and bytes(rows["1", "good"].binary) == b"o"
    assert rows["1", "invalid"].error == "invalid instruction" and rows["2", None].error == "UnhandledToken: odd token" and len(rows) == 3


def test_worker_logs_are_a_table(spark):
    spark.conf.set(report.LOGGING, "true")
    try:

        def parse(row):
            raise ValueError("never")
            yield

        report.attempt(spark.range(5), parse, "k long").write.format("noop").mode("overwrite").save()
        told = [r.msg for r in report.worker_logs(spark).filter("logger like 'millrace%'").collect()]
        assert told and all("dropped, the first for ValueError: never" in m for m in told)
    finally:
        spark.conf.unset(report.LOGGING)


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_batches_have_a_fixed_size(spark, size):
    rows = spark.range(50).select((F.lit(49) - F.col("id")).alias("k"), F.array("id").alias("t"))
    want = [list(range(at, min(at + size, 50))) for at in range(0, 50, size)]
    for n in (1, 9):
        got = sequence.batches(rows.repartition(n), size, "k").orderBy("batch").collect()
        assert [r.k for r in got] == want and [r.rows for r in got] == list(map(len, want))
        assert [r.t for r in got] == [[[49 - k] for k in b] for b in want]
    assert sequence.batches(rows.limit(0), 3, "k").count() == 0
    with pytest.raises(ValueError):
        sequence.batches(rows, 0, "k")


def test_a_file_reaches_tasks_and_a_changed_one_is_another(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_text("one")
    first = local.distributed(spark, str(path))
    assert local.distributed(spark, str(path)) == first

    def read(name):
        def each(batches):
            with open(SparkFiles.get(name)) as f:
                text = f.read()
            for batch in batches:
                yield batch.assign(text=text)

        return {r.text for r in spark.range(8).repartition(4).mapInPandas(each, "id long, text string").collect()}

    assert read(first) == {"one"}
    path.write_text("two")
    os.utime(path, (1, 1))
    second = local.distributed(spark, str(path))
    assert second != first and read(second) == {"two"} and read(first) == {"one"}


def test_the_package_is_whole_in_its_archive(tmp_path):
    import subprocess
    import sys

    from millrace.session import archive

    (tmp_path / "package.zip").write_bytes(archive())
    code = "import millrace.catalog, millrace.streaming.queue as q; print(q.__file__, len(millrace.catalog.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path / "package.zip")}, capture_output=True, text=True, check=True)
    assert "package.zip" in done.stdout


def test_binaries_are_numbered_by_path_without_their_contents(spark, tmp_path):
    from millrace.plans import pipelines
    from millrace.sources import text

    for k, name in enumerate(("b/1/x-x86_64-1", "a/2/y-x86_64-1", "a/1/z-x86_64-1", "c/1/no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(bytes([k]))
    for most in (500_000, 1):
        found = pipelines.numbered_binaries(text.binaries(spark, str(tmp_path)), most)
        assert {(r.id, r.project, r.version, bytes(r.binary)) for r in found.collect()} == {("0", "a", "1", b"\x02"), ("1", "a", "2", b"\x01"), ("2", "b", "1", b"\x00")}


def test_a_slurm_job_runs_its_command_on_a_cluster(tmp_path):
    """The script as it is, with a stand-in for the scheduler's launcher: the package reaches the executors by itself."""
    import socket
    import subprocess
    import sys

    from millrace.session import slurm_job

    with socket.socket() as s:
        s.bind(("", 0))
        port = s.getsockname()[1]
    srun = tmp_path / "bin" / "srun"
    srun.parent.mkdir()
    srun.write_text('#!/bin/bash\nshift\nexec "$@"\n')
    srun.chmod(0o755)
    job = tmp_path / "job.py"
    job.write_text(
        f"import sys\nsys.path.insert(0, {os.getcwd()!r})\n"
        "from millrace.session import cluster\nfrom millrace.operators import report\n"
        "def double(row):\n    yield {'k': 2 * row['id']}\n"
        "spark = cluster('slurm', memory='600m', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2', 'spark.driver.host': '127.0.0.1'})\n"
        "assert spark.sparkContext.master.startswith('spark://')\n"
        "print('sum', report.attempt(spark.range(10), double, 'k long').agg({'k': 'sum'}).first()[0])\nspark.stop()\n"
    )
    script = slurm_job([sys.executable, str(job)], cores=1, memory="1GB", port=port)
    assert "#SBATCH --ntasks=1" in script and "#SBATCH --mem-per-cpu=1000M" in script
    env = {**os.environ, "PATH": f"{srun.parent}:{os.path.dirname(sys.executable)}:{os.environ['PATH']}", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOG_DIR": str(tmp_path), "SPARK_WORKER_DIR": str(tmp_path / "work"), "PYSPARK_PYTHON": sys.executable}
    env.pop("PYTHONPATH", None)
    done = subprocess.run(["bash", "-c", script.replace("$(hostname)", "127.0.0.1")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "sum 90" in done.stdout, done.stderr[-3000:]
    assert done.returncode == 0


def test_model_input_has_its_shape(spark):
    good = spark.createDataFrame([([7, 8, 5, 9],)], "tokens array<int>")
    row = sequence.model_input(good, 4, 10).first()
    assert (row.tokens, row.instruction, row.argument, row.position) == ([7, 8, 5, 9], [0, 0, 0, 1], [0, 1, 2, 0], [0, 1, 2, 3])
    for tokens, told in (([7], "not 1"), (None, "not -1"), ([1, 2, None, 4], "ids of the vocabulary"), ([1, 2, 3, 10], "10"), ([-1, 0, 0, 0], "-1")):
        with pytest.raises(Exception, match=told):
            sequence.model_input(spark.createDataFrame([(tokens,)], "tokens array<int>"), 4, 10).collect()
    for kind in ("string", "array<array<int>>", "array<double>"):
        with pytest.raises(ValueError):
            sequence.model_input(spark.createDataFrame([], f"tokens {kind}"), 4)


def test_vulnerable_binaries_from_files_to_project_folders(spark, tmp_path):
    import json

    from millrace.plans import pipelines

    for k, name in enumerate(("alpha/1.0/alpha-x86_64-a", "alpha/2.0/alpha-x86_64-b", "beta/1.0/beta-i686-c", "beta/1.0/beta-arm-d", "ffmpeg/1.0/ff-x86_64-e")):
        (tmp_path / "bin" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "bin" / name).write_bytes(bytes([65 + k]))
    record = {"repo": "alpha", "cve_name": "CVE-1", "function_names": "f", "binary_version": "2.0"}
    (tmp_path / "map.json").write_text(json.dumps({"x": [record]}))

    def disassembler(binary):
        yield "f", binary + b"f", ["ret"]

    pipelines.build_vulnerable(spark, str(tmp_path / "bin"), [str(tmp_path / "map.json")], disassembler, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("project=*")) == ["project=alpha", "project=beta"]
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.project, bytes(r.binary)) for r in rows} == {("alpha", b"Af"), ("alpha", b"Bf"), ("beta", b"Cf")}
    found = {bytes(r.binary): r.vulnerability for r in rows}
    assert found[b"Bf"] == "CVE-1" and found[b"Af"] != "CVE-1"


@pytest.mark.parametrize("parts", [1, 5])
def test_random_split_is_a_split(spark, parts):
    """Whatever the partitions: every row in one part, shares near the percentages, the same again with the same seed."""
    from millrace.operators import split

    df = spark.range(0, 4000, 1, parts)
    found = split.random_split(df, {"train": 80, "valid": 15, "test": 5}, seed=3)
    ids = {k: sorted(r.id for r in v.collect()) for k, v in found.items()}
    assert sorted(sum(ids.values(), [])) == list(range(4000))
    assert all(abs(len(ids[k]) / 40 - p) < 4 for k, p in (("train", 80), ("valid", 15), ("test", 5)))
    assert {k: sorted(r.id for r in v.collect()) for k, v in split.random_split(df, {"train": 80, "valid": 15, "test": 5}, seed=3).items()} == ids


def test_runs_leave_no_staged_tables(spark, tmp_path):
    from millrace.plans import pipelines
    from millrace.sources.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    spark.range(40).selectExpr("cast(id as string) as id", "id % 7 as v").write.parquet(f"{tmp_path}/in")
    modify(spark, f"{tmp_path}/in", f"{tmp_path}/out", [lambda df: frame.number(df, "place", "v"), frame.repartition(size="100B")])
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.max("place")).first()[0] == 39
    traces = spark.createDataFrame([("1", "f", "mov eax 123456 [NEXT] ret")] * 3, "id string, name string, disassembly string")
    assert pipelines.train_tokenizer(traces, 16, 60) is not None
    assert set(os.listdir(folder)) == before
