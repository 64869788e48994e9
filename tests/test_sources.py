from __future__ import annotations

import io
import json
import sqlite3
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidFileType, PathDoesNotExist, PathExists
from millrace.plans import pipelines
from millrace.sources import archives, local, parquet, shared, text


@pytest.fixture
def folder(tmp_path):
    files = {"test.txt": b"hello world", "sub/data.json": b"[1, 2, 3]"}
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        for name, data in files.items():
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "test.txt"
        t.addfile(link)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    with sqlite3.connect(tmp_path / "raw_data.sqlar") as db:
        db.execute("CREATE TABLE sqlar(name TEXT, mode INT, mtime INT, sz INT, data BLOB)")
        big = b"x" * 1000
        rows = [("d", 0o755, 1, 0, None), ("d/big", 0o644, 1, 1000, zlib.compress(big)), ("d/raw", 0o644, 1, 3, b"abc"), ("ln", 0o777, 1, -1, b"d/raw")]
        db.executemany("INSERT INTO sqlar VALUES (?, ?, ?, ?, ?)", rows)
    (tmp_path / "solutions.sqlar").write_bytes((tmp_path / "raw_data.sqlar").read_bytes())
    (tmp_path / "bad").write_bytes(b"not an archive at all, but long enough")
    return tmp_path


@pytest.mark.parametrize(("name", "kind"), [("a.tgz", "tar"), ("a.zip", "zip")])
def test_members(spark, folder, name, kind):
    got = {r.name: bytes(r.data) for r in archives.scan(spark, str(folder / name), kind).filter("kind = 'file'").collect()}
    assert got == {"test.txt": b"hello world", "sub/data.json": b"[1, 2, 3]"}
    out = archives.extract(str(folder / name), str(folder / f"out-{kind}"), kind)
    assert (folder / out / "sub/data.json").read_bytes() == b"[1, 2, 3]"
    assert archives.extract(str(folder / name), out, kind) == out


def test_sqlar(spark, folder):
    got = {r.name: (r.kind, r.data and bytes(r.data)) for r in archives.scan(spark, str(folder / "raw_data.sqlar"), "sqlar").collect()}
    assert got == {"d": ("directory", None), "d/big": ("file", b"x" * 1000), "d/raw": ("file", b"abc"), "ln": ("link", b"d/raw")}
    assert archives.challenge_members(spark, str(folder)).count() == 8


@pytest.mark.parametrize("kind", ["tar", "zip", "sqlar"])
def test_other_files_raise(folder, kind):
    with pytest.raises(InvalidFileType):
        list(archives.READERS[kind]((folder / "bad").read_bytes()))


def test_members_stay_inside():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("../out", b"x")
    with pytest.raises(InvalidFileType):
        list(archives.zip_members(data.getvalue()))


@pytest.mark.parametrize(("values", "want"), [([1, 2, 3], [1, 2, 3]), ([[1, 2]] * 3, [1, 2] * 3), ([[1, 2], 1, [1, 2]], [1, 2, 1, 1, 2])])
def test_merge_json(spark, tmp_path, values, want):
    for k, v in enumerate(values):
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    rows = text.merge_json(text.json_values(spark, *[str(tmp_path / f"{k}.json") for k in range(len(values))]))
    got = rows.orderBy("file", "pos").select(F.try_variant_get("value", "$", "int").alias("v")).collect()
    assert [r.v for r in got] == want
    text.split_json(spark.range(10), str(tmp_path / "split"), 3)
    assert spark.read.json(str(tmp_path / "split")).count() == 10


def test_samples(spark, tmp_path):
    row = {"task_id": "CPP/0", "prompt": "sum", "declaration": "int f() {", "canonical_solution": " return 1; }"}
    (tmp_path / "s.jsonl").write_text(json.dumps(row) + "\n")
    assert text.samples(spark, str(tmp_path / "s.jsonl")).first().asDict() == {"id": "CPP/0", "source": "int f() { return 1; }", "summary": "sum"}


def test_vulnerabilities(spark, tmp_path):
    data = {
        "x": [
            {"repo": "p", "cve_name": "C1", "function_names": [" F ", "g"], "binary_version": ["1", "2"]},
            {"repo": "p", "cve_name": "C2", "function_names": ["f"]},
            {"repo": "p", "cve_name": "C3"},
            {"repo": "q", "cve_name": "C4", "function_names": ["h"], "binary_version": "3"},
        ]
    }
    (tmp_path / "m.json").write_text(json.dumps(data))
    got = {(r.project, r.fname, r.cve_name, r.version) for r in text.vulnerabilities(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("p", n, "C1", v) for n in "fg" for v in "12"} | {("p", "f", "C2", "-"), ("q", "h", "C4", "3")}
    text.write_csv(text.vulnerabilities(spark, str(tmp_path / "m.json")).drop("ord"), str(tmp_path / "csv"))
    back = text.read_csv(spark, str(tmp_path / "csv"), "project string, fname string, cve_name string, version string")
    assert {tuple(r) for r in back.collect()} == got


def test_binaries(spark, tmp_path):
    for project, version, name, size in [("a", "1", "x-i686-gcc", 10), ("a", "1", "x-arm-gcc", 10), ("a", "2", "y-x86_64-gcc", 99), ("skip", "1", "z-i686-gcc", 10)]:
        (tmp_path / project / version).mkdir(parents=True, exist_ok=True)
        (tmp_path / project / version / name).write_bytes(b"x" * size)
    got = {(r.project, r.version, r.filename, len(r.binary)) for r in text.binaries(spark, str(tmp_path), 50, exclude=("skip",)).collect()}
    assert got == {("a", "1", "x-i686-gcc", 10)}


@pytest.fixture
def challenge(tmp_path):
    (tmp_path / "raw_data/attempts").mkdir(parents=True)
    (tmp_path / "solutions").mkdir()
    (tmp_path / "raw_data/index.json").write_text(json.dumps({"challenge": {"tasks": [{"id": "t1", "title": "T", "statement": "S"}]}}))

    def attempt(id_, language, verdicts):
        return {"id": id_, "task_id": "t1", "src_language__str": language, "judgement": {"results": verdicts}}

    good, bad = [{"verdict": 1}], [{"verdict": 1}, {}]
    people = {"ann": [attempt("1", "CPP", bad), attempt("2", "CPP", good)], "bob": [attempt("3", "C", bad)], "cid": [attempt("4", "PYTHON", good)], "dan": [attempt("5", "C", [])], "eve": [attempt("6", "C", good)]}
    for name, attempts in people.items():
        (tmp_path / f"raw_data/attempts/{name}.json").write_text(json.dumps({"attempts": attempts}))
    (tmp_path / "solutions/ann.1.cpp").write_text("int f() { return 1; }")
    (tmp_path / "solutions/dan.0.c").write_text("int g() { return 2; }")
    return tmp_path


def test_accepted_attempts(spark, challenge):
    rows = pipelines.accepted_attempts(text.attempts(spark, f"{challenge}/raw_data/attempts"), text.solutions(spark, f"{challenge}/solutions"), text.tasks(spark, f"{challenge}/raw_data/index.json"))
    got = {(r.id, r.competitor, r.task) for r in rows.collect()}
    assert got == {("2", "ann", "<h2>T</h2>\nS"), ("5", "dan", "<h2>T</h2>\nS")}


def test_unknown_task_raises(spark):
    attempts = spark.createDataFrame([("a", 0, "1", "no", "C", [1])], "competitor string, i int, id string, task_id string, language string, verdicts array<int>")
    solutions = spark.createDataFrame([("a.0.c", "x")], "solution string, source string")
    tasks = spark.createDataFrame([("t", "x")], "task_id string, task string")
    with pytest.raises(Exception, match="unknown task"):
        pipelines.accepted_attempts(attempts, solutions, tasks).collect()


def test_file_order_and_chunks(spark, tmp_path):
    parquet.write(spark.range(20).repartition(5), f"{tmp_path}/x")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert parquet.read_chunks(spark, f"{tmp_path}/x").rdd.getNumPartitions() == 5
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    files = [r.file for r in parquet.in_file_order(spark.read.parquet(f"{tmp_path}/x")).collect()]
    assert files == sorted(files) and len(set(files)) == 5
    assert parquet.row_count(parquet.read(spark, parquet.files(spark, f"{tmp_path}/x"))).first().rows == 20


def test_cache(tmp_path, monkeypatch):
    source = tmp_path / "x.bin"
    source.write_bytes(b"one")
    monkeypatch.delenv("MILLRACE_CACHE", raising=False)
    assert local.cached(str(source)) == str(source)
    copy = local.cached(str(source), str(tmp_path / "cache"))
    assert copy != str(source) and open(copy, "rb").read() == b"one" and copy.endswith("-x.bin")
    source.write_bytes(b"three")
    assert local.cached(str(source), str(tmp_path / "cache")) == copy and open(copy, "rb").read() == b"three"
    with pytest.raises(PathDoesNotExist):
        local.cached(str(tmp_path / "no"))
    with pytest.raises(PathExists):
        local.require_no_path(str(source))


def test_shared_folder(spark):
    assert shared.new_path(spark, "a") != shared.new_path(spark, "a")
    assert shared.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_load(spark, tmp_path, monkeypatch):
    parquet.write(spark.range(3), f"{tmp_path}/x")
    assert local.load(spark, f"{tmp_path}/x").count() == len(local.load(spark, f"{tmp_path}/x", eager=True)) == 3
    seen = {}
    monkeypatch.setattr(local.code, "interact", lambda banner, local: seen.update(local))
    local.shell(spark, f"{tmp_path}/x")
    assert seen["dataset"].count() == 3


def test_json_list_is_one_list(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", None), (1, "a\nb", 1.5), (2, None, 2.0)], "k int, s string, x double").repartition(3)
    text.write_json_list(df, f"{tmp_path}/list", "k")
    parts = [p for p in (tmp_path / "list").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1 and [tuple(x.values()) for x in json.loads(parts[0].read_text())] == [(1, "a\nb", 1.5), (2, None, 2.0), (3, "c", None)]
    text.write_json_list(df.limit(0), f"{tmp_path}/none", "k")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").iterdir()) if p.name.startswith("part-"))) == []


def test_vulnerabilities_of_several_files_keep_their_order(spark, tmp_path):
    record = lambda name: {"repo": "r", "cve_name": name, "function_names": ["f"]}
    for k, file in enumerate(("z", "a")):
        (tmp_path / file).write_text(json.dumps({f"k{i}": [record(f"{k}-{i}-{j}") for j in range(2)] for i in range(70)}))
    rows = text.vulnerabilities(spark, f"{tmp_path}/z", f"{tmp_path}/a").orderBy("ord").collect()
    assert [r.cve_name for r in rows] == [f"{k}-{i}-{j}" for k in range(2) for i in range(70) for j in range(2)]


def test_missing_partitions_become_empty_files(spark, tmp_path):
    made = parquet.write(spark.range(1).repartition(1), f"{tmp_path}/p", files_exactly=5)
    assert len(made) == 5 and spark.read.parquet(f"{tmp_path}/p").count() == 1


def test_challenges(spark, tmp_path):
    for name in ("a/solutions.sqlar", "a/raw_data/attempts/x.json", "b/raw_data.sqlar", "static/solutions.sqlar", "c/solutions.sqlar", "d/deep/solutions.sqlar", "loose.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = archives.challenges(spark, str(tmp_path)).orderBy("challenge").collect()
    assert [tuple(r) for r in rows] == [("a", True, True), ("b", False, False), ("c", True, False), ("d", False, False)]
