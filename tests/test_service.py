from __future__ import annotations

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.errors import UnknownUser
from millrace.operators import service
from millrace.session import cluster
from millrace.sources import parquet
from millrace.streaming import worker

SCHEMA = "id long, user_id long, type int, input string, output string, timestamp timestamp_ntz, state int, rating int, comments string"


@pytest.fixture
def queue(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [
        (1, 1, 0, "xor eax", None, day(3), 0, None, None), (2, 1, 0, "add", "o", day(1), 2, 4, None), (3, 2, 0, "SUB", None, day(2), 0, None, "c"),
        (4, 2, 0, "mov", None, day(2), 1, 0, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "ann", True), (2, "bob", False), (3, "cid", False)], "id long, username string, admin boolean")


def states(df):
    return {r.id: r.state for r in df.collect()}


def test_queue(queue):
    assert service.next_queued(queue).first().id == 3
    claimed = service.claim(queue)
    assert states(claimed) == {1: 0, 2: 2, 3: 1, 4: 1}
    assert states(service.claim(claimed, 5)) == {1: 1, 2: 2, 3: 1, 4: 1}
    assert states(service.purge(claimed)) == {1: 0, 2: 2, 3: 0, 4: 0}
    assert service.running(queue).first().running == 1 and service.pending(queue).first().pending
    assert not service.pending(queue.limit(0)).first().pending
    done = service.complete(queue, queue.filter("id = 1").select("id", F.lit("answer").alias("output")))
    assert {r.id: r.output for r in done.collect()} == {1: "answer", 2: "o", 3: None, 4: None} and states(done)[1] == 2


def test_rights(queue):
    assert states(service.visible(queue, 2)).keys() == {3, 4}
    assert states(service.visible(queue, 2, admin=True)).keys() == {1, 2, 3, 4}
    assert states(service.delete(queue, 1, 2)).keys() == {1, 2, 3, 4}
    assert states(service.delete(queue, 1, 2, admin=True)).keys() == {2, 3, 4}


def test_feedback(spark, queue):
    patch = spark.createDataFrame([(1, 3, None), (2, 9, "no"), (3, None, "new")], "id long, rating int, comments string")
    got = {r.id: (r.rating, r.comments) for r in service.upsert_feedback(queue, patch).collect()}
    assert got == {1: (3, None), 2: (4, None), 3: (None, "new"), 4: (0, None)}


def test_reports(queue, users):
    assert {r.username: (r.completions, r.feedback) for r in service.user_report(users, queue).collect()} == {"ann": (2, 1), "bob": (2, 2), "cid": (0, 0)}
    assert [r.id for r in service.list_completions(queue, users, limit=2).collect()] == [2, 3]
    assert [r.id for r in service.list_completions(queue, users, user="bob", date="2024-01-02", pattern="sub").collect()] == [3]
    assert [r.rating for r in service.export(queue, users, "2024-01-02").orderBy("timestamp", "input").collect()] == [None, "bad", None]
    assert service.serialize(service.with_users(queue, users)).filter("id = 2").first().completed


def test_users(spark, users):
    assert service.set_admin(users, "bob").filter("admin").count() == 2
    with pytest.raises(UnknownUser):
        service.set_admin(users, "nobody")
    names = spark.createDataFrame([("bob",), ("dan",), ("dan",)], "username string")
    assert {(r.id, r.username) for r in service.get_or_create(users, names).collect()} == {(1, "ann"), (2, "bob"), (3, "cid"), (4, "dan")}


def test_insert(spark, queue):
    new = spark.createDataFrame([(9, 1, 0, "  XOR [MASK] ", datetime(2024, 2, 1))], "id long, user_id long, type int, input string, timestamp timestamp_ntz")
    row = service.insert(queue, new).filter("id = 9").first()
    assert (row.input, row.state, row.output) == ("xor [MASK]", 0, None)


def test_stream_answers_each_request_once(spark, queue, tmp_path):
    rows = queue.select("id", "input", "state")
    schema = "id long, input string, state int"

    def infer(values: pd.Series) -> pd.Series:
        if (values == "sub").any():
            raise ValueError("no sub")
        return values + " done"

    run = lambda: worker.work(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"file://{tmp_path}/check", infer).awaitTermination()
    rows.filter("id = 1").write.parquet(f"{tmp_path}/in")
    run()
    rows.filter("id > 1").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    got = {r.id: (r.state, r.output) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (2, "xor eax done"), 3: (2, "ValueError: no sub")}


def test_cluster_types():
    with pytest.raises(ValueError):
        cluster("slate")
    with pytest.raises(ValueError):
        cluster("spark")


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "flush", lambda s: None)
    monkeypatch.setattr(cli, "cluster", lambda *a, **k: spark)
    parquet.write(spark.range(40).withColumn("foo", F.lit(1)), f"{tmp_path}/in")
    assert cli.main(["drop", f"{tmp_path}/in", f"{tmp_path}/a", "foo"]) == 0
    assert cli.main(["rename", f"{tmp_path}/in", f"{tmp_path}/b", "foo:bar"]) == 0
    assert cli.main(["repartition", f"{tmp_path}/in", f"{tmp_path}/c", "--chunks", "50"]) == 0
    assert cli.main(["split", f"{tmp_path}/in", f"{tmp_path}/d", "x:50", "y:50"]) == 0
    assert spark.read.parquet(f"{tmp_path}/a").columns == ["id"] and spark.read.parquet(f"{tmp_path}/b").columns == ["id", "bar"]
    assert len(parquet.files(spark, f"{tmp_path}/c")) == 50
    assert spark.read.parquet(f"{tmp_path}/d-x").count() + spark.read.parquet(f"{tmp_path}/d-y").count() == 40
    (tmp_path / "f").write_bytes(b"abc")
    cli.main(["hash", str(tmp_path / "f")])
    cli.main(["timestamp"])
    assert "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" in capsys.readouterr().out
