from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "want"),
    [(None, ""), ("  Hello\tWORLD ", "hello world"), ("XOR [MASK] [mask] [NEXT]", "xor [MASK] [mask] [NEXT]"), ("[A]B[", "[A]b[")],
)
def test_sanitize(spark, value, want):
    assert one(spark, value, text.sanitize) == want


@pytest.mark.parametrize(("path", "want"), [("foo/bar.baz", "foo/bar.baz"), ("foo/bar.buzz", "foo/bar.baz"), ("foo/bar", "foo/bar.baz"), ("a.b/.rc", "a.b/.rc.baz"), ("x.tar.gz", "x.tar.baz")])
def test_enforce_extension(spark, path, want):
    assert one(spark, path, lambda c: text.enforce_extension(c, ".baz")) == want


def test_lines_and_next(spark):
    assert one(spark, " a \n\n b\nc", text.lines_to_next) == "a [NEXT] b [NEXT] c"
    assert one(spark, "a [NEXT] b", text.next_to_lines) == "a\nb"


@pytest.mark.parametrize(("token", "want"), [("42", True), ("-7", True), ("+1_000", True), ("1__0", False), ("_1", False), ("eax", False), ("9" * 40, True), ("", False)])
def test_immediates(spark, token, want):
    assert one(spark, token, text.is_immediate) is want


def test_timestamps(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2000-01-01 00:00:00' a, TIMESTAMP_NTZ '2000-01-01 00:00:00.5' b").select(
        text.timestamp_tag(F.col("a")).alias("tag"), text.iso_utc(F.col("a")).alias("a"), text.iso_utc(F.col("b")).alias("b")
    )
    assert tuple(row.first()) == ("20000101-000000", "2000-01-01T00:00:00Z", "2000-01-01T00:00:00.500000Z")


def test_highlight_escapes(spark):
    assert one(spark, "A+b a+B", lambda c: text.highlight(c, "a+b")) == "<mark>A+b</mark> <mark>a+B</mark>"


def test_enum_and_search(spark):
    assert one(spark, "1", lambda c: text.decode_enum(c.cast("int"), {0: "no", 1: "yes"})) == "yes"
    assert one(spark, "Hello", lambda c: text.searched(c, "")) is True
    assert one(spark, "Hello", lambda c: text.searched(c, " hELL ")) is True


@pytest.mark.parametrize(("value", "want"), [("25MB", 25_000_000), ("1KiB", 1024), (7, 7), ("1.5 GB", 1_500_000_000)])
def test_parse_size(value, want):
    assert text.parse_size(value) == want


def test_parse_size_rejects():
    with pytest.raises(ValueError):
        text.parse_size("many")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB [MASK]\n\t9_", max_size=40), min_size=1, max_size=20))
def test_sanitize_like_python(spark, values):
    special = re.compile(r"(\[[A-Z]+\])")

    def python(v):
        flat = re.sub(r"\s+", " ", v.strip())
        return "".join(p if special.fullmatch(p) else p.lower() for p in special.split(flat))

    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = [r.x for r in df.select("k", text.sanitize(F.col("v")).alias("x")).orderBy("k").collect()]
    assert got == [python(v) for v in values]
