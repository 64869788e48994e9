from __future__ import annotations

import shutil
import time

import pytest

from millrace.errors import EnvironmentError, RemoteException, SchemaError, UnhandledToken  # noqa: A004
from millrace.operators import native, tokens
from millrace.plans import pipelines


@pytest.fixture
def compiler(tmp_path):
    """The real compiler if it works here, else a program that is called alike: it fails on a text without braces."""
    if shutil.which("g++") and native.compile_source("int main() { return 42; }"):
        return "g++"
    path = tmp_path / "compiler"
    path.write_text('#!/bin/sh\n[ "$1" = -c ] && [ "$3" = -o ] && grep -q "{" "$2" && head -c 500 /dev/zero > "$4" && cat "$2" >> "$4"\n')
    path.chmod(0o755)
    return str(path)


def test_compile_drops_what_fails_and_keeps_columns(spark, compiler):
    df = spark.createDataFrame([("1", "int main() { return 42; }", "x"), ("2", "foo", "y")], "id string, source string, foo string")
    rows = native.compile_cpp(df, compiler).collect()
    assert [(r.id, r.foo) for r in rows] == [("1", "x")] and len(rows[0].binary) > 100


def test_compile_counts_as_rows_pass(spark, compiler):
    from pyspark.sql import Observation

    seen = Observation("compiled")
    df = spark.createDataFrame([("1", "int main() { return 42; }"), ("2", "foo"), ("3", "bar")], "id string, source string")
    assert native.compile_cpp(df, compiler, observation=seen).count() == 1
    assert seen.get == {"total": 3, "succeeded": 1}


def test_compile_checks_schema(spark):
    with pytest.raises(SchemaError):
        native.compile_cpp(spark.createDataFrame([("1",)], "foo string"))


def toy(code: bytes):
    """A stand-in for a disassembler: a function per four bytes, an invalid one at ff."""
    for k in range(0, len(code), 4):
        part = code[k : k + 4]
        yield f"f{k}", part, None if b"\xff" in part else [native.pretokens("mov", ["eax", b]) for b in part]


def test_disassemble(spark):
    df = spark.createDataFrame([("1", bytearray(b"\x01\x02\xff\x04\x05"), "x")], "id string, binary binary, foo string")
    rows = native.disassemble(df, toy).collect()
    assert [(r.name, bytes(r.binary), r.disassembly, r.foo) for r in rows] == [("f4", b"\x05", "mov eax 5", "x")]
    with pytest.raises(SchemaError):
        native.disassemble(df.drop("binary"), toy)


def test_pretokens():
    assert native.pretokens("mov", ["rax", "#", 42, 1.5]) == "mov rax 42 1.5"
    native.check_architecture("x86_64")
    with pytest.raises(ValueError):
        native.check_architecture("mips")


def function(*tokens, valid=True, **more):
    return native.Function("f", (native.Block(8, b"b", tokens, valid), native.Block(4, b"a", (native.Token("instruction", " nop "),))), **more)


T = native.Token


@pytest.mark.parametrize(
    ("tokens", "words"),
    [
        ((T("address separator"), T("instruction", "mov"), T("text", "  "), T("register", "eax"), T("operand separator", ", "), T("integer", "0x2a", 42)), "nop [NEXT] mov eax 42"),
        ((T("keyword", "xmmword "), T("begin memory operand", "["), T("brace", "["), T("register", "gs"), T("operation", ":"), T("integer", "8", 8), T("brace", "]")), "nop xmmword [ gs + 8 ]"),
        ((T("operation", "#"), T("float", "1.5", 1.5), T("operation", " * "), T("code symbol", "main", 4096)), "nop 1.5 * 4096"),
        ((T("operation", "$+5"), T("keyword", "rel")), "nop rel 5 rel"),
        ((T("annotation", "{"), T("keyword", "what"), T("annotation", "x"), T("annotation", "}"), T("register", "x0")), "nop x0"),
    ],
)
def test_grammar(tokens, words):
    assert native.function_text(function(*tokens)) == (b"ab", words)


@pytest.mark.parametrize("token", [T("keyword", "what"), T("operation", ":"), T("operation", "/"), T("annotation", "x"), T("unheard of")])
def test_grammar_raises_for_what_it_does_not_know(token):
    with pytest.raises(UnhandledToken):
        native.function_text(function(token))


def test_program(spark, caplog):
    every = native.Program("x86", (function(), function(thunk=True), function(symbol="external"), function(valid=False)))
    assert list(native.program_disassembler(lambda _: every)(b"")) == [("f", b"ab", "nop"), ("f", b"a", None)]
    with pytest.raises(ValueError):
        list(native.program_disassembler(lambda _: native.Program("mips", ()))(b""))


def test_compile_without_source():
    assert native.compile_source(None) == b""


def test_functions_end_to_end(spark, compiler):
    source = "int f(int x) { return x + 42; }"
    df = spark.createDataFrame([("1", source, "s"), ("2", source, "s"), ("3", "bad", "s")], "id string, source string, summary string")
    found = pipelines.functions(df, lambda code: [("f", code[:8], ["mov eax 42", "ret"])], compiler)
    assert [(r.id, r.disassembly, r.summary) for r in found.collect()] == [("1", "mov eax 42 [NEXT] ret", "s")]
    tokenizer = pipelines.train_tokenizer(found, length=16)
    rows = pipelines.tokenize(found, tokenizer, minimize=True)
    assert rows.columns == ["id", "tokens", "mask"] and sum(rows.first().mask) == 5
    assert tokens.Tokenizer.load(tokenizer.save()).ids == tokenizer.ids


def test_fill_probes(spark):
    from pyspark.sql import functions as F

    counts = spark.createDataFrame([("tokens", t, 1) for t in "xor rax add jmp mov eax [ ]".split()] + [("immediates", "42", 1)], "kind string, token string, n long")
    tokenizer = tokens.train_tokenizer(counts, length=8)
    rows = pipelines.fill(pipelines.probes(spark), tokenizer, lambda df: df.withColumn("predicted", F.array_repeat(F.lit(tokenizer.ids["rax"]), 8)))
    assert {r.name: r.filled for r in rows.collect()}["simple-xor-self"] == "xor rax rax"


@native.guarded(timeout=1)
def slow(seconds: float) -> str:
    time.sleep(seconds)
    if seconds == 0.5:
        raise RuntimeError("inner")
    return "done"


def test_guard():
    assert slow(0) == "done"
    with pytest.raises(TimeoutError):
        slow(5)
    with pytest.raises(RemoteException, match="inner"):
        slow(0.5)


def test_find(monkeypatch, tmp_path):
    (tmp_path / "tool").write_text("")
    monkeypatch.setenv("TOOL_PATH", str(tmp_path / "tool"))
    assert native.find("tool") == str(tmp_path / "tool")
    monkeypatch.setenv("TOOL_PATH", "/nowhere")
    with pytest.raises(EnvironmentError):
        native.find("tool")
    monkeypatch.delenv("TOOL_PATH")
    assert native.find("tool", guesses=(str(tmp_path / "tool"),)) == str(tmp_path / "tool")
    with pytest.raises(EnvironmentError):
        native.find("tool")
