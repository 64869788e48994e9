"""Native tools run from Spark: a compiler, and a disassembler that the caller provides."""

from __future__ import annotations

import logging
import multiprocessing
import os
import shutil
import subprocess
import tempfile
import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EnvironmentError, RemoteException, UnhandledToken  # noqa: A004
from ..schema import BinaryDataset, SourceDataset, validate
from .report import attempt

#: Architectures that can be disassembled.
SUPPORTED = ("x86", "x86_64", "aarch64")


def find(binary: str, variable: str | None = None, guesses: tuple[str, ...] = ()) -> str:
    """Path of a program: from the environment variable, the search path, or the first guess that is there."""
    named = os.environ.get(variable or f"{binary.upper()}_PATH")
    if named:
        if not Path(named).exists():
            raise EnvironmentError(f"{named} does not exist")
        return named
    found = shutil.which(binary) or next((g for g in guesses if Path(g).exists()), None)
    if not found:
        raise EnvironmentError(f"cannot find {binary}")
    return found


def _child(pipe: Any, function: Callable, args: tuple, kwargs: dict) -> None:
    try:
        pipe.send((True, function(*args, **kwargs)))
    except BaseException:
        pipe.send((False, traceback.format_exc()))


def guarded(timeout: float) -> Callable:
    """Run a function in a child process. Too long raises ``TimeoutError``, and its error a :class:`RemoteException`."""

    def decorate(function: Callable) -> Callable:
        @wraps(function)
        def run(*args: Any, **kwargs: Any) -> Any:
            context = multiprocessing.get_context("fork")
            ours, theirs = context.Pipe(duplex=False)
            child = context.Process(target=_child, args=(theirs, function, args, kwargs), daemon=True)
            child.start()
            theirs.close()
            try:
                if not ours.poll(timeout):
                    raise TimeoutError(f"{function.__name__} took more than {timeout} s")
                try:
                    good, value = ours.recv()
                except EOFError:
                    raise RemoteException("the child process died") from None
            finally:
                child.kill()
                child.join()
                ours.close()
            if not good:
                raise RemoteException(value)
            return value

        return run

    return decorate


def compile_source(source: str | None, compiler: str = "g++", timeout: float = 60) -> bytes:
    """Object code of a source file, empty if there is none or it does not compile."""
    if source is None:
        return b""
    with tempfile.TemporaryDirectory() as folder:
        path, out = Path(folder, "source.cpp"), Path(folder, "source.o")
        path.write_text(source)
        try:
            done = subprocess.run([compiler, "-c", str(path), "-o", str(out)], capture_output=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            return b""
        return out.read_bytes() if done.returncode == 0 and out.exists() else b""


def compile_cpp(df: DataFrame, compiler: str = "g++", timeout: float = 60, observation: Observation | None = None) -> DataFrame:
    """Rows whose ``source`` compiles, with ``binary``; other columns flow through.

    ``observation`` receives ``total`` and ``succeeded``, counted as the rows pass, with no job of their own.
    """
    df = validate(df, SourceDataset).drop("binary")
    schema = T.StructType([*df.schema.fields, T.StructField("binary", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = find(compiler)
        for batch in batches:
            yield batch.assign(binary=[compile_source(s, program, timeout) for s in batch["source"]])

    out, good = df.mapInPandas(run, schema), F.length("binary") > 0
    if observation is not None:
        out = out.observe(observation, F.count("*").alias("total"), F.count_if(good).alias("succeeded"))
    return out.filter(good)


def success_ratio(df: DataFrame, ok: Any) -> DataFrame:
    """``succeeded, total, ratio`` of a condition."""
    n = F.count_if(ok)
    return df.agg(n.alias("succeeded"), F.count("*").alias("total"), (n / F.count("*")).alias("ratio"))


#: Takes code bytes and gives ``(name, bytes, disassembly)`` of each function that is neither a thunk nor imported;
#: disassembly is a text or a list of instructions, and None where one is invalid.
Disassembler = Callable[[bytes], Iterator[tuple[str, bytes, str | list[str] | None]]]


def disassembly_attempts(df: DataFrame, disassembler: Disassembler) -> DataFrame:
    """A row for each function: ``name``, ``binary`` (its own bytes), ``disassembly`` and ``error``, other columns kept.

    Instructions are joined by ``[NEXT]``. A function with an invalid instruction has no disassembly, and a binary on which the disassembler
    raises is one row without a name: ``error`` says why. So nothing is dropped without a reason that can be joined to its id.
    """
    df = validate(df, BinaryDataset).drop("name", "disassembly")

    def functions(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        for name, code, found in disassembler(bytes(row["binary"])):
            if found is None:
                yield {"name": name, "binary": code, "error": "invalid instruction"}
            else:
                yield {"name": name, "binary": code, "disassembly": found if isinstance(found, str) else f" {NEXT} ".join(found)}

    return attempt(df, functions, T.StructType([df.schema["binary"], T.StructField("name", T.StringType()), T.StructField("disassembly", T.StringType())]))


def disassemble(df: DataFrame, disassembler: Disassembler) -> DataFrame:
    """A row for each function: ``name``, ``binary`` (its own bytes) and ``disassembly``, other columns kept.

    Instructions are joined by ``[NEXT]``. Functions with an invalid instruction are left out, with a warning in the executor's log.
    """
    df = validate(df, BinaryDataset).drop("name", "disassembly")
    schema = T.StructType([*df.schema.fields, T.StructField("name", T.StringType()), T.StructField("disassembly", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                for name, code, found in disassembler(bytes(row["binary"])):
                    if found is None:
                        logging.getLogger(__name__).warning("invalid instruction in function %r of %r", name, row["id"])
                        continue
                    rows.append({**row, "name": name, "binary": code, "disassembly": found if isinstance(found, str) else f" {NEXT} ".join(found)})
            if rows:
                yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class Token:
    """A piece of an instruction as a disassembler prints it."""

    kind: str
    text: str = ""
    value: int | float | None = None


@dataclass(frozen=True)
class Block:
    start: int
    code: bytes
    tokens: tuple[Token, ...]
    valid: bool = True


@dataclass(frozen=True)
class Function:
    name: str
    blocks: tuple[Block, ...]
    thunk: bool = False
    symbol: str = "function"


@dataclass(frozen=True)
class Program:
    """What a disassembler makes of a binary."""

    architecture: str
    functions: tuple[Function, ...]


#: Kinds of tokens, by what becomes of them; sizes of memory operands, segments, and kinds of symbols that are not local.
KINDS = {
    "as it stands": ("instruction", "register", "brace"),
    "by value": ("integer", "float", "possible address", "import", "code relative address", "data symbol", "code symbol", "external symbol"),
    "left out": ("text", "operand separator", "begin memory operand", "end memory operand", "tag", "goto label"),
}
KEYWORDS = ("byte", "word", "dword", "qword", "tword", "xmmword", "ymmword", "zmmword", "rel")
OPERATIONS = {"+": ("+",), "-": ("-",), "*": ("*",), "#": (), "$+5": ("rel", "5")}
SEGMENTS = ("cs", "ds", "es", "ss", "fs", "gs")
FOREIGN = ("imported function", "external", "import address", "symbolic function")
NEXT = "[NEXT]"

_RULES = {kind: rule for rule, kinds in KINDS.items() for kind in kinds}


class _Words:
    """The words of a function so far, and whether an annotation is open."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.annotated = False

    def add(self, token: Token) -> None:
        text = token.text.strip()
        if self.annotated:
            self.annotated = (token.kind, text) != ("annotation", "}")
        elif token.kind == "annotation" and text.startswith("{"):
            self.annotated = True
        else:
            self.words += self._of(token, text)

    def _of(self, token: Token, text: str) -> tuple[str, ...]:
        rule = _RULES.get(token.kind)
        if rule == "as it stands":
            return (text,)
        if rule == "by value":
            return (str(token.value),)
        if rule == "left out":
            return ()
        if token.kind == "address separator":
            return (NEXT,) if self.words else ()
        if token.kind == "keyword" and text in KEYWORDS:
            return (text,)
        if token.kind == "operation" and text in OPERATIONS:
            return OPERATIONS[text]
        if (token.kind, text) == ("operation", ":") and self.words and self.words[-1] in SEGMENTS:
            return ("+",)  # an offset from a segment register
        raise UnhandledToken(f"{token.kind} token {token.text!r} after {' '.join(self.words[-6:])!r}")


def function_text(function: Function) -> tuple[bytes, str | None]:
    """Code and disassembly of a function, its blocks by address; no disassembly if one of them holds an invalid instruction."""
    found, code = _Words(), b""
    for block in sorted(function.blocks, key=lambda b: b.start):
        if not block.valid:
            return code, None
        code += block.code
        found.annotated = False
        for token in block.tokens:
            found.add(token)
    return code, " ".join(found.words)


def program_disassembler(load: Callable[[bytes], Program]) -> Disassembler:
    """A disassembler from what loads a binary: checks the architecture, skips thunks and what is not the program's own."""

    def run(binary: bytes) -> Iterator[tuple[str, bytes, str | None]]:
        program = load(binary)
        check_architecture(program.architecture)
        for function in program.functions:
            if not function.thunk and function.symbol not in FOREIGN:
                yield (function.name, *function_text(function))

    return run


def pretokens(mnemonic: str, operands: list[str | int | float]) -> str:
    """One instruction as pretokens: numbers in decimal, all else as it is, and ``#`` left out."""
    return " ".join([mnemonic, *(str(x) for x in operands if x != "#")])


def check_architecture(name: str) -> None:
    if name not in SUPPORTED:
        raise ValueError(f"unsupported architecture {name!r}")
