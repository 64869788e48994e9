"""Dataset pipelines: from raw files to deduplicated functions, and from functions to token ids.

Each is one lineage; Spark shuffles only to deduplicate and to deal out the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_padding
from ..operators import frame, link, sequence, tokens
from ..operators.native import Disassembler, compile_cpp, disassemble
from ..operators.split import generate_numbers, reciprocal
from ..schema import DisassembledFunctionDataset, validate
from ..sources import parquet
from ..sources import text as files
from ..sources.shared import scratch, staged


def finish(df: DataFrame) -> DataFrame:
    """One row for each function body. The size of files is the sink's: :func:`save`."""
    return df.transform(frame.hash_dedup_drop("binary", order="id"))


def save(df: DataFrame, path: str, size: str = "100MB") -> list[str]:
    """Write a dataset in files of at most ``size``."""
    return parquet.write(df, path, size=size)


def functions(sources: DataFrame, disassembler: Disassembler, compiler: str = "g++") -> DataFrame:
    """Compile, disassemble, deduplicate."""
    return finish(disassemble(compile_cpp(sources, compiler), disassembler))


def samples(spark: SparkSession, path: str, disassembler: Disassembler) -> DataFrame:
    """From a file of coding samples."""
    return functions(files.samples(spark, path), disassembler)


def accepted_attempts(attempts: DataFrame, solutions: DataFrame, tasks: DataFrame, latest_only: bool = True) -> DataFrame:
    """``id, source, competitor, task`` of attempts in a supported language that pass all tests and have a solution file.

    With ``latest_only``, only the last attempt of each competitor is looked at.
    """
    rows = link.latest(attempts, ["competitor"], "i") if latest_only else attempts
    rows = rows.filter(link.supported(F.col("language"))).filter(link.all_pass(F.col("verdicts")))
    rows = rows.withColumn("solution", link.solution_name(F.col("competitor"), F.col("i"), F.col("language")))
    return link.with_tasks(link.with_solutions(rows, solutions), tasks).select("id", "source", "competitor", "task")


def competition(spark: SparkSession, path: str, disassembler: Disassembler) -> DataFrame:
    """From an unpacked challenge: ``raw_data/index.json``, ``raw_data/attempts/*.json``, ``solutions/*``."""
    rows = accepted_attempts(
        files.attempts(spark, f"{path}/raw_data/attempts"), files.solutions(spark, f"{path}/solutions"), files.tasks(spark, f"{path}/raw_data/index.json")
    )
    return functions(rows, disassembler)


def numbered_binaries(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """``rows`` (``project, version, filename``, one for each file) with ``id``, their place by path.

    Paths alone are sorted and numbered, from the listing: no content is read for it, written or shuffled, as long as the numbers are few enough to be sent along.
    """
    path = ["project", "version", "filename"]
    ids = link.sequential_id(rows.select(*path).withColumn("_order", F.concat_ws("/", *path)), "_order").drop("_order")
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, path)


def vulnerable_binaries(spark: SparkSession, binaries: str, maps: list[str], disassembler: Disassembler, exclude: tuple[str, ...] = link.EXCLUDED) -> DataFrame:
    """Functions of binaries at ``project/version/name`` with the vulnerabilities known of them."""
    found = disassemble(numbered_binaries(files.binaries(spark, binaries, exclude=exclude)), disassembler)
    return finish(link.link_vulnerabilities(found, files.vulnerabilities(spark, *maps)))


def write_by_project(df: DataFrame, path: str) -> list[str]:
    """One folder for each project that has functions, ``path/project=name``; one pass, and none for empty projects."""
    return parquet.write(df.hint("rebalance", "project"), path, partition_by=("project",))


def build_vulnerable(spark: SparkSession, binaries: str, maps: list[str], disassembler: Disassembler, output: str, exclude: tuple[str, ...] = link.EXCLUDED) -> list[str]:
    """:func:`vulnerable_binaries` from files to files, a folder for each project."""
    with scratch(spark):
        return write_by_project(vulnerable_binaries(spark, binaries, maps, disassembler, exclude), output)


def train_tokenizer(df: DataFrame, length: int = 512, size: int = 4096) -> tokens.Tokenizer:
    with scratch(df.sparkSession):
        return tokens.train_tokenizer(staged(tokens.preprocess_tokens(df), "token-counts"), length, size)


def tokenize(df: DataFrame, tokenizer: tokens.Tokenizer, minimize: bool = False) -> DataFrame:
    """Token ids and masks; with ``minimize`` only those and the id. The size of files is the sink's: :func:`save`."""
    out = tokens.tokenize(validate(df, DisassembledFunctionDataset), tokenizer)
    return out.transform(frame.keep("id", "tokens", "mask")) if minimize else out


def example(spark: SparkSession, size: int = 64) -> DataFrame:
    """Random numbers and their reciprocals."""
    return generate_numbers(spark, size).withColumn("reciprocal", reciprocal(F.col("number")))


#: Prompts that show what a masked model has learned.
PROBES = (
    ("simple-xor-self", "xor rax [MASK]"),
    ("simple-add-immediate", "add rax [MASK]"),
    ("control-flow-address", "jmp [MASK]"),
    ("register-width-16", "mov [MASK] bl"),
    ("register-width-32", "mov [MASK] eax"),
    ("register-width-64", "mov [MASK] rax"),
    ("memory-dereference-32", "mov eax [MASK] [ esi ]"),
    ("memory-dereference-64", "mov rax [MASK] [ rsi ]"),
    ("memory-dereference-extended", "movzx eax [MASK] [ esi ]"),
    ("control-flow-next-instruction", "test eax eax [NEXT] [MASK] [MASK]"),
    ("calling-conventions-register-preserved", "push [MASK] [NEXT] mov rbx 42 [NEXT] add rax rbx [NEXT] pop [MASK] [NEXT] ret"),
    ("primitive-generation", "[MASK] [MASK] [MASK] [MASK] [MASK]"),
    ("conditioned-primitive-generateion", "add rax [MASK] [NEXT] mov rax [MASK] [MASK] [MASK] [MASK] [MASK] [MASK]"),
)


def probes(spark: SparkSession) -> DataFrame:
    """``id, name, disassembly`` of the prompts, to encode and fill."""
    return spark.createDataFrame([(str(k), n, p) for k, (n, p) in enumerate(PROBES)], "id string, name string, disassembly string")


def fill(prompts: DataFrame, tokenizer: tokens.Tokenizer, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Prompts with ``filled``, their text with masks replaced by what ``predict`` puts into ``predicted`` (an id per position)."""
    rows = predict(tokens.tokenize(prompts, tokenizer))
    rows = rows.withColumn("filled_tokens", sequence.fill_masked(F.col("tokens"), F.col("predicted")))
    return tokens.detokenize(rows, tokenizer, "filled_tokens", "filled").withColumn("filled", strip_padding(F.col("filled")))
