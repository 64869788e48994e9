"""Command line: ``python -m millrace.cli OPERATION INPUT OUTPUT ...``."""

from __future__ import annotations

import argparse
import hashlib
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import frame, service
from .operators.split import parse_rename, parse_split, write_splits
from .plans.runner import modify
from .session import cluster, flush, slurm_job
from .sources import parquet
from .sources.local import shell
from .sources.tables import Tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description="Operations on parquet datasets.")
    commands = top.add_subparsers(dest="command", required=True)

    def dataset(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("-p", "--parallelism", type=int, default=1)
        p.add_argument("-c", "--cluster", default="local", choices=("local", "spark", "yarn", "k8s", "slurm"))
        p.add_argument("--master")
        p.add_argument("--compression", default="uncompressed")
        return p

    dataset("drop", "drop columns").add_argument("columns", nargs="+")
    dataset("keep", "keep columns").add_argument("columns", nargs="+")
    dataset("rename", "rename columns").add_argument("columns", nargs="+", type=parse_rename, metavar="old:new")
    p = dataset("repartition", "deal rows to files anew")
    how = p.add_mutually_exclusive_group(required=True)
    how.add_argument("--chunks", type=int)
    how.add_argument("--size")
    p = dataset("split", "split by a hash of the id")
    p.add_argument("splits", nargs="+", type=parse_split, metavar="name:percent")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--key", default="id")
    p = commands.add_parser("slurm", help="print a batch script that runs a command on a Spark cluster in its allocation")
    p.add_argument("-p", "--parallelism", type=int, default=1)
    p.add_argument("--cores", type=int, default=1)
    p.add_argument("--memory", default="16GB")
    p.add_argument("--partition")
    p.add_argument("--logs", default=".")
    p.add_argument("run", nargs="+", metavar="command")
    served = commands.add_parser("service", help="tables of the inference service").add_subparsers(dest="what", required=True)

    def table(name: str, text: str) -> argparse.ArgumentParser:
        p = served.add_parser(name, help=text)
        p.add_argument("--tables", required=True, help="folder of the tables")
        p.add_argument("-p", "--parallelism", type=int, default=1)
        return p

    table("initialize", "create empty tables").add_argument("--buckets", type=int, default=64)
    table("destroy", "drop the tables and all they hold").add_argument("--confirm", action="store_true")
    table("purge", "queue running completions again").add_argument("--confirm", action="store_true")
    table("users", "completions and feedback by user").add_argument("-s", "--sorted", action="store_true", help="most completions first")
    p = table("completions", "list completions")
    p.add_argument("-l", "--limit", type=int, default=10)
    p.add_argument("-u", "--user")
    p.add_argument("-d", "--date")
    p.add_argument("-i", "--input")
    p = table("export", "completions and feedback as a dataset")
    p.add_argument("output")
    p.add_argument("-d", "--start-date")
    p = table("admin", "set or unset a user's flag")
    p.add_argument("username")
    how = p.add_mutually_exclusive_group(required=True)
    how.add_argument("--promote", action="store_true")
    how.add_argument("--demote", action="store_true")
    p = commands.add_parser("shell", help="look at a dataset")
    p.add_argument("input")
    p.add_argument("--eager", action="store_true", help="load all of it into pandas")
    commands.add_parser("hash", help="SHA-256 of a file").add_argument("path")
    commands.add_parser("timestamp", help="the time as a tag")
    return top


def confirmed(args: argparse.Namespace, question: str) -> bool:
    return args.confirm or input(f"{question} (y/N): ").strip().lower() == "y"


def run_service(spark: SparkSession, args: argparse.Namespace) -> None:
    """A command on the service's tables."""
    tables = Tables(spark, args.tables)
    if args.what == "initialize":
        tables.initialize(args.buckets)
    elif args.what == "destroy":
        if confirmed(args, "Drop all tables and data?"):
            tables.destroy()
    elif args.what == "purge":
        if confirmed(args, "Queue all running completions again? No worker may be active."):
            rows = tables.table("completion")
            n = service.running(rows).first()["running"]
            if n:
                tables.replace("completion", service.purge(rows))
            print(f"{n} running completion(s) queued again")
    elif args.what == "users":
        report = service.user_report(tables.table("user"), tables.table("completion"))
        order = [F.col("completions").desc(), "username"] if args.sorted else ["username"]
        for r in report.orderBy(*order).toLocalIterator():
            print(r["username"], "admin" if r["admin"] else "-", r["completions"], r["feedback"], sep="\t")
    elif args.what == "completions":
        for r in service.list_completions(tables.table("completion"), tables.table("user"), args.limit, args.user, args.date, args.input).collect():
            print(r["username"], r["id"], r["timestamp"], r["state"], r["input"], sep="\t")
    elif args.what == "export":
        for path in parquet.write(service.export(tables.table("completion"), tables.table("user"), args.start_date), args.output):
            print(path)
    elif args.what == "admin":
        tables.replace("user", service.set_admin(tables.table("user"), args.username, args.promote))
        print(f"{args.username} {'promoted' if args.promote else 'demoted'}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "slurm":
        print(slurm_job(args.run, args.parallelism, args.cores, args.memory, args.partition, args.logs), end="")
        return 0
    if args.command == "service":
        spark = cluster("local", args.parallelism)
        try:
            run_service(spark, args)
        finally:
            flush(spark)
        return 0
    if args.command == "hash":
        with open(args.path, "rb") as f:
            print(hashlib.file_digest(f, "sha256").hexdigest())
        return 0
    if args.command == "timestamp":
        print(datetime.now().strftime("%Y%m%d-%H%M%S"))
        return 0
    if args.command == "shell":
        shell(cluster("local", 4), args.input, args.eager)
        return 0
    spark = cluster(args.cluster, args.parallelism, master=args.master)
    try:
        if args.command == "split":
            write_splits(parquet.read(spark, args.input), args.output, dict(args.splits), args.key, args.seed)
            return 0
        chunks = getattr(args, "chunks", None)
        operations = {
            "drop": lambda: [frame.drop(*args.columns)],
            "keep": lambda: [frame.keep(*args.columns)],
            "rename": lambda: [frame.rename(dict(args.columns))],
            "repartition": lambda: [],
        }[args.command]()
        for path in modify(spark, args.input, args.output, operations, args.compression, chunks, getattr(args, "size", None)):
            print(path)
    finally:
        flush(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
