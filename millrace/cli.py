"""Command line: python -m millrace.cli <command>. Paths may lie on any storage that Spark reaches."""

from __future__ import annotations

import argparse
import signal
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.contracts import DATASETS, POS
from millrace.operators import redrive
from millrace.plans.pipeline import Pipeline
from millrace.session import build_session
from millrace.sources import generator, landing
from millrace.sources.kafka import file_stream, kafka_sink, kafka_stream
from millrace.streaming.jobs import start_ingest, start_realtime, supervise, validated
from millrace.streaming.listener import SampleListener
from millrace.streaming.sinks import IngestWriter, WindowTable, topic_folder


def source(spark: SparkSession, a: argparse.Namespace, dataset) -> DataFrame:
    return kafka_stream(spark, dataset, a.bootstrap, a.max_offsets) if a.bootstrap else file_stream(spark, f"{a.source}/{dataset.topic}")


def sender(a: argparse.Namespace, topic: str):
    return (lambda df: kafka_sink(df, a.bootstrap)) if a.bootstrap else topic_folder(f"{a.source}/{topic}")


def until_stopped(spark: SparkSession) -> None:
    stopped: list[int] = []
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda n, _: stopped.append(n))
    spark.streams.addListener(SampleListener())
    supervise(spark, lambda: bool(stopped))


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    for name in a.datasets:
        d, check = DATASETS[name], f"{a.checkpoints}/ingest-{name}"
        start_ingest(source(spark, a, d), d, IngestWriter(d, a.landing, check, sender(a, d.dead)), check, {"availableNow": True} if a.once else None)
    until_stopped(spark)
    return 0


def realtime(spark: SparkSession, a: argparse.Namespace) -> int:
    tables = {"store_revenue_5m": WindowTable(f"{a.serving}/store_revenue_5m", ["store_id", "window_start"]), "product_units_1h": WindowTable(f"{a.serving}/product_units_1h", ["product_id", "window_start"])}
    start_realtime(lambda: source(spark, a, POS), tables, a.checkpoints, {"availableNow": True} if a.once else None)
    until_stopped(spark)
    return 0


def load(spark: SparkSession, a: argparse.Namespace) -> int:
    print(landing.load_landed(spark, a.landing, a.raw, a.archive, [*DATASETS, "ingest_audit", "dead_letters"], a.now, a.limit))
    return 0


def warehouse(spark: SparkSession, a: argparse.Namespace) -> int:
    """One batch of the domain tables in a folder."""
    names = ("store_reference", "product_updates", "customer_events", "pos_transactions", "inventory_events")
    files = landing.Files(spark, a.tables)
    raw = {n: spark.read.parquet(f"{a.tables}/{n}.parquet") for n in names if files.exists(f"{a.tables}/{n}.parquet")}
    print("loaded" if Pipeline(spark, a.warehouse).run(a.batch, raw, a.now) else "nothing to do")
    return 0


def dlq(spark: SparkSession, a: argparse.Namespace) -> int:
    d = DATASETS[a.dataset]
    dead = spark.read.parquet(f"{a.source}/{d.dead}")
    if a.action == "inspect":
        redrive.inspect(dead if "timestamp" in dead.columns else dead.withColumn("timestamp", F.lit(None).cast("timestamp"))).show(100, False)
        return 0
    records, report = redrive.redrive(dead, d, a.error_code, a.force)
    report.show(truncate=False)
    if not a.dry_run:
        sender(a, d.retry)(records)
    return 0


def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    records = generator.with_faults(generator.sales(spark, a.count, a.seed), dict.fromkeys(generator.FAULTS, a.fault_rate), a.seed)
    if a.dry_run:
        generator.dry_run(validated(records, POS)).show(truncate=False)
    else:
        sender(a, POS.topic)(records.drop("fault"))
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--master")
    sub = p.add_subparsers(required=True)

    def command(run, *options: tuple) -> None:
        c = sub.add_parser(run.__name__)
        c.set_defaults(run=run)
        for name, kw in options:
            c.add_argument(name, **kw)

    need, text = {"required": True}, {}
    feed = [("--source", text), ("--bootstrap", text), ("--max-offsets", {"type": int, "default": 50_000})]
    flag = {"action": "store_true"}
    command(ingest, *feed, ("--landing", need), ("--checkpoints", need), ("--once", flag), ("--datasets", {"nargs": "*", "default": list(DATASETS)}))
    command(realtime, *feed, ("--serving", need), ("--checkpoints", need), ("--once", flag))
    command(load, ("--landing", need), ("--raw", need), ("--archive", need), ("--now", need), ("--limit", {"type": int}))
    command(warehouse, ("--tables", need), ("--warehouse", need), ("--batch", {"type": int, "required": True}), ("--now", need))
    command(dlq, *feed, ("action", {"choices": ["inspect", "redrive"]}), ("--dataset", {"choices": list(DATASETS), "default": POS.name}), ("--error-code", text), ("--force", flag), ("--dry-run", flag))
    command(generate, *feed, ("--count", {"type": int, "default": 10_000}), ("--seed", {"type": int, "default": 7}), ("--fault-rate", {"type": float, "default": 0.0}), ("--dry-run", flag))
    a = p.parse_args(args)
    return a.run(build_session(a.master), a)


if __name__ == "__main__":
    sys.exit(main())
