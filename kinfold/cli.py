"""Command line: spark-submit kinfold/cli.py targets|run|merge|validate|progress|setup|verify ... (or python -m kinfold.cli ...)"""

from __future__ import annotations

import argparse
import json
import time


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinfold")
    parser.add_argument("command", choices=["targets", "run", "merge", "validate", "progress", "setup", "verify"])
    parser.add_argument("--source1", help="TSV of the entities to link")
    parser.add_argument("--targets", help="Parquet of normalised targets: target_idx, entity_id, n, a, c, source")
    parser.add_argument("--source2", help="TSV of a source of targets")
    parser.add_argument("--source3", help="TSV of another source of targets")
    parser.add_argument("--models", nargs="+", help="JSON files of the tree models, in the order of the mean")
    parser.add_argument("--model-sha256", nargs="+", help="what their SHA-256 must be")
    parser.add_argument("--stand-ins", action="store_true", help="score by weights that nobody has learned, for trials")
    parser.add_argument("--fixture", help="JSON of expected results to verify")
    parser.add_argument("--refresh", type=float, default=0.0, help="seconds after which progress is shown again, until all is done")
    parser.add_argument("--run-dir")
    parser.add_argument("--workers", type=int, default=8, help="shards, the units that a resumed run passes over")
    parser.add_argument("--resume", action="store_true")
    a = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from kinfold.plans import job, parity

    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    if a.command == "setup":
        out = job.preflight(spark, a.models, a.model_sha256, a.targets)
    elif a.command == "verify":
        out = parity.verify(spark, a.fixture)
    elif a.command == "targets":
        out = job.ingest(spark, {n: path for n, path in ((2, a.source2), (3, a.source3)) if path}, a.targets)
    elif a.command == "progress":
        out = job.show(spark, a.run_dir)
        while a.refresh and out["done"] < out["rows"]:
            print(json.dumps(out), flush=True)
            time.sleep(a.refresh)
            out = job.show(spark, a.run_dir)
    else:
        s1 = job.read_source(spark, a.source1)
        if a.command == "run":
            if not a.models and not a.stand_ins:
                parser.error("--models are needed (or --stand-ins, for trials)")
            scorer = job.tree_scorer(spark, a.models, a.model_sha256) if a.models else job.STAND_INS
            out = job.run(s1, spark.read.parquet(a.targets), a.run_dir, scorer, a.workers, a.resume)
        else:
            out = (job.merge if a.command == "merge" else job.validate)(s1, a.run_dir)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
