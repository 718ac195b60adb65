"""python -m termweave EXPERIMENT ROOT [STAGE ...]: runs the stages named, or all, and exits with 1 where one failed.

--inputs: the folder of the reference terms and the gold standard, for `setup`. --limit: lines of each dump.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import EXPERIMENTS, Experiment
from .stages import STAGES, Run, failed


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termweave", description=__doc__.splitlines()[0])
    parser.add_argument("experiment", choices=EXPERIMENTS)
    parser.add_argument("root")
    parser.add_argument("stages", nargs="*", metavar="STAGE", help=", ".join(STAGES))
    parser.add_argument("--inputs")
    parser.add_argument("--limit", type=int)
    given = parser.parse_args(arguments)
    if unknown := set(given.stages) - set(STAGES):
        parser.error(f"no such stage: {', '.join(sorted(unknown))}")
    experiment = Experiment(given.experiment, given.root)
    experiment.create_local()
    run = Run(spark or SparkSession.builder.appName("termweave").getOrCreate(), experiment, given.inputs, given.limit)
    for stage in STAGES:
        if stage in (given.stages or STAGES):
            report = run.run(stage)
            for output, status, rows in report:
                print(f"{stage:12} {status:8} {rows:>12} {output}")
            if failed(report):
                return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
