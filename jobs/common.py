"""What the jobs share: command line, configuration, log lines and tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("tessera.jobs")


def read_config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The configuration (a small JSON object) at ``path`` over the defaults; an unknown name is an error."""
    given = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) if path else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def table(spark: SparkSession, path: str, schema: str, partitions: str = "") -> DataFrame:
    """The Parquet table at ``path``, made as an empty one where there is none yet."""
    whole = schema + (", " + partitions if partitions else "")
    spark.createDataFrame([], whole).write.mode("ignore").parquet(path)
    return spark.read.schema(whole).parquet(path)


def main(run: Callable[..., dict], description: str, paths: dict[str, str]) -> None:
    """Parse the command line (a path for each of ``paths`` and an optional configuration), run within a session of its own."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file with settings")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        run(spark, **{k: args[k] for k in paths}, config=args["config"])
    finally:
        spark.stop()
