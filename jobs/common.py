"""What the jobs share: their command line, config files, logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with the values of a JSON file, which is read by Spark, so that it may be anywhere. A name that
    isn't among the defaults is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first().value) if path else {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return defaults | given


def command_line(about: str, name: str, paths: dict[str, str], run: Callable[..., dict], arguments: list[str] | None = None) -> dict:
    """Runs ``run(spark, **paths, config=path)`` in a session of its own, which it stops again."""
    parser = argparse.ArgumentParser(description=about)
    for p, text in paths.items():
        parser.add_argument(f"--{p}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--master", help="Spark master, if none is set")
    options = vars(parser.parse_args(arguments))
    from codeloom.session import session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(options.pop("master"), name)
    try:
        return run(spark, **options)
    finally:
        spark.stop()
