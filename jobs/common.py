"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import logging
import tomllib
from dataclasses import fields

from pyspark.sql import SparkSession

from phenospark.session import builder


def settings[C](spark: SparkSession, path: str | None, kind: type[C]) -> C:
    """The config of a TOML file, read by Spark; defaults without one. ValueError names what it doesn't know."""
    if path is None:
        return kind()
    got = tomllib.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = sorted(set(got) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})


def command_line(name: str, says: str, paths: dict[str, str]) -> tuple[SparkSession, argparse.Namespace]:
    """A session, and the arguments: a path for each name, and --config."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=says)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help="a TOML file of settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return builder(name).getOrCreate(), args
