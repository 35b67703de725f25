"""python -m textloom VERB --config FILE [name=value ...]: tag, dedupe, mix, stat or list."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import taggers
from .plans import config
from .session import ship


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    parser.add_argument("verb", choices=["tag", "dedupe", "mix", "stat", "list"])
    parser.add_argument("--config")
    parser.add_argument("overrides", nargs="*", metavar="name=value")
    given = parser.parse_args(args)
    if given.verb == "list":
        for name in taggers.names():
            print(name)
        return
    if not given.config:
        parser.error("--config is missing")
    settings = config.load(given.config, given.overrides)
    spark = ship(SparkSession.builder.appName(f"textloom {given.verb}").getOrCreate())
    found = getattr(config, f"run_{given.verb}")(spark, settings)
    for name, df in (found if isinstance(found, dict) else {given.verb: found}).items():
        assert isinstance(df, DataFrame)
        print(name, df.count())


if __name__ == "__main__":
    main()
