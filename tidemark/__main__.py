"""Command line of the risk job: ``python -m tidemark --data-dir ... --out-dir ...``."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession

from tidemark.plans import risk
from tidemark.sources.tables import Settings


def parser() -> argparse.ArgumentParser:
    # The names of the flags.
    p = argparse.ArgumentParser(prog="tidemark", description=risk.__doc__)
    p.add_argument("--config", help="settings as YAML or JSON; flags override them")
    p.add_argument("--data-dir", dest="data_directory")
    p.add_argument("--out-dir", dest="out_directory")
    p.add_argument("--test-size", dest="test_share", type=float)
    p.add_argument("--explain-rows", dest="explain_rows", type=int)
    p.add_argument("--max-windows", dest="max_windows", type=int)
    p.add_argument("--max-rows-per-table", dest="max_rows_per_table", type=int)
    p.add_argument("--seed", type=int)
    p.add_argument("--score-labels", dest="score_labels", action="store_true", default=None)
    p.add_argument("--score-delta", dest="score_delta", type=float)
    p.add_argument("--prefix", default="", help="what stands before the tables' names")
    p.add_argument("--explain", nargs=2, metavar=("STAY", "MOMENT"), help="explains a prediction of a finished run instead of running")
    return p


def settings_of(args: list[str] | None = None) -> tuple[Settings, str]:
    given = vars(parser().parse_args(args))
    prefix, config, _ = given.pop("prefix"), given.pop("config"), given.pop("explain")
    base = Settings.from_file(config) if config else Settings()
    return replace(base, **{k: v for k, v in given.items() if v is not None}), prefix


def main() -> None:
    settings, prefix = settings_of()
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if asked := parser().parse_args().explain:
        print(risk.explain(spark, settings, *asked, prefix).toJSON().first())
    else:
        print(json.dumps(risk.run(spark, settings, prefix)))


if __name__ == "__main__":
    main()
