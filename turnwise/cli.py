"""Commands: inspect, parse, analyze, visualize, report. ``python -m turnwise.cli --help``"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from turnwise.analyses import MODULES, run
from turnwise.config import Config, load
from turnwise.operators.charts import CHARTS
from turnwise.report import report
from turnwise.sinks.tables import parse_summary, put_text, to_json, write_turns
from turnwise.sources.inspect import preview
from turnwise.sources.registry import read_all
from turnwise.sources.turns import as_turns, read_turns


def stored(spark: SparkSession, config: Config) -> DataFrame:
    return as_turns(read_turns(spark, f"{config.processed_data}/turns"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="turnwise")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("inspect", "what the raw folder holds"), ("parse", "raw exports to the turn table"), ("report", "Markdown report")):
        commands.add_parser(name, help=about)
    commands.add_parser("analyze", help="results as JSON").add_argument("--module", choices=list(MODULES))
    commands.add_parser("visualize", help="chart data as JSON").add_argument("--plot", choices=list(CHARTS))
    given = parser.parse_args(args)
    config = load(given.config)
    if spark is None:
        from turnwise.session import local_session

        spark = local_session()
    if given.command == "inspect":
        for name, about in preview(spark, config.raw_data).items():
            print(f"{name}: {about['path']}, {about['records']} records, keys {about['keys']}")
            for role, text in about["first"]:
                print(f"  {role}: {text}")
        return 0
    if given.command == "parse":
        turns = read_all(spark, config.raw_data)
        if turns is None:
            print(f"no exports below {config.raw_data}")
            return 1
        write_turns(turns, f"{config.processed_data}/turns")
        parse_summary(stored(spark, config)).show(truncate=False)
        return 0
    turns = stored(spark, config)
    if given.command == "analyze":
        for module in [given.module] if given.module else MODULES:
            results = run(turns, module)
            for name, df in results.items():
                print(name)
                df.show(20, truncate=60)
            put_text(spark, f"{config.outputs}/{module}_results.json", to_json(results))
    elif given.command == "visualize":
        for name in [given.plot] if given.plot else CHARTS:
            put_text(spark, f"{config.outputs}/plots/{name}.json", to_json({name: CHARTS[name](turns)}))
    else:
        put_text(spark, f"{config.outputs}/REPORT.md", report(turns))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
