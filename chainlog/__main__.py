"""python -m chainlog CONFIG CAPTURED OUT: the three stages over a folder of captured responses.

CAPTURED holds normal.json, internal.json (transaction lists), logs.json and blocks.json (transactions by events), traces.json,
abis.json and mappings.json, and if wanted tx_index.json and code.json, each as the readers in sources.captured want them. A
source of transactions that is asked for and not there is left out, with a warning. Responses that say what they were asked for are
held against the block range; what no page answers is a table, and a warning or the run's end, as misc.incomplete has it. OUT gets a folder with the results of
each stage.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from .functions import decoding
from .operators import trace
from .operators.relational import union_sources
from .plans.config import Config
from .plans.pipeline import Captured, run
from .sources import captured
from .sources.tables import scratch


def read(spark: SparkSession, config: Config, folder: str) -> Captured:
    there = lambda name: captured.there(spark, f"{folder}/{name}.json")
    lists = [captured.transaction_list(spark, f"{folder}/{name}.json", name) if f"{name}_transactions" in config.sources and there(name) else None for name in ("normal", "internal")]
    by_events = None
    if "transactions_by_events" in config.sources and there("logs") and there("blocks"):
        by_events = captured.transactions_of_logs(captured.logs(spark, f"{folder}/logs.json"), captured.blocks(spark, f"{folder}/blocks.json"))
    have = [x for x in (*lists, by_events) if x is not None]
    pages = [captured.list_pages(spark, f"{folder}/{name}.json", name) for name, df in zip(("normal", "internal"), lists) if df is not None]
    pages += [captured.log_pages(spark, f"{folder}/logs.json")] if by_events is not None else []
    return Captured(
        captured.transactions(*lists, by_events),
        captured.traces(spark, f"{folder}/traces.json"),
        captured.abis(spark, f"{folder}/abis.json"),
        captured.mappings(spark, f"{folder}/mappings.json"),
        tx_index=captured.tx_index(spark, f"{folder}/tx_index.json") if there("tx_index") else None,
        code=captured.code(spark, f"{folder}/code.json") if there("code") else None,
        touches=captured.touches(*have),
        pages=union_sources(*pages),
    )


def main(args: list[str]) -> None:
    if len(args) != 3:
        sys.exit(__doc__)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("chainlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    trace.register(spark)
    decoding.register(spark)
    config = Config.load(args[0])
    with scratch(spark):
        tables = run(spark, config, read(spark, config, args[1]), args[2])
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


if __name__ == "__main__":
    main(sys.argv[1:])
