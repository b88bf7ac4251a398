"""The three stages over captured data: extraction, decoding, transformation. Each takes and gives DataFrames by name; run()
writes every result and reads it again, so a stage can be left out when its results are there."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decoding import compiled_abis, decode_events, decode_functions
from ..operators import addresses as addresses_of
from ..operators import base, coverage, enrich, filters, ocel, relational
from ..operators.graph import create_closure, creation_edges, level_expand
from ..operators.trace import flatten_traces
from ..sources import captured, sinks
from ..sources.tables import written
from .config import Config

log_of = logging.getLogger("chainlog")

#: Parameters of decoded steps that the log uses, as columns.
PARAMS = ("sender", "target", "token", "tokenType", "orderId", "orderType", "market", "marketType", "extraInfo")
NAME_MAPS = {
    ("dapp", "events"): "event_map_dapp",
    ("dapp", "calls"): "calls_map_dapp",
    ("dapp", "delegatecalls"): "delegatecalls_map_dapp",
    ("dapp", "zero_value_calls"): "calls_zero_value_map_dapp",
    ("non_dapp", "events"): "event_map_non_dapp",
    ("non_dapp", "calls"): "calls_map_non_dapp",
    ("non_dapp", "delegatecalls"): "delegatecalls_map_non_dapp",
    ("non_dapp", "zero_value_calls"): "calls_zero_value_map_non_dapp",
}


@dataclass(frozen=True)
class Captured:
    transactions: DataFrame  # hash, blockNumber, timeStamp
    traces: DataFrame  # hash, trace_json
    abis: DataFrame  # address, abi
    mappings: DataFrame  # map_name, key, value
    tx_index: DataFrame | None = None  # hash, ix
    touches: DataFrame | None = None  # hash, contract: every contract that a transaction was listed for
    code: DataFrame | None = None  # address, block, code: what stood at an address
    pages: DataFrame | None = None  # source, contract, from_block, to_block, ok, n, last_block: what was asked for, and how much came


def addresses(spark: SparkSession, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "address string")


def extract(spark: SparkSession, config: Config, data: Captured) -> dict[str, DataFrame]:
    """trace: a row for each step of each transaction in the block range; contracts: those of the DApp.

    With touches, only transactions count that touch the DApp's contracts as they become known, level by level; without, all
    that were captured. Traces are parsed and walked once: the flat trace is a table before the levels are looked for.
    """
    tx = data.transactions.where(F.col("blockNumber").between(config.min_block, config.max_block)).select("hash", "blockNumber", "timeStamp")
    trace = flatten_traces(tx.join(data.traces, "hash"))
    if data.tx_index is not None:
        trace = relational.with_transaction_index(trace, data.tx_index)
    else:
        trace = trace.withColumns({"transactionIndex": F.lit(None).cast("long"), "tx_index_missing": F.lit(True)})
    trace = written(base.base_transform(trace), "trace")
    deny = addresses(spark, config.non_dapp) if config.non_dapp else None
    seeds = addresses(spark, config.dapp)
    if data.touches is None:
        return {"trace": trace, "contracts": create_closure(creation_edges(trace), seeds, deny, config.prune)}
    edges = filters.creations(trace).select("hash", F.substring("from", 1, 42).alias("from"), "to")
    hashes, contracts = level_expand(data.touches.select("hash", F.lower("contract").alias("contract")), edges, seeds, deny)
    return {"trace": trace.join(hashes.select("hash"), "hash", "left_semi"), "contracts": contracts}


class IncompleteCapture(ValueError):
    """Blocks that a run wants are in no captured page."""


def missing_blocks(config: Config, pages: DataFrame, contracts: DataFrame) -> DataFrame:
    """(source, contract, from_block, to_block) that are wanted and that no page answers for certain: the block range of every
    contract of the DApp, from each source that was captured."""
    last = F.least(F.lit(config.max_block), F.max("to_block")).alias("to_block")  # without an end, as far as was ever asked
    ends = pages.where("contract IS NOT NULL").groupBy("source").agg(last).withColumn("from_block", F.lit(config.min_block).cast("long"))
    # a source and a contract make one key, so all sources are looked through at once
    key = F.struct("source", F.lower("address").alias("contract"))
    wanted = contracts.crossJoin(F.broadcast(ends)).select(key.alias("contract"), "from_block", "to_block")
    of = pages.withColumn("contract", F.struct("source", "contract"))
    cut, whole = of.where("source <> 'events'"), of.where("source = 'events'")
    ranges = coverage.covered_ranges(cut).unionByName(coverage.covered_ranges(whole, None))
    return coverage.missing_ranges(ranges, wanted).select("contract.source", "contract.contract", "from_block", "to_block")


def decode(config: Config, trace: DataFrame, contracts: DataFrame, abis: DataFrame) -> dict[str, DataFrame]:
    """The categories that are asked for. Rows are chosen before anything is decoded; ABIs are compiled once for all of them."""
    out = {}
    events_abi, calls_abi = compiled_abis(abis, "event"), compiled_abis(abis, "function")
    for side, category in sorted(config.output):
        keep = filters.in_set if side == "dapp" else filters.not_in_set
        if category == "events":
            out[f"{side}_events"] = decode_events(keep(filters.events(trace), "address", contracts), events_abi)
        elif category == "creations":
            made = filters.creations(trace)
            out[f"{side}_creations"] = keep(made, "to", contracts)
        else:
            kind = ("DELEGATECALL",) if category == "delegatecalls" else ("CALL",)
            zero: bool | None = category != "calls"
            if category == "delegatecalls" and not config.delegatecall_value_filter:
                zero = None
            out[f"{side}_{category}"] = decode_functions(keep(filters.calls(trace, kind, zero), "to", contracts), calls_abi)
    return out


def transform(config: Config, decoded: dict[str, DataFrame], trace: DataFrame, contracts: DataFrame, mappings: DataFrame) -> dict[str, DataFrame]:
    """The categories under readable names, as far as the mappings have them."""
    reverted = filters.reverted_transactions(trace)
    made = filters.creations(trace)
    maps = lambda name: captured.mapping(mappings, name)
    out, info, types = {}, None, None
    for name in sorted(decoded, key=lambda n: ("events" not in n, n)):  # events first: they tell of markets
        side = "non_dapp" if name.startswith("non_dapp_") else "dapp"
        category = name.removeprefix(side + "_")
        df = decoded[name]
        if category == "creations":
            out[name] = enrich.creations_of(df, side == "dapp")
            continue
        df = df.withColumns({p: F.col("params")[p] for p in PARAMS})
        df = (enrich.initial_events if category == "events" else enrich.initial_calls)(df, side == "dapp", reverted)
        df = enrich.rename_attribute(df, "Activity", "Activity", maps(NAME_MAPS[side, category]))
        if side == "dapp":
            df = enrich.label_contracts(df, made, contracts, maps("factory_contract_map"), maps("map_specific_known_contracts"))
            if category == "events":
                df = enrich.rename_attribute(df, "tokenType", "tokenType_name", maps("token_map"))
            if config.sensitive_events:
                df = enrich.contract_sensitive_by(df, maps(f"split_{category}"))
                if category == "events":
                    df = enrich.token_sensitive(df)
                    info, types = enrich.extra_info(df), enrich.market_type(df)
                if info is not None:
                    df = enrich.join_market(enrich.join_market(df, info, null_matches=False), types, null_matches=False)
                if category == "zero_value_calls":
                    df = enrich.activity_override(df)
        out[name] = df
    return out


ADDRESSES = ("address", "from", "to", "sender", "target", "token", "market")


def address_dictionary(frames: list[DataFrame], contracts: DataFrame, code: DataFrame, mappings: DataFrame) -> DataFrame:
    """(address, dapp_flag, type, contract_label) of every address that a category names. A known contract's label counts, or a
    factory's, or the one that its steps were given."""
    blocks = addresses_of.combined_blocks([addresses_of.address_blocks(df, list(ADDRESSES)) for df in frames])
    own = [df.select(F.col("address_lower").alias("a"), F.col("contract_name").alias("l")).where("l IS NOT NULL") for df in frames if {"address_lower", "contract_name"} <= set(df.columns)]
    given = [captured.mapping(mappings, name).select(F.lower("key").alias("a"), F.col("value").alias("l")) for name in ("map_specific_known_contracts", "factory_contract_map")]
    ranked = relational.union_sources(*[df.withColumn("rank", F.lit(i)) for i, df in enumerate([*given, *own])])
    labels = ranked.groupBy("a").agg(F.min_by("l", F.struct("rank", "l")).alias("contract_label")).withColumnRenamed("a", "address")
    return addresses_of.address_dictionary(blocks, contracts, code, labels)


def build_log(frames: list[DataFrame]) -> dict[str, DataFrame]:
    df = ocel.ocel_base(frames)
    return {"objects": ocel.ocel_objects(df), "events": ocel.ocel_events(df), "e2o": ocel.ocel_e2o(df)}


def log_order(frames: list[DataFrame], by_index: bool) -> DataFrame:
    """(ocel:eid, place) of every step: the place is (time, transaction index if asked for, position), in numbers."""
    wanted = ("txHash", "tracePos", "timeStamp", *["transactionIndex"] * by_index)
    return ocel.places(ocel.ocel_base(frames, wanted), by_index)


def in_order(df: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of events or relations as the log has them; relations of one event by their object."""
    return df.join(order, "ocel:eid", "left").orderBy("place", *[c for c in ("ocel:eid", "ocel:oid", "ocel:qualifier") if c in df.columns]).select(*df.columns)


def run(spark: SparkSession, config: Config, data: Captured, root: str, xml: bool = True) -> dict[str, DataFrame]:
    """The stages that the configuration asks for; gives the log's three tables. An error in a stage ends the run."""
    at = lambda stage, name: f"{sinks.folder(root, config.log_folder, stage)}/{name}.parquet"

    def kept(stage: str, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(at(stage, name))
        out = {name: spark.read.schema(df.schema).parquet(at(stage, name)) for name, df in frames.items()}
        for name, df in out.items():
            log_of.info("%s: %s has %d rows", stage, name, df.count())
        return out

    def read(stage: str, names: list[str]) -> dict[str, DataFrame]:
        return {n: spark.read.parquet(at(stage, n)) for n in names}

    first = kept("extraction", extract(spark, config, data)) if "extraction" in config.stages else read("extraction", ["trace", "contracts"])
    if "extraction" in config.stages and data.pages is not None:
        missing = kept("extraction", {"missing_blocks": missing_blocks(config, data.pages, first["contracts"])})["missing_blocks"]
        if not missing.isEmpty():
            log_of.warning("captured pages are not whole: see %s", at("extraction", "missing_blocks"))
            if config.incomplete == "fail":
                raise IncompleteCapture(f"captured pages are not whole: see {at('extraction', 'missing_blocks')}")
    names = [f"{side}_{c}" for side, c in sorted(config.output)]
    decoded = kept("decoding", decode(config, first["trace"], first["contracts"], data.abis)) if "decoding" in config.stages else read("decoding", names)
    if "transformation" not in config.stages:
        return {}
    frames = kept("transformation", transform(config, decoded, first["trace"], first["contracts"], data.mappings))
    tables = build_log([frames[n] for n in names])
    order = log_order([frames[n] for n in names], config.order_by_tx_index)
    tables = {"objects": tables["objects"].orderBy("ocel:type", "ocel:oid"), **{k: in_order(tables[k], order) for k in ("events", "e2o")}}
    log = kept("transformation", {f"ocel_{k}": v for k, v in tables.items()})
    if data.code is not None:
        kept("transformation", {"address_dictionary": address_dictionary([frames[n] for n in names], first["contracts"], data.code, data.mappings)})
    if xml:
        sinks.write_ocel_xml(log["ocel_objects"], log["ocel_events"], log["ocel_e2o"], f"{sinks.folder(root, config.log_folder, 'transformation')}/log.xmlocel", order=order)
    return log
