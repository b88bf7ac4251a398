"""Call traces: nested JSON to one row for each call or log entry, with stable positions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import

TEXT = ("type", "from", "to", "value", "gas", "gasUsed", "input", "output", "error", "address", "data")
NODE = pa.schema(
    [("tracePos", pa.int32()), ("tracePosDepth", pa.string()), ("path", pa.list_(pa.int32())), ("eventPos", pa.int32())]
    + [(c, pa.string()) for c in TEXT]
    + [("topics", pa.list_(pa.string()))]
)
NODE_DDL = "tracePos int, tracePosDepth string, path array<int>, eventPos int, " + ", ".join(f"`{c}` string" for c in TEXT) + ", topics array<string>"
ROWS_OUT = 4096


def walk(trace: dict) -> Iterator[tuple]:
    """Nodes of a trace in order of position: a call, then all of its calls' subtrees, then its logs.

    The path of the root is [1]; a call's children are counted from 1, its logs on from its calls. Pre-order and the order
    of paths are the same, so tracePos is a node's rank by path. Children that are not objects are left out of the rows but
    keep their number.
    """
    root = trace.get("result", trace)
    stack: list[tuple[dict, tuple[int, ...], int | None]] = [(root, (1,), None)]
    pos = 0
    while stack:
        node, path, event_pos = stack.pop()
        if not isinstance(node, dict):
            continue
        pos += 1
        fields = [None if (v := node.get(c)) is None or isinstance(v, (dict, list)) else str(v) for c in TEXT]
        topics = node.get("topics")
        yield (pos, ".".join(map(str, path)), list(path), event_pos, *fields, [str(t) for t in topics] if isinstance(topics, list) else None)
        calls, logs = node.get("calls") or [], node.get("logs") or []
        below = [(c, (*path, i), None) for i, c in enumerate(calls, 1)] + [(x, (*path, len(calls) + i), i) for i, x in enumerate(logs, 1)]
        stack.extend(reversed(below))


def flatten_traces(traces: DataFrame, trace: str = "trace_json") -> DataFrame:
    """A row for each node of each trace, with the trace's other columns. Texts that are no JSON object have no rows.

    Each trace is walked for itself, so the rows come where the traces are, without a shuffle, some thousand at a time.
    """
    let_workers_import(traces.sparkSession)
    rest = [c for c in traces.columns if c != trace]
    fields = [f for f in traces.schema.fields if f.name != trace]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(rest)
            rows, owners = [], []
            for i, text in enumerate(batch.column(trace).to_pylist()):
                try:
                    nodes = json.loads(text or "null")
                except ValueError:
                    continue
                for row in walk(nodes) if isinstance(nodes, dict) else ():
                    rows.append(row)
                    owners.append(i)
                    if len(rows) == ROWS_OUT:
                        yield made(own, owners, rows)
                        rows, owners = [], []
            if rows:
                yield made(own, owners, rows)

    def made(own: pa.RecordBatch, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kept = own.take(pa.array(owners))
        return pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, f.type) for c, f in zip(zip(*rows), NODE)]], [*rest, *NODE.names])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], NODE_DDL])
    return traces.select(*rest, trace).mapInArrow(run, ddl)


def register(spark: SparkSession) -> None:
    """walk_trace(json) as a table function for SQL: SELECT t.hash, w.* FROM t, LATERAL walk_trace(t.trace_json) w."""
    let_workers_import(spark)

    class WalkTrace:
        def eval(self, text: str):
            trace = json.loads(text or "null")
            yield from walk(trace) if isinstance(trace, dict) else ()

    spark.udtf.register("walk_trace", F.udtf(WalkTrace, returnType=NODE_DDL))


def explode_level(nodes: DataFrame, node: str = "node") -> DataFrame:
    """The next level of nested nodes (VARIANT): all calls, then all logs, of each; the node's other columns stay."""
    rest = [c for c in nodes.columns if c != node]
    out = None
    for i, name in enumerate(("calls", "logs")):
        items = F.try_variant_get(node, f"$.{name}", "array<variant>")
        df = nodes.select(*rest, F.posexplode(items).alias("item_pos", node)).withColumn("part", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out.where(F.col(node).isNotNull())


def key_count(text: str, word: str) -> int:
    """How many keys of a JSON text, at any depth, hold a word."""

    def count(x) -> int:
        if isinstance(x, dict):
            return sum((word in k) + count(v) for k, v in x.items())
        return sum(map(count, x)) if isinstance(x, list) else 0

    return count(json.loads(text))
