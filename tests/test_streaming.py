import json

from chainlog.operators.graph import creation_edges
from chainlog.streaming import blocks

TRACE = {"type": "CALL", "from": "0xu", "to": "0xa", "value": "0x1", "gas": "0x2", "gasUsed": "0x2", "calls": [{"type": "CREATE", "from": "0xa", "to": "0xb"}]}


def write(spark, path, rows):
    df = spark.createDataFrame([(h, b, t, json.dumps(TRACE | {"calls": [{"type": "CREATE", "from": "0xa" if b < 2 else "0xb", "to": f"0xc{b}"}]})) for h, b, t in rows], "hash string, blockNumber long, timeStamp long, trace_json string")
    df.write.mode("append").parquet(path)


def test_stream_of_traces(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [("h1", 1, 0), ("h2", 1, 60), ("h3", 1, 700)])
    schema = spark.read.parquet(path).schema
    steps = blocks.stream_traces(spark.readStream.schema(schema).parquet(path))
    q = blocks.steps_per_window(steps).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["kind"], str(r["window"]["start"])[-8:]): r["n"] for r in spark.sql("SELECT * FROM windows").collect()}
    assert got == {("CALL", "00:00:00"): 2, ("CREATE", "00:00:00"): 2, ("CALL", "00:10:00"): 1, ("CREATE", "00:10:00"): 1}


def test_contracts_grow_with_batches(spark, tmp_path):
    path, contracts = f"{tmp_path}/in", f"{tmp_path}/contracts"
    spark.createDataFrame([("0xa",)], "address string").write.parquet(f"{contracts}/seeds")
    write(spark, path, [("h1", 1, 0)])
    schema = spark.read.parquet(path).schema

    def run():
        steps = blocks.stream_traces(spark.readStream.schema(schema).parquet(path))
        q = blocks.grow_contracts(steps, contracts, f"{tmp_path}/edges").option("checkpointLocation", f"{tmp_path}/progress").start()
        q.processAllAvailable()
        q.stop()
        return {r["address"] for r in spark.read.parquet(f"{contracts}/closure").collect()}

    assert run() == {"0xa", "0xc1"}
    write(spark, path, [("h2", 2, 0), ("h3", 1, 9)])
    assert run() == {"0xa", "0xc1"}  # the second block's creator is not known yet
    assert creation_edges(blocks.base_transform(blocks.flatten_traces(spark.read.parquet(path)))).count() == 2
