"""Writers: stage tables as Parquet, flat CSV for reading by eye, and the event log as OCEL XML."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import strings


def folder(root: str, log_folder: str, stage: str) -> str:
    return f"{root.rstrip('/')}/{log_folder}/{stage}"


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet at the path; with csv, also flat text beside it."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        strings(df).write.mode("overwrite").option("header", True).csv(f"{path}_csv")


def write_log(objects: DataFrame, events: DataFrame, e2o: DataFrame, path: str) -> None:
    for name, df in (("objects", objects), ("events", events), ("e2o", e2o)):
        df.write.mode("overwrite").parquet(f"{path}/ocel_{name}.parquet")


def _xml(value: Column) -> Column:
    out = value.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.coalesce(out, F.lit(""))


def _time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ocel_xml(objects: DataFrame, events: DataFrame, e2o: DataFrame, version: str = "2.0", order: DataFrame | None = None) -> DataFrame:
    """(part, place, key, value): the lines of an OCEL document, to be written in order of part, place and key.

    Elements are made on the executors, one row each; events carry their relations, gathered by event id. order: (ocel:eid, place), or
    None for events by time and id.
    """
    spark = objects.sparkSession
    if version == "2.0":
        o = F.concat(F.lit('<object id="'), _xml(F.col("ocel:oid")), F.lit('" type="'), _xml(F.col("ocel:type")), F.lit('"><attributes><attribute name="category" time="1970-01-01T00:00:00Z">'), _xml(F.col("category")), F.lit("</attribute></attributes></object>"))
        rel = F.concat(F.lit('<relationship object-id="'), _xml(F.col("ocel:oid")), F.lit('" qualifier="'), _xml(F.col("ocel:qualifier")), F.lit('"/>'))
    else:
        o = F.concat(F.lit('<object><string key="id" value="'), _xml(F.col("ocel:oid")), F.lit('"/><string key="type" value="'), _xml(F.col("ocel:type")), F.lit('"/><list key="ovmap"><string key="category" value="'), _xml(F.col("category")), F.lit('"/></list></object>'))
        rel = F.concat(F.lit('<string key="object-id" value="'), _xml(F.col("ocel:oid")), F.lit('"/>'))
    rels = e2o.groupBy("ocel:eid").agg(F.array_join(F.array_sort(F.collect_set(rel)), "").alias("rels"))
    order = events.select("ocel:eid", F.struct(F.col("ocel:timestamp").alias("time")).alias("place")) if order is None else order
    joined = events.join(rels, "ocel:eid", "left").join(order, "ocel:eid", "left")
    none = F.lit(None).cast(order.schema["place"].dataType)
    rels = F.coalesce("rels", F.lit(""))
    if version == "2.0":
        e = F.concat(F.lit('<event id="'), _xml(F.col("ocel:eid")), F.lit('" type="'), _xml(F.col("ocel:activity")), F.lit('" time="'), _time(F.col("ocel:timestamp")), F.lit('"><objects>'), rels, F.lit("</objects></event>"))
        kinds = lambda df, c, tag: df.select(F.col(c).alias("t")).distinct().select(F.lit(f"1 {tag}").alias("part"), F.col("t").alias("key"), F.concat(F.lit(f"<{tag} name=\""), _xml(F.col("t")), F.lit('"><attributes/></' + tag + ">")).alias("value"))
        types = [kinds(objects, "ocel:type", "object-type"), kinds(events, "ocel:activity", "event-type")]
        frame = [("0", "", "<log>"), ("1 object-type", "", "<object-types>"), ("1 object-type~", "", "</object-types>"), ("1 event-type", "", "<event-types>"), ("1 event-type~", "", "</event-types>"), ("2", "", "<objects>"), ("2~", "", "</objects>"), ("3", "", "<events>"), ("3~", "", "</events>"), ("4", "", "</log>")]
        at = ("2", "3")
    else:
        e = F.concat(F.lit('<event><string key="id" value="'), _xml(F.col("ocel:eid")), F.lit('"/><string key="activity" value="'), _xml(F.col("ocel:activity")), F.lit('"/><date key="timestamp" value="'), _time(F.col("ocel:timestamp")), F.lit('"/><list key="omap">'), rels, F.lit("</list></event>"))
        types = []
        frame = [("0", "", '<log><global scope="log"><string key="version" value="1.0"/><string key="ordering" value="timestamp"/></global>'), ("2", "", "<events>"), ("2~", "", "</events>"), ("3", "", "<objects>"), ("3~", "", "</objects>"), ("4", "", "</log>")]
        at = ("3", "2")
    rows = [df.withColumn("place", none) for df in (spark.createDataFrame(frame, "part string, key string, value string"), *types)]
    rows.append(objects.select(F.lit(at[0]).alias("part"), none.alias("place"), F.concat(F.lit("+"), "ocel:oid").alias("key"), o.alias("value")))
    rows.append(joined.select(F.lit(at[1]).alias("part"), "place", F.concat(F.lit("+"), "ocel:eid").alias("key"), e.alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def write_ocel_xml(objects: DataFrame, events: DataFrame, e2o: DataFrame, path: str, version: str = "2.0", order: DataFrame | None = None) -> None:
    """Text files that make one XML document when read in the order of their names. A range sort, not one task's work."""
    lines = ocel_xml(objects, events, e2o, version, order).orderBy("part", "place", "key")
    lines.select("value").write.mode("overwrite").text(path)


