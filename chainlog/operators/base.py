"""Projections on flat traces: types, names and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX = r"^0[xX][0-9a-fA-F]+$"


def hex_to_long(value: Column) -> Column:
    """A number of at most 63 bits from 0x text; null if it is not one."""
    digits = F.ltrim(F.substring(value, 3, 80), F.lit("0"))
    return F.when(value.rlike(HEX) & ((F.length(digits) < 16) | ((F.length(digits) == 16) & digits.rlike("^[0-7]"))), F.coalesce(F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10), F.lit("0")).cast("long"))


def decimal_text(digits: Column, plus: Column | int = 0) -> Column:
    """A number of at most 64 hex digits without leading zeros as decimal text, or that of the number `plus` above it.

    Up to 30 hex digits are two longs in a decimal; only wider numbers, up to 256 bits, take the way by limbs.
    """
    n, plus = F.length(digits), F.lit(plus)
    low = F.conv(F.substring(digits, -15, 15), 16, 10).cast("decimal(19,0)")
    high = F.conv(F.substr(digits, F.lit(1), F.greatest(n - 15, F.lit(0))), 16, 10).cast("decimal(19,0)")
    two = (high * F.lit(1 << 60).cast("decimal(19,0)") + low + plus).cast("decimal(38,0)").cast("string")
    return F.when(n == 0, plus.cast("string")).when(n <= 15, (low + plus).cast("decimal(38,0)").cast("string")).when(n <= 30, two).when(n <= 64, _by_limbs(digits, plus))


def hex_to_decimal_text(value: Column) -> Column:
    """A number of any width from 0x text, as decimal digits; null if it is not one."""
    return F.when(value.rlike(HEX), decimal_text(F.ltrim(F.substring(value, 3, 80), F.lit("0"))))


def _by_limbs(digits: Column, plus: Column) -> Column:
    """Hex digits are folded six at a time into limbs of nine decimal digits, so 256-bit values keep every digit."""
    padded = F.lpad(digits, 66, "0")
    chunks = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.conv(F.substr(padded, i * 6 + 1, F.lit(6)), 16, 10).cast("long") + F.when(i == 10, plus).otherwise(0))
    zero = F.array(*[F.lit(0).cast("long")] * 9)

    def push(limbs: Column, chunk: Column) -> Column:
        def step(s: Column, limb: Column) -> Column:
            total = limb * (1 << 24) + s["carry"]
            return F.struct(F.call_function("div", total, F.lit(1_000_000_000)).alias("carry"), F.concat(s["limbs"], F.array(total % 1_000_000_000)).alias("limbs"))

        first = F.struct(chunk.alias("carry"), F.array().cast("array<bigint>").alias("limbs"))
        return F.aggregate(limbs, first, step, lambda s: s["limbs"])

    limbs = F.aggregate(chunks, zero, push)
    return F.ltrim(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), F.lit("0"))


def hex_to_int(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as a number, its text kept as <column>_raw. Bad text gives null; a column that is not there is passed over.

    Numbers of the second run come from the raw column again, so running it twice changes nothing.
    """
    for c in columns:
        if f"{c}_raw" in df.columns:
            df = df.withColumn(c, hex_to_long(df[f"{c}_raw"]))
        elif c in df.columns:
            df = df.withColumns({f"{c}_raw": df[c].cast("string"), c: hex_to_long(df[c].cast("string"))})
    return df


def base_transform(trace: DataFrame) -> DataFrame:
    """Epoch seconds to timestamps (UTC), addresses in lower case, type and value under their own names, hex to numbers.

    callvalue becomes decimal text, as it can have 256 bits; callvalue_decimal holds it where 38 digits do.
    """
    missing = {"timeStamp", "to", "from", "address", "type", "value"} - set(trace.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    df = trace.withColumns({"timeStamp": F.timestamp_seconds(F.col("timeStamp").cast("long")), **{c: F.lower(c) for c in ("to", "from", "address")}})
    df = hex_to_int(df.withColumnsRenamed({"type": "calltype", "value": "callvalue"}), ["gas", "gasUsed"])
    df = df.withColumns({"callvalue_raw": F.col("callvalue"), "callvalue": hex_to_decimal_text(F.col("callvalue"))})
    return df.withColumn("callvalue_decimal", F.col("callvalue").try_cast("decimal(38,0)"))


def bytes_to_hex(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.concat(F.lit("0x"), F.lower(F.hex(c))) for c in columns if c in df.columns})


def strings(df: DataFrame) -> DataFrame:
    """Every column that is no number, truth value or time as text, for sinks that want flat columns."""
    plain = ("bigint", "int", "double", "boolean", "timestamp", "timestamp_ntz", "string", "float", "smallint", "tinyint", "date")
    return df.select(*[F.col(c) if t in plain else F.to_json(c).alias(c) if t[:3] in ("arr", "map", "str") else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
