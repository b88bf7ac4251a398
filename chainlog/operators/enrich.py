"""Readable activities and contracts: initial transforms, renaming, labels, and what market creations tell of later steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DataType, StructType, VariantType, _parse_datatype_string

from .filters import flag_in_set
from .graph import label_by_relative

MARKET_TYPES = {"0": "yes-no", "1": "categorical", "2": "scalar"}
#: Parts to which rows without a market are dealt.
LEFT_PARTS, RIGHT_PARTS = 64, 8
#: Rows of a block, which meet a row of the other side one after another.
BLOCK = 256


def _lower(df: DataFrame, column: str) -> dict[str, Column]:
    return {column: F.lower(column)} if column in df.columns else {}


def initial_events(df: DataFrame, dapp: bool, reverted: DataFrame) -> DataFrame:
    """Event rows under the log's names; undecoded ones are named so."""
    cols: dict[str, Column] = {}
    if "name" in df.columns:
        cols["name"] = F.coalesce("name", F.lit("undecoded event"))
    if "address" in df.columns:
        cols["address_lower"] = F.lower("address")
    if dapp:
        cols |= _lower(df, "market")
    df = df.withColumns(cols) if cols else df
    df = df.withColumnsRenamed({"hash": "txHash", "name": "Activity"}).drop("Unnamed: 0", "functionName")
    df = df.withColumn("flag_log_entry", F.lit(True))
    if "txHash" in df.columns:
        df = flag_in_set(df, "txHash", reverted, "flag_reverted")
    return df.withColumn("flag_dapp_contract", F.lit(dapp))


def initial_calls(df: DataFrame, dapp: bool, reverted: DataFrame) -> DataFrame:
    """Call rows under the log's names; a call's activity is its function's name, or its type if there is none."""
    cols: dict[str, Column] = {}
    if "to" in df.columns:
        cols["address_lower"] = F.lower("to")
    if dapp:
        cols |= _lower(df, "market")
    if "name" in df.columns:
        function = F.when(F.col("name").isNotNull(), F.regexp_extract("name", r"<Function ([^(]*)\(", 1))
        cols["name"] = function
        cols["Activity"] = F.coalesce(F.when(F.contains("calltype", F.lit("CALL")), function), F.col("calltype"))
    df = df.withColumns(cols) if cols else df
    df = df.withColumnsRenamed({"hash": "txHash"})
    if "txHash" in df.columns:
        df = flag_in_set(df, "txHash", reverted, "flag_reverted")
    return df.withColumns({"flag_dapp_contract": F.lit(dapp), "flag": F.lit("message_call")})


def rename_attribute(df: DataFrame, attribute: str, new: str, names: DataFrame) -> DataFrame:
    """The value that names (key, value) gives, or the old one. A column that is not there is passed over."""
    if attribute not in df.columns:
        return df
    pairs = names.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    df = df.join(pairs, F.col(attribute).cast("string") == F.col("__key"), "left")
    return df.withColumn(new, F.coalesce("__value", F.col(attribute).cast("string"))).drop("__key", "__value")


def combine_attributes(df: DataFrame, first: str, second: str, new: str, separator: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """first + separator + second where first is not excluded and second is known, else null."""
    if first not in df.columns or second not in df.columns:
        return df.withColumn(new, F.lit(None).cast("string"))
    fit = F.col(second).isNotNull() & F.col(first).isNotNull()
    if excluded:
        fit = fit & ~F.col(first).isin(*excluded)
    return df.withColumn(new, F.when(fit, F.concat(first, F.lit(separator), second)))


def contract_sensitive(df: DataFrame, split: tuple[str, ...]) -> DataFrame:
    """The activity with its contract's label, for the activities that are to be split."""
    if "contract_name" not in df.columns:
        return df.withColumn("Activity_contract_sensitive", F.lit(None).cast("string"))
    fit = F.col("Activity").isin(*split) & F.col("contract_name").isNotNull()
    return df.withColumn("Activity_contract_sensitive", F.when(fit, F.concat("Activity", F.lit(", contract: "), "contract_name")))


def contract_sensitive_by(df: DataFrame, split: DataFrame) -> DataFrame:
    """The same for the activities in the column `key` of a table."""
    names = split.select(F.col("key").alias("__split")).distinct().withColumn("__is_split", F.lit(True))
    flagged = df.join(names, df["Activity"] == names["__split"], "left")
    label = F.col("contract_name") if "contract_name" in df.columns else F.lit(None).cast("string")
    made = F.when(F.col("__is_split") & label.isNotNull(), F.concat("Activity", F.lit(", contract: "), label))
    return flagged.withColumn("Activity_contract_sensitive", made).drop("__split", "__is_split")


def token_sensitive(df: DataFrame) -> DataFrame:
    return combine_attributes(df, "Activity", "tokenType_name", "Activity_token_sensitive", ", token type: ")


def activity_override(df: DataFrame) -> DataFrame:
    """The sensitive activity instead of the plain one, which is kept; the contract's wins over the token's."""
    chain = [F.col(c) for c in ("Activity_contract_sensitive", "Activity_token_sensitive") if c in df.columns]
    return df.withColumn("Activity_raw", F.col("Activity")).withColumn("Activity", F.coalesce(*chain, F.col("Activity_raw")))


def label_contracts(df: DataFrame, creations: DataFrame, contracts: DataFrame, factory_labels: DataFrame, known_labels: DataFrame) -> DataFrame:
    """contract_name of address_lower: a known contract's own label, or a factory's, or the one inherited from its creator.

    Without address_lower nothing changes.
    """
    if "address_lower" not in df.columns:
        return df
    maps = {
        "known": known_labels.select(F.col("key").alias("__a"), F.col("value").alias("__known")),
        "factory": factory_labels.select(F.col("key").alias("__a"), F.col("value").alias("__factory")),
        "inherited": label_by_relative(creations, contracts, factory_labels).select(F.col("address").alias("__a"), F.col("inherited_label").alias("__inherited")),
    }
    for m in maps.values():
        df = df.join(m, df["address_lower"] == m["__a"], "left").drop("__a")
    return df.withColumn("contract_name", F.coalesce("__known", "__factory", "__inherited")).drop("__known", "__factory", "__inherited")


def repaired_json(text: Column) -> Column:
    """A JSON text as VARIANT; one that was cut within a string is closed; null if that does not help."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.concat(text, F.lit('"}'))))


def json_fields(values: Column, df: DataFrame, prefix: str = "") -> dict[str, str]:
    """New name to path for every key that objects of a VARIANT column have, in order of name; keys of nested objects are dotted.

    Found by one aggregate that merges the rows' schemas, so what comes to the driver is as large as the keys, not the rows.
    What is an object in one row and something else in another is one field, as are arrays. Names that differ in nothing but
    case get their number. A key with both kinds of quotes has no path, and so no field.
    """
    objects = df.where(F.startswith(F.schema_of_variant(values), F.lit("OBJECT")))
    ddl = objects.agg(F.schema_of_variant_agg(values).alias("s")).first()["s"]
    found: list[tuple[str, str]] = []

    def walk(schema: DataType, name: str, path: str) -> None:
        for f in schema.fields:
            own = name + f.name
            quote = '"' if "'" in f.name else "'"
            if quote in f.name:
                continue
            step = f"{path}[{quote}{f.name}{quote}]"
            if isinstance(f.dataType, StructType):
                walk(f.dataType, own + ".", step)
            else:
                found.append((own, step))

    schema = _parse_datatype_string(ddl.replace("OBJECT<", "STRUCT<")) if ddl else None
    if isinstance(schema, StructType):
        walk(schema, prefix, "$")
    taken: dict[str, int] = {}
    out = {}
    for name, path in sorted(found):
        taken[name.lower()] = taken.get(name.lower(), 0) + 1
        out[name if taken[name.lower()] == 1 else f"{name}_{taken[name.lower()]}"] = path
    return out


def extra_info(df: DataFrame, fields: dict[str, str] | None = None, text: str = "extraInfo", market: str = "market", prefix: str = "info_") -> DataFrame:
    """(market, <fields>) of market creations; fields: new name to path in the JSON, or None for all keys that there are, by
    their dotted names with the prefix. Each row keeps its own market. Objects and arrays are given as JSON text."""
    made = df.where(F.col("Activity") == "create market").select(market, text, repaired_json(F.col(text)).alias("__v"))
    fields = json_fields(F.col("__v"), made, prefix) if fields is None else fields
    cols = [F.try_variant_get("__v", path, "string").alias(name) for name, path in fields.items()]
    return made.select(market, *cols, (F.col(text).isNotNull() & F.col("__v").isNull()).alias("extra_info_broken"))


def market_type(df: DataFrame, market: str = "market") -> DataFrame:
    """(market, marketType) of market creations with a known type, by name."""
    code = F.col("marketType").cast("string")
    name = F.lit(None).cast("string")
    for k, v in MARKET_TYPES.items():
        name = F.when(code == k, F.lit(v)).otherwise(name)
    return df.where((F.col("Activity") == "create market") & F.col("marketType").isNotNull()).select(market, F.coalesce(name, code).alias("marketType"))


def join_market(df: DataFrame, info: DataFrame, market: str = "market", suffix: str = "_propagated", null_matches: bool = True) -> DataFrame:
    """LEFT join on the market; columns that both have get the suffix on the right.

    With null_matches a null market equals a null market, so n and m rows without one make n * m; a run does without. These
    pairs are no key's, whose rows would meet in one task: the left's rows are dealt to parts and the right's too, and each
    part of the one meets each part of the other in a group of its own, of which Spark's tasks have some each. There, a row of
    the right meets a block of the left, then the next row the same block, and so on: in columns written in this order the
    right's values stay for a block and the left's come again, so that Parquet needs some tenths of a byte for a pair.
    """
    right = info.select(*[F.col(f"`{c}`").alias("__m" if c == market else c + suffix if c in df.columns else c) for c in info.columns])
    known = df.where(F.col(market).isNotNull()) if null_matches else df
    found = known.join(right, known[market] == right["__m"], "left").drop("__m")
    if not null_matches:
        return found
    left, others = df.where(F.col(market).isNull()), right.where("__m IS NULL").drop("__m")
    mine = _blocks(left, "__mine", "__i", LEFT_PARTS, "__j", RIGHT_PARTS)
    theirs = _blocks(others, "__theirs", "__j", RIGHT_PARTS, "__i", LEFT_PARTS)
    # a row with its block is a row of the plan, so that no more than a block's pairs are held at once
    one = F.transform("__theirs", lambda r: F.struct(r.alias("__r"), F.col("__mine").alias("__mine")))
    met = mine.join(theirs, ["__j", "__i"]).select(F.explode(one).alias("__one")).select("__one.__r.*", "__one.__mine")
    pairs = met.select("*", F.inline("__mine")).drop("__mine")
    alone = left.join(others.limit(1).select(F.lit(True).alias("__any")), F.lit(True), "left_anti")
    return found.unionByName(pairs).unionByName(alone, allowMissingColumns=True)


def _blocks(df: DataFrame, name: str, own: str, parts: int, other: str, others: int) -> DataFrame:
    """(__j, __i, name): the rows of each part, once for each part of the other side, in arrays of BLOCK rows at most."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    rows = df.select(row, _part(df, parts).alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__j", "__i")
    number = F.row_number().over(Window.partitionBy("__j", "__i").orderBy(F.lit(0)))
    return rows.withColumn("__n", F.floor((number - 1) / BLOCK)).groupBy("__j", "__i", "__n").agg(F.collect_list("__row").alias(name)).drop("__n")


def _part(df: DataFrame, parts: int) -> Column:
    """A row's part by a hash of its plain columns."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    return F.pmod(F.xxhash64(F.lit(0), *plain), F.lit(parts)).cast("int")


def creations_of(creations: DataFrame, dapp: bool) -> DataFrame:
    return creations.withColumnsRenamed({"hash": "txHash"}).withColumns({"dapp": F.lit(dapp), "Activity": F.lit("create new contract")})


def activity_counts(df: DataFrame, column: str = "Activity") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def factories(creations: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts of the DApp that created others, with how many, most first."""
    own = contracts.select(F.col("address").alias("__c")).distinct()
    return creations.join(own, F.col("from") == F.col("__c"), "left_semi").groupBy("from").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from")
