"""Sources and sinks (S1-S3, S5, S7-S9). Reading is lazy; pruning and pushdown are left to Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import norm_id, to_bool, to_num
from ..operators.clean import clean_domain, resolve

#: Columns that a holdings file may have, and the names that the operators use.
HOLDINGS = {"LgcyInvestorId": "fund", "day": "day", "security": "security", "InvTypeCode": "inv_type", "isUs": "is_us", "SharesHld": "shares", "SHsHldChg": "shares_change", "ShsHldVal": "position_value", "ShsHldValChg": "value_change", "MARKET_CAP": "market_cap", "VOLUME": "volume"}
#: Columns of long signal files.
SIGNAL_SCHEMA = "date date, perm_id string, trade_id string, signal_name string, signal_val double"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_mapped(df: DataFrame, col_map: Mapping[str, str], required: Sequence[str] = (), optional: Mapping[str, str] | None = None) -> DataFrame:
    """Renames the mapped columns that exist (whatever their case); raises without required ones; absent optional ones (name: type) are null."""
    found = {new: resolve(df, old, required=False) for old, new in col_map.items()}
    missing = [c for c in required if not found.get(c)]
    if missing:
        raise ValueError(f"missing columns {missing} among {df.columns}")
    nulls = [F.lit(None).cast(kind).alias(c) for c, kind in (optional or {}).items() if not found.get(c)]
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in found.items() if old], *nulls)


def read_holdings(spark: SparkSession, root: str, years: Sequence[int], us_only: bool = False, inv_type: str | None = None, fund_columns: Sequence[str] = ("LgcyInvestorId", "InvestorId", "fund"), name: str = "{year}.parquet") -> DataFrame:
    """Yearly files <root>/<year>.parquet, those that exist, with canonical ids, flags and names; only needed columns are read.

    ``name`` says how a year's file or folder is called, as in "year={year}" for tables that Spark divided by year.
    """
    paths = [p for p in (f"{root}/{name.format(year=y)}" for y in years) if _exists(spark, p)]
    if not paths:
        raise FileNotFoundError(f"no year of {list(years)} under {root}")
    raw = spark.read.option("mergeSchema", True).parquet(*paths)
    fund = resolve(raw, *fund_columns)
    df = read_mapped(raw, {k: v for k, v in HOLDINGS.items() if v != "fund"} | {fund: "fund"}, ["fund", "day", "security", "position_value"], {"inv_type": "string", "is_us": "string", "shares": "double", "market_cap": "double"})
    df = df.withColumns({"fund": norm_id("fund"), "security": norm_id("security"), "inv_type": norm_id("inv_type"), "is_us": to_bool("is_us"), "day": F.to_date("day")})
    if us_only:
        df = df.filter("is_us")
    return df.filter(F.col("inv_type") == str(inv_type)) if inv_type is not None else df


def read_signal_csv(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """One signal of a long CSV file: date, perm_id (canonical), value. The reader drops other rows as it scans."""
    rows = spark.read.csv(path, schema=SIGNAL_SCHEMA, header=True).filter(F.col("signal_name") == signal)
    return rows.select("date", norm_id("perm_id").alias("perm_id"), F.when(~F.isnan("signal_val"), F.col("signal_val")).alias("value"))


def read_glob(spark: SparkSession, pattern: str, format: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """All files of a pattern (parquet, csv or json by ending), with ``source_file``."""
    format = format or next((f for f in ("parquet", "csv", "json") if f".{f}" in pattern), "parquet")
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.load(pattern).withColumn("source_file", F.col("_metadata.file_name"))


def check_coverage(series: DataFrame, date: str, low, high, tolerance: int = 7) -> DataFrame:
    """``series`` itself; raises if it starts or ends more than ``tolerance`` days inside [low, high]."""
    span = series.agg(F.datediff(F.min(date), F.lit(low).cast("date")).alias("late"), F.datediff(F.lit(high).cast("date"), F.max(date)).alias("early")).first()
    if span["late"] is None or span["late"] > tolerance or span["early"] > tolerance:
        raise ValueError(f"series covers too little of {low} to {high}: {span}")
    return series


def read_daily(spark: SparkSession, path: str, required: Sequence[str] = ("day", "security", "TRET_T1D", "turnover_21day", "market_cap"), price: str = "auto") -> DataFrame:
    """Daily panel: required columns, numbers coerced, days as dates, invalid values null, ``price`` if there is one (never negative)."""
    raw = spark.read.parquet(path)
    named = read_mapped(raw, {c: c for c in required}, required)
    column = resolve(raw, "price", "prc", "close", required=False) if price == "auto" else resolve(raw, price)
    if column:
        named = read_mapped(raw, {c: c for c in required} | {column: "price"}, required)
    numbers = [c for c in named.columns if c not in ("day", "security")]
    df = named.withColumns({c: to_num(c) for c in numbers} | {"day": F.to_date("day")})
    return clean_domain(df, [c for c in numbers if c.startswith("TRET")], [c for c in numbers if "turnover" in c or "VOLUME" in c], [c for c in numbers if c == "market_cap"], ["price"] if column else [])


def write_results(frames: Mapping[str, DataFrame], path: str, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Each frame under <path>/<name> as parquet, csv or json."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite").format(format)
        if format == "csv":
            writer = writer.option("header", True)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{path}/{name}")


def write_config(spark: SparkSession, config: Mapping, path: str) -> None:
    """The run's settings as one JSON row, through Spark, so that any store works."""
    import json

    spark.createDataFrame([(json.dumps(dict(config), default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir; where that is unset, a local one in local mode and an error on a cluster."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="panelwise-")
    return f"{folder.rstrip('/')}/panelwise-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as parquet in a ``scratch_folder``, of which each use reads the columns it needs; on a cluster without such a folder ``df`` as it is, with a warning."""
    import warnings

    try:
        path = f"{scratch_folder(df.sparkSession)}/rows.parquet"
    except RuntimeError:
        warnings.warn("no checkpoint folder is set: the rows are computed anew for each use", stacklevel=2)
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_panel(df: DataFrame, table: str, keys: Sequence[str], period: str = "qi", buckets: int = 200, path: str | None = None) -> DataFrame:
    """Saves ``df`` as a catalog table laid out for lags: bucketed by ``keys``, each bucket one file sorted by keys and period. Returns the table.

    Windows and aggregates by the keys, or by more columns than these, read it without a shuffle,
    and so do joins by just these keys with a table of the same layout. ``buckets`` should leave a bucket small enough for a task.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, period)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
