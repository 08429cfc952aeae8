"""Reading raw files and tables. Local folders, s3a:// and other file systems are the same to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: StructType, *, multiline: bool = False) -> DataFrame:
    """A file with a header, quoted texts, doubled quotes, and a mark of its encoding or none.

    Such a file is read by many tasks. Only where quoted texts hold line ends, which the
    caller says by multiline, one task reads a whole file.     Nothing is null: an absent value is '', and what else says "nothing" is up to the caller.
    """
    reader = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
    rows = reader.option("multiLine", multiline).option("enforceSchema", True).option("emptyValue", "").csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if f.dataType == StringType() else F.col(f"`{f.name}`") for f in schema.fields])


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file, or the part files of a folder, with one object a line; blank lines are skipped, a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_checked(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): broken has the file and text of every line that is no object of this schema."""
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("file", F.input_file_name())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.select("file", "value", F.from_json("value", wide, options).alias("r"))
    good = parsed.filter(f"r is not null and r.{CORRUPT} is null").select("r.*").drop(CORRUPT)
    return good, parsed.filter(f"r is null or r.{CORRUPT} is not null").select("file", F.col("value").alias("line"))


def read_groups(spark: SparkSession, path: str, schema: StructType, *, group: str, order: str) -> DataFrame:
    """(group, rows): rows of a group together, in order, wherever they stand in the files."""
    rows = read_jsonl(spark, path, schema)
    rest = [order, *[f.name for f in schema.fields if f.name not in (group, order)]]
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))


def read_table(spark: SparkSession, path: str, *, format: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """A columnar table; the columns named reach the scan."""
    df = spark.read.format(format).load(path)
    return df.select(*columns) if columns else df


def code_lookup(table: DataFrame, code: str, names: list[str]) -> DataFrame:
    """(code, names): the distinct names of a code that aren't empty."""
    return table.groupBy(F.col(code).alias("code")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(*names), lambda x: x.isNotNull() & (x != "")))))).alias("names"))


def window_of(df: DataFrame, order: str, *, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows after the first `skip` in order, at most `limit` of them."""
    rows = df.orderBy(order).offset(skip)
    return rows if limit is None else rows.limit(limit)


def accepted_and_quarantined(df: DataFrame, rules: dict[str, F.Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): a row that breaks a rule is set aside with the rules' names; no row is lost."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    checked = df.withColumn("reasons", reasons)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)
