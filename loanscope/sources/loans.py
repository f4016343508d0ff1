"""Readers and writers of loan tables. Schemas are declared, never inferred."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.functions.expressions import null_if_nan
from loanscope.schemas import CLEAN_SCHEMA, RAW_SCHEMA
from loanscope.session import split_wide_code

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
MISSING_TEXTS = ("", "NaN", "nan")
CORRUPT = "_corrupt_record"


def normalised(df: DataFrame) -> DataFrame:
    """Not-a-number becomes missing, so that every range test drops it."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(c) for c in doubles}) if doubles else df


def _texts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All lines of a CSV with header, every field as text."""
    split_wide_code(spark)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(texts).options(header=True, encoding="UTF-8", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
                                            enforceSchema=True).csv(path)


def _converted(f: T.StructField) -> tuple[Column, Column | None]:
    """Value of a field, and whether its text does not hold the type (None for texts)."""
    if isinstance(f.dataType, T.StringType):
        return F.col(f.name), None
    text = F.trim(F.col(f.name))
    missing = F.col(f.name).isNull() | text.isin(*MISSING_TEXTS)
    value = text.try_cast(f.dataType)
    if isinstance(f.dataType, T.IntegralType):
        # a number in its plain spelling needs no pattern
        value = F.when(value.cast("string") == text, value).when(
            text.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(text, r"\..*$", "").try_cast(f.dataType))
    return F.when(~missing, value).alias(f.name), ~missing & value.isNull()


def parse_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """All lines of a CSV with header: the columns of ``schema``, ``bad_columns`` and ``line``.

    Nothing is converted by way of another type. Texts of whole numbers such as ``600000.0`` are accepted in integer
    columns. A field that does not hold its type is named in ``bad_columns``; a line with too few or too many fields names
    all of them. ``line`` is the text of such a line as it was split.
    """
    fields = [(f.name, *_converted(f)) for f in schema.fields]
    bad = [F.when(wrong, F.lit(name)) for name, _, wrong in fields if wrong is not None]
    whole = F.array(*[F.lit(name) for name in schema.names])
    named = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    broken = F.when(F.col(CORRUPT).isNotNull(), whole).otherwise(named)
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(name), F.lit("")) for name in schema.names]))
    out = _texts(spark, path, schema).select(
        *[value for _, value, _ in fields], broken.alias("bad_columns"), F.when(F.size(broken) > 0, line).alias("line"))
    return normalised(out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """The lines that hold their types; ``rejected_csv`` has the others.

    The lines are told apart by one condition, not by the list of their bad columns: no list is built for a line that holds its types.
    """
    fields = [_converted(f) for f in schema.fields]
    holds = reduce(and_, [~wrong for _, wrong in fields if wrong is not None], F.col(CORRUPT).isNull())
    return normalised(_texts(spark, path, schema).filter(holds).select(*[value for value, _ in fields]))


def rejected_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Lines that were set aside: line, bad_columns."""
    return parse_csv(spark, path, schema).filter(F.size("bad_columns") > 0).select("line", "bad_columns")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with a header per file; parent folders are created."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", TIMESTAMP_TEXT).option(
        "encoding", "UTF-8").csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return normalised(reader.parquet(path))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RAW_SCHEMA)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CLEAN_SCHEMA)
