"""Readers of the raw tables, uploads, gold tables and the text corpus."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions import scalar as S
from orderlens.schemas import RAW_FILES, RAW_SCHEMAS

CSV_OPTIONS = {"header": "true", "escape": '"'}
# Review texts and uploads may hold line breaks, so their records span lines and a file is one
# task; files of all other tables are split.
MANY_LINES = {"multiLine": "true"}
FREE_TEXT_TABLES = frozenset({"reviews"})

# Uploaded ids stay text whatever they look like.
UPLOAD_IDS = ("order_id", "id")


class MissingSource(FileNotFoundError):
    """A raw table's file is not there."""


def read_raw_table(spark: SparkSession, raw_dir: str, name: str) -> DataFrame:
    """One raw CSV table with its declared schema; a missing file is an error."""
    path = f"{raw_dir}/{RAW_FILES[name]}"
    try:
        options = CSV_OPTIONS | (MANY_LINES if name in FREE_TEXT_TABLES else {})
        return spark.read.schema(RAW_SCHEMAS[name]).options(**options).csv(path)
    except AnalysisException as error:
        raise MissingSource(f"raw table {name} not found at {path}") from error


def read_raw_tables(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """All nine raw tables, keyed by logical name."""
    return {name: read_raw_table(spark, raw_dir, name) for name in RAW_FILES}


def read_uploaded_orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders sent as CSV: header row, blank cell = missing, everything as text.

    Numbers are cast where they are used, so one odd cell costs that cell only.
    """
    raw = spark.read.options(**CSV_OPTIONS, **MANY_LINES, inferSchema="false").csv(path)
    return raw.select(*[
        F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in raw.columns
    ])


def upload_number(uploads: DataFrame, name: str) -> Column:
    """An uploaded column as a number, null where it is none or was not sent."""
    if name in UPLOAD_IDS:
        raise ValueError(f"{name} is an id and stays text")
    return S.safe_double(F.col(name)) if name in uploads.columns else F.lit(None).cast("double")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A whole Parquet table."""
    return spark.read.parquet(path)


def read_columns(table: DataFrame, *columns: str, status: str | None = None) -> DataFrame:
    """A pruned scan, optionally of one status only; both reach the Parquet reader."""
    rows = table if status is None else table.where(F.col("order_status") == status)
    return rows.select(*columns)


def lookup(table: DataFrame, ids: DataFrame, *columns: str, key: str = "order_id") -> DataFrame:
    """Columns of the rows whose key is listed.

    The id list is not broadcast by hint: the optimizer does so when the list's
    size allows it and joins by shuffle when it does not.
    """
    return table.select(key, *columns).join(ids.select(key).distinct(), key, "left_semi")


#: Keys that a point look-up puts into its filter.
LISTED_KEYS = 1_000


def look_up(table: DataFrame, keys: list, *columns: str, key: str = "order_id") -> DataFrame:
    """Columns of the rows with one of a few known keys.

    The keys are a filter of the scan, so row groups whose smallest and largest key or whose
    Bloom filter rule them out are not read.  For many keys ``lookup`` joins instead.
    """
    if len(keys) > LISTED_KEYS:
        raise ValueError(f"more than {LISTED_KEYS} keys: join with lookup")
    return table.where(F.col(key).isin(list(keys))).select(key, *columns)


def read_corpus(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """The text corpus: id, text and source, as a JSON array or one record per line.

    An array is one unsplittable record; a corpus of any size comes line by line.
    """
    return spark.read.schema("id string, text string, source string").option(
        "multiLine", str(not one_per_line).lower()
    ).json(path)
