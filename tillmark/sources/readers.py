"""Readers for the input tables, and the guards on empty inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.types import StructType

from tillmark.operators.contracts import STORE_CONTRACT
from tillmark.operators.matching import LETTER_COLUMNS, LETTER_DATES

# Spellings of "missing" in CSV and spreadsheet cells.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
LETTER_GLOB = "*announcement*"


def store_schema(upper: bool = False) -> StructType:
    """Declared schema of the per-store input files."""
    names = [f.name.upper() if upper else f.name for f in STORE_CONTRACT.fields]
    types = [f.dtype for f in STORE_CONTRACT.fields]
    return StructType.fromDDL(", ".join(f"{n} {t}" for n, t in zip(names, types)))


def store_id_from_file(path: Column | None = None) -> Column:
    """File name up to its first dot."""
    name = F.col("_metadata.file_name") if path is None else path
    return F.regexp_extract(name, r"([^/\\.]*)[^/\\]*$", 1)


def read_store_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | None = None,
    file_id: str | None = None,
) -> DataFrame:
    """All store files under ``path`` as one table, in a format that Spark reads itself.

    ``file_id`` adds a column with the store number taken from the file name.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.format(fmt).load(path)
    return df.withColumn(file_id, store_id_from_file()) if file_id else df


def read_if_present(spark: SparkSession, path: str | None, fmt: str = "parquet") -> DataFrame | None:
    """The table, or None when no path is given or nothing is there."""
    if path is None:
        return None
    try:
        return read_store_table(spark, path, fmt)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text columns with the usual spellings of "missing" set to NULL."""
    text = [n for n, t in df.dtypes if t == "string"]
    return df.withColumns({n: F.when(~F.col(n).isin(*MISSING_TOKENS), F.col(n)) for n in text})


def _csv(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", multi_line)


def read_store_master(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Store master CSV.  Without a schema every column but STORE_ID is text.

    ``multi_line`` lets a quoted cell hold line breaks; a file is then one task.
    """
    reader = _csv(spark, multi_line)
    if schema is not None:
        return missing_to_null(reader.schema(schema).csv(path))
    df = missing_to_null(reader.csv(path))
    ids = {c: F.col(c).cast("bigint") for c in df.columns if c.lower() == "store_id"}
    return df.withColumns(ids)


# Column of a row's text where the row has another number of cells.
BAD_ROW = "__row"
MALFORMED = ("fail", "leave-out")


def _letter_rows(spark: SparkSession, path: str, glob: str, multi_line: bool, mode: str) -> DataFrame:
    """The nine cells of every letter row as text.

    The parser counts the cells only of columns it parses, so it parses all of them
    whatever is selected.
    """
    names = LETTER_COLUMNS + ([BAD_ROW] if mode == "PERMISSIVE" else [])
    return (
        _csv(spark, multi_line)
        .option("pathGlobFilter", glob)
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", BAD_ROW)
        .option("columnPruning", False)
        .schema(", ".join(f"{c} string" for c in names))
        .csv(path)
    )


def read_letters_csv(
    spark: SparkSession,
    path: str,
    date_format: str = "yyyy-MM-dd",
    glob: str = LETTER_GLOB,
    multi_line: bool = False,
    malformed: str = "fail",
) -> DataFrame:
    """Letter files (one header line each) matched by position, in one read.

    A row with more or fewer than nine cells fails the read, or with
    ``malformed="leave-out"`` stays out of it; a cell that should hold a date and does
    not fails the read as well, or is missing.  :func:`letter_violations` lists both.
    ``multi_line`` is described at :func:`read_store_master`.
    """
    if malformed not in MALFORMED:
        raise ValueError(f"malformed must be one of {MALFORMED}")
    raw = _letter_rows(spark, path, glob, multi_line, "FAILFAST" if malformed == "fail" else "PERMISSIVE")
    if malformed != "fail":
        # Spark refuses to read that column alone, so the test takes in the others
        others = F.xxhash64(*LETTER_COLUMNS) >= F.lit(-(1 << 63))
        raw = raw.where(F.col(BAD_ROW).isNull() & others).drop(BAD_ROW)
    to_date = F.to_date if malformed == "fail" else F.try_to_date
    dates = {c: to_date(F.col(c), date_format) for c in LETTER_DATES}
    return require_rows(missing_to_null(raw).withColumns(dates), f"No warning letters in: {path}")


def letter_violations(
    spark: SparkSession,
    path: str,
    date_format: str = "yyyy-MM-dd",
    glob: str = LETTER_GLOB,
    multi_line: bool = False,
) -> DataFrame:
    """Rows of the letter files that break their form: ``file, rule, column, value, row``.

    ``cells`` is a row with more or fewer than nine cells; ``value`` is its first cell.
    ``date`` is a cell of a well-formed row that holds text but no date.
    """
    raw = _letter_rows(spark, path, glob, multi_line, "PERMISSIVE").withColumn("file", F.col("_metadata.file_name"))
    raw = raw.withColumns(
        {c: F.when(~F.col(c).isin(*MISSING_TOKENS), F.col(c)) for c in LETTER_COLUMNS}
    )
    text = F.to_csv(F.struct(*LETTER_COLUMNS))

    def broken(test: Column, rule: str, column: str, row: Column) -> Column:
        named = [F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(column).alias("value")]
        return F.when(test, F.struct(*named, row.alias("row")))

    formed = F.col(BAD_ROW).isNull()
    rules = [broken(~formed, "cells", LETTER_COLUMNS[0], F.col(BAD_ROW))]
    for c in LETTER_DATES:
        undated = F.col(c).isNotNull() & F.try_to_date(F.col(c), date_format).isNull()
        rules.append(broken(formed & undated, "date", c, text))
    return raw.select("file", F.explode(F.array_compact(F.array(*rules))).alias("found")).select("file", "found.*")


def read_reviewed_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The review sheet with the reviewer's 0/1 column ``matching``.

    Only the columns that the treatment needs are typed, the others stay text.
    """
    sheet = _csv(spark, False).csv(path)
    kinds = {"store_id": "bigint", "insp_date": "date", "issue_date": "date", "matching": "int"}
    return missing_to_null(sheet).withColumns(
        {c: F.col(c).cast(kinds[c.lower()]) for c in sheet.columns if c.lower() in kinds}
    )


def require_rows(df: DataFrame, message: str, error: type[Exception] = ValueError) -> DataFrame:
    """``df``, or ``error`` when it has no row (reads at most one)."""
    if df.isEmpty():
        raise error(message)
    return df
