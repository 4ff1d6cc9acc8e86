"""Reading reviews."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructField

from reviewmill.constants import REQUIRED_COLUMNS
from reviewmill.schema import REVIEW, MissingColumns
from reviewmill.sources.csv_ranges import read_csv


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").columns


def read_reviews_csv(spark: SparkSession, path: str, bad: Observation | None = None) -> DataFrame:
    """The six review columns by header name, typed; a value that does not fit becomes NULL. bad is given the number of such
    values in each column, by the pass that reads the rows. A row without review_id is refused by require_unique_ids.

    Quoted texts may span lines; a large file is read by many tasks all the same.
    """
    columns = _header(spark, path)
    missing = sorted(set(REQUIRED_COLUMNS) - set(columns))
    if missing:
        raise MissingColumns("missing required columns: " + ", ".join(missing))
    raw = read_csv(spark, path, columns)
    if bad is not None:
        raw = raw.observe(bad, *[_misfits(f).alias(f.name) for f in REVIEW])
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in REVIEW])


def _misfits(field: StructField) -> Column:
    return F.count_if(F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull())


def unparsable(spark: SparkSession, path: str) -> DataFrame:
    """One row: for each column, the number of values given that do not fit its type. See read_reviews_csv for a count
    that needs no pass of its own."""
    return read_csv(spark, path, _header(spark, path)).agg(*[_misfits(f).alias(f.name) for f in REVIEW])


def check_reviews_csv(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Can this file be analysed? Looks at the header only."""
    try:
        missing = sorted(set(REQUIRED_COLUMNS) - set(_header(spark, path)))
    except AnalysisException as exc:
        return False, f"cannot read: {exc.getCondition() or exc}"
    return (False, "missing required columns: " + ", ".join(missing)) if missing else (True, "OK")
