"""File sources: snapshots, feature tables, asset listing, scoring requests."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.scalars import file_stem
from ebbtide.schema import CORRUPT, RAW_REQUEST, REQUEST_LINE, SNAPSHOT, columns_of_type


def _load(reader, fmt: str, path: str) -> DataFrame:
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def read_config(path: str) -> dict:
    """A feature configuration from JSON, or from YAML where PyYAML is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs PyYAML; use JSON instead") from error
        return yaml.safe_load(f)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL once, at the source: later comparisons then treat both the same."""
    floats = columns_of_type(df, (T.DoubleType, T.FloatType))
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def read_snapshot(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = SNAPSHOT,
                  keep_corrupt: bool = False) -> DataFrame:
    """Typed snapshot. A missing path is a FileNotFoundError.

    CSV columns are bound by the names in the header, whatever their order; a declared
    column that the file lacks is NULL, one that is not declared is left out, and further
    files of a folder must have the same header. Rows that do not parse become NULL cells;
    ``keep_corrupt`` adds their text.
    """
    if fmt == "csv":
        return nan_to_null(_csv_by_name(spark, path, schema, keep_corrupt))
    return nan_to_null(_load(spark.read, fmt, path))


def _csv_by_name(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    declared = {f.name: f for f in schema.fields}
    found = [declared.get(n, T.StructField(n, T.StringType())) for n in csv_header(spark, path)]
    corrupt = [T.StructField(CORRUPT, T.StringType())] if keep_corrupt else []
    reader = spark.read.schema(T.StructType([*found, *corrupt])).option("header", True).option("enforceSchema", False)
    df = _load(reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT), "csv", path)
    present = {f.name for f in found}
    cells = [F.col(f"`{f.name}`") if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cells, *[CORRUPT for _ in corrupt])


def read_text_snapshot(spark: SparkSession, path: str, schema: T.StructType = SNAPSHOT) -> DataFrame:
    """The CSV cells as text, so that type checks can count what does not cast."""
    return _csv_by_name(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in schema.names]))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names as the file states them (a schema given to the reader hides them)."""
    return _load(spark.read.option("header", True), "csv", path).columns


def cast_columns(df: DataFrame, schema: T.StructType = SNAPSHOT) -> DataFrame:
    """Cast to declared types; cells that do not cast become NULL."""
    return df.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields if f.name in df.columns})


def list_assets(spark: SparkSession, folder: str, pattern: str = r"^(.*)\.csv$") -> DataFrame:
    """Files whose names match, asset name = first group. File contents are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        _load(spark.read, "binaryFile", folder)
        .select("path", "modificationTime", "length", name.alias("file"))
        .filter(F.col("file").rlike(pattern))
        .withColumn("asset", F.regexp_extract("file", pattern, 1))
    )


def latest_asset(spark: SparkSession, folder: str, pattern: str = r"^(.*)\.csv$") -> str:
    """Path of the last matching file in name order."""
    path = list_assets(spark, folder, pattern).agg(F.max_by("path", "file")).first()[0]
    if path is None:
        raise FileNotFoundError(f"{folder}: no file matches {pattern}")
    return path


def with_batch_id(df: DataFrame, column: str = "batch_id") -> DataFrame:
    """Tag rows read from files with the stem of their file name."""
    return df.withColumn(column, file_stem(F.col("_metadata.file_path")))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Scoring requests from JSON lines, every field as text until the row rules cast it.

    A line that is no JSON object keeps its text in a column of its own, for its reject.
    """
    return _load(spark.read.schema(REQUEST_LINE).option("columnNameOfCorruptRecord", CORRUPT), "json", path)


def explode_batches(df: DataFrame, body: str = "body") -> DataFrame:
    """Batch requests ``{"customers": [...]}`` -> one row per record with its position.

    A body that does not parse or holds no record keeps one row with a NULL position.
    """
    batch = T.StructType([T.StructField("customers", T.ArrayType(RAW_REQUEST))])
    parsed = F.from_json(F.col(body), batch)["customers"]
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.posexplode_outer(parsed).alias("position", "record")).select(*rest, "position", "record.*")
