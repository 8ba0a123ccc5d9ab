"""Readers and writers.

Files are read with a declared schema (no inference pass); optional
sources become typed NULL columns; outputs are written by Spark tasks,
never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               fmt: str = "parquet", header: bool = True) -> DataFrame:
    """Read a table with a declared schema. CSV uses the header row and
    the declared types (bad fields -> NULL in PERMISSIVE mode); NaN-bearing
    doubles should go through `quality.nan_to_null` at ingest."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", header).option("mode", "PERMISSIVE").csv(path)
    return r.format(fmt).load(path)


def source_exists(spark: SparkSession, path_or_table: str) -> bool:
    """Does the optional source exist (catalog table or file path)?"""
    if "/" not in path_or_table and ":" not in path_or_table:
        return bool(spark.catalog.tableExists(path_or_table))
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path_or_table)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def optional_source(spark: SparkSession, path: str, schema: StructType, key: str,
                    spine: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Left-join an optional source onto `spine` by `key`; when the source
    is absent, its columns are added as typed NULLs so the schema is stable."""
    if source_exists(spark, path):
        src = read_table(spark, path, schema, fmt)
        return spine.join(src, key, "left")
    return spine.withColumns({f.name: F.lit(None).cast(f.dataType)
                              for f in schema.fields if f.name != key})


def schema_matches(df: DataFrame, expected: StructType, check_types: bool = True) -> bool:
    """header/schema equals the declared one (names in order, and types)."""
    if [f.name for f in df.schema.fields] != [f.name for f in expected.fields]:
        return False
    if check_types:
        return all(a.dataType == b.dataType for a, b in zip(df.schema.fields, expected.fields))
    return True


def schema_guard(spark: SparkSession, path: str, expected: StructType, fmt: str = "parquet") -> bool:
    """True when an existing output at `path` can be resumed; False when
    it is absent or its schema differs (caller rebuilds into a new path)."""
    if not source_exists(spark, path):
        return False
    return schema_matches(read_table(spark, path, None, fmt), expected)


def export_template(template: DataFrame, predictions: DataFrame, key: str, columns) -> DataFrame:
    """Predictions laid out on the template's rows and column order.
    A left join on the template spine (no row lost or added), then the
    template order; a single file is a matter of the final write only."""
    return template.join(predictions, key, "left").select(*columns)


def write_single_file(df: DataFrame, path: str, order, fmt: str = "csv") -> None:
    """One ordered output file, written by one task, which is what a
    single file means. The rows are computed by all tasks before the shuffle
    into that task; it sorts them there, spilling if need be."""
    (df.repartition(1).sortWithinPartitions(*order)
     .write.mode("overwrite").option("header", True).format(fmt).save(path))


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Metrics / scan tables written as parquet by the executors."""
    df.write.mode(mode).parquet(path)


def run_catalog(spark: SparkSession, paths_by_family: dict[str, list[str]],
                score_cols=("CV_R2", "postcal_r2", "base_r2"), fmt: str = "csv") -> DataFrame:
    """Read many runs' metric files whose columns differ. One read per
    schema family, `unionByName(allowMissingColumns=True)`, one `score`
    column from the first present name, run folder from the file path."""
    frames = []
    for family, paths in paths_by_family.items():
        if not paths:
            continue
        d = (spark.read.option("header", True).option("inferSchema", True).format(fmt).load(paths)
             .withColumn("source_file", F.col("_metadata.file_path")).withColumn("family", F.lit(family)))
        frames.append(d)
    if not frames:
        raise ValueError("no metric files")
    out = frames[0]
    for d in frames[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    present = [c for c in score_cols if c in out.columns]
    return out.withColumn("score", F.coalesce(*[F.col(c).cast("double") for c in present]))
