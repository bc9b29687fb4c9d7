"""Tables between the stages: Parquet as the record, JSON lines for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCK_SCHEMA = (
    "block_id string, source_file string, source_path string, doc_type string, block_type string, `order` int, text string, section_path array<string>, page_number int, slide_number int, shape_index int, "
    "sheet_name string, row_number int, metadata_json string, ingested_at timestamp"
)


def write_stage(df: DataFrame, path: str, by: str | None = None, format: str = "parquet") -> None:
    """Writes a stage, partitioned by a column (such as doc_type) if one is given. JSON keeps null fields."""
    if format not in ("parquet", "json"):
        raise ValueError(f"no such format here: {format}")
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(by) if by else w).format(format).save(path)


def read_stage(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """Reads a stage; JSON is read with its schema, and a broken line is an error."""
    r = spark.read.format(format)
    if format == "json":
        r = r.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).load(path)
