"""Evaluation cases and saved states as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a case and what they are where a file leaves them out.
SCHEMA = "pdf string, query string, expected array<string>, label string, top_k bigint, type string, difficulty string, tags array<string>, notes string, must_not_contain array<string>"
NEGATIVE = ("negative", "adversarial")


def case_label(pdf: Column, query: Column) -> Column:
    """The name of the file without folder and extension, and the first 30 signs of the question."""
    stem = F.regexp_replace(F.regexp_extract(pdf, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit(": "), F.substring(query, 1, 30))


def with_defaults(cases: DataFrame) -> DataFrame:
    """Cases with every field filled, and whether they are negative: of such a type, with nothing expected."""
    none = F.array().cast("array<string>")
    return cases.where("pdf is not null and query is not null").select(
        "pdf", "query", F.coalesce("expected", none).alias("expected"), F.coalesce("label", case_label(F.col("pdf"), F.col("query"))).alias("label"), F.coalesce("top_k", F.lit(6)).alias("top_k"),
        F.coalesce("type", F.lit("standard")).alias("type"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"), F.coalesce("tags", none).alias("tags"), F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("must_not_contain", none).alias("must_not_contain"), (F.coalesce("type", F.lit("standard")).isin(*NEGATIVE) & (F.size(F.coalesce("expected", none)) == 0)).alias("negative"),
    )


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON files, each an array of cases or a case a line."""
    return with_defaults(spark.read.schema(SCHEMA).option("multiLine", "true").json(path))


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    """Tables of a state as JSON lines, each in its own folder."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a saved state by name; one that was not saved is empty."""
    out = {}
    for name, schema in schemas.items():
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        out[name] = spark.read.schema(schema).json(f"{path}/{name}") if there else spark.createDataFrame([], schema)
    return out
