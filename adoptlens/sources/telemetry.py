"""Event files in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.events import parse_events, split_valid, validate_events


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Validated events of JSON-lines files. Files must be complete: a writer adds a
    file by rename, so a half-written last line is never listed."""
    return validate_events(parse_events(spark.read.text(path)))


def read_event_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    lines = (
        spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(path)
    )
    return validate_events(parse_events(lines))


def accepted_and_rejected(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_valid(events)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Distributed CSV or JSON export; nested columns become JSON text in CSV, where a quote
    is doubled."""
    from pyspark.sql import functions as F

    if fmt == "json":
        df.write.mode("overwrite").json(path)
        return
    flat = df.select(
        *[
            F.to_json(f.name).alias(f.name)
            if f.dataType.typeName() in ("array", "struct", "map")
            else F.col(f.name)
            for f in df.schema
        ]
    )
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_views(views: dict[str, DataFrame], root: str) -> None:
    for name, df in views.items():
        export(df, f"{root}/{name}.csv", "csv")
        export(df, f"{root}/{name}.json", "json")
