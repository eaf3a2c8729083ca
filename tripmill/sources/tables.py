"""Reading tables, and the driver's event log as trip diaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import spread


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_survey_csv(spark: SparkSession, path: str, schema, rename: dict[str, str] | None = None) -> DataFrame:
    """Latin-1 CSV with a header; columns are renamed where they are present."""
    df = spark.read.schema(schema).option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return df.withColumnsRenamed({a: b for a, b in (rename or {}).items() if a in df.columns})


def diaries(events: DataFrame) -> DataFrame:
    """Events as trips: one person-day is a chain in the order of (ts, event_id)."""
    chain = Window.partitionBy("person", "day").orderBy("ts", "event_id")
    zone = F.get_json_object("props", "$.k").cast("long") % 5
    return (
        spread(events.withColumns({"person": F.col("user_id"), "day": F.to_date("ts")}), "person", "day").select(
            (F.col("user_id") % 40).alias("hh"), "person", "day", "ts", "event_id",
            (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("start"), F.col("event_type").alias("motive"),
            zone.alias("dest"), (F.col("user_id") % 5).alias("home"), F.floor("value").cast("long").alias("minutes"),
            (1 + F.col("user_id") % 7).alias("weight"),
        )
        .withColumn("trip", F.row_number().over(chain).cast("long"))
        .withColumn("origin", F.coalesce(F.lag("dest").over(chain), F.col("home")))
        .drop("ts")
    )
