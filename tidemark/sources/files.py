"""File sources and sinks: run listings, grouped archive members, GeoJSON, bundles and tiles."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed schema of a run's metadata.
META = "id string, name string, bbox array<double>, date string, created string, seconds double, model string"


def saved_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that have readable metadata, newest first by file time."""
    meta = spark.read.schema(META).option("mode", "PERMISSIVE").option("multiLine", "true").json(f"{folder}/*/meta.json")
    timed = meta.select("*", F.col("_metadata.file_modification_time").alias("modified"))
    return timed.where("id is not null").orderBy(F.desc("modified"), "id")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """path, sample, field and content of the files in tar archives, streamed one archive a task.

    A member ``key.field`` belongs to sample ``key``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile():
                            sample, _, field = member.name.partition(".")
                            data = tar.extractfile(member).read()
                            yield pa.record_batch({"path": [at], "sample": [sample], "field": [field], "content": pa.array([data], pa.binary())})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sample string, field string, content binary")


def complete_samples(members: DataFrame, fields: list[str]) -> DataFrame:
    """path, sample and a map of contents by field; samples that lack one of ``fields`` are dropped."""
    grouped = members.groupBy("path", "sample").agg(F.map_from_entries(F.collect_list(F.struct("field", "content"))).alias("data"))
    return grouped.where(F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), F.map_keys("data"))) == 0)


def geojson_features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def write_bundle(layers: dict[str, DataFrame], folder: str, most_rows: int = 1_000_000) -> None:
    """Every layer of a run as Parquet of its own, files of bounded size."""
    for name, df in layers.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", most_rows).parquet(f"{folder}/{name}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark writes to; it replaces one of that name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_geojson_lines(df: DataFrame, geometry: Column, properties: list[str], path: str) -> None:
    geojson_features(df, geometry, properties).write.mode("overwrite").text(path)


def read_cut(spark: SparkSession, path: str, box: tuple[float, float, float, float], step: float = 0.25) -> DataFrame:
    """A box of a table partitioned by ``cell_x`` and ``cell_y`` (floor of lon and lat by ``step``): cells are pruned, the rest filtered."""
    import math

    xs, ys = (math.floor(box[0] / step), math.floor(box[2] / step)), (math.floor(box[1] / step), math.floor(box[3] / step))
    cells = F.col("cell_x").between(*xs) & F.col("cell_y").between(*ys)
    return spark.read.parquet(path).where(cells & F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def write_cut(df: DataFrame, path: str, step: float = 0.25) -> None:
    cells = df.withColumn("cell_x", F.floor(F.col("lon") / step).cast("int")).withColumn("cell_y", F.floor(F.col("lat") / step).cast("int"))
    cells.write.mode("overwrite").partitionBy("cell_x", "cell_y").parquet(path)
