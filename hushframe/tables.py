"""Tables between the steps of a job: written to the shared folder, so a lost executor costs one step and no plan is run twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only where all run in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/hushframe/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes what a job wrote under the shared folder and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ran(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that its source holds now, as a table: folder/rows, with its state and progress in
    folder/checkpoint. Run again, it goes on where it stopped. For a table, run it with a folder under shared_dir."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
