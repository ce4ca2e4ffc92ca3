"""A vision model's verdicts on pictures: they can only make a class stricter, and their failure changes nothing.

Pictures are known by their content, so each is asked about once however many items show it."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..plans.vocabulary import IMAGE_CLASSES, MOST_VISION_BYTES, VISION
from .decide import stricter


def verdict_class(answer: Column) -> Column:
    """The class of a verdict {"category": .., "reason": ..}; null for anything else."""
    exact = F.array_sort(F.json_object_keys(answer)) == F.array(F.lit("category"), F.lit("reason"))
    known = F.create_map(*(F.lit(x) for pair in VISION.items() for x in pair))
    return F.when(exact, F.try_element_at(known, F.get_json_object(answer, "$.category")))


def asked(images: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(sha256, data) of pictures that have no verdict yet, each once; too large ones are never asked about."""
    new = images.filter(F.col("data").isNotNull() & (F.length("data") <= MOST_VISION_BYTES)).select(F.sha2("data", 256).alias("sha256"), "data")
    return new.join(verdicts.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"])


def tightened(images: DataFrame, verdicts: DataFrame) -> DataFrame:
    """images (.., data, image_class) with the stricter of the class and the verdict (sha256, answer) on the same content."""
    classes = verdicts.select(F.col("sha256").alias("_sha256"), verdict_class(F.col("answer")).alias("_verdict"))
    classes = classes.groupBy("_sha256").agg(F.max(F.struct(F.array_position(F.array(*(F.lit(c) for c in IMAGE_CLASSES)), F.col("_verdict")), F.col("_verdict"))).getField("_verdict").alias("_verdict"))
    joined = images.withColumn("_sha256", F.sha2("data", 256)).join(classes, "_sha256", "left")
    verdict = F.when(F.length("data") <= MOST_VISION_BYTES, F.col("_verdict"))
    return joined.withColumn("image_class", F.when(F.col("image_class").isNotNull(), stricter(F.col("image_class"), F.coalesce(verdict, F.col("image_class")), IMAGE_CLASSES))).drop("_sha256", "_verdict")
