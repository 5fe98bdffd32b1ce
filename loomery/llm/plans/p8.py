"""p8: languages of documents and their stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.language import detect, label_language, train
from loomery.plans.tables import table


def _detected(spark: SparkSession, folder: str, segments: bool = True) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = train(table(spark, folder, "lang_samples").select("lang", "sample_text"), docs)
    return detect(docs, "text", model, segments).drop("text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _detected(spark, folder, segments=False).select("doc_id", label_language(F.col("lang")).alias("label"), "main", "mixed")
    main = F.when(F.col("main").isNull(), None).when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("main"), "wrong")
    cases = F.concat(F.array(F.struct(main.alias("kind"), F.col("main").alias("lang"))), F.transform("mixed", lambda x: F.struct(F.lit("mixed").alias("kind"), x.alias("lang"))))
    return found.select("doc_id", F.inline(cases)).where("kind IS NOT NULL").distinct()


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _detected(spark, folder).select("doc_id", F.col("main").alias("main_lang"), F.col("confidence").alias("main_confidence"), F.inline("segments"))


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments}
ORACLE: dict[str, str] = {}
