"""p2: defective references and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.language import train
from loomery.llm.replies import defects
from loomery.plans.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "eval_cases").select(F.col("id").alias("case_id"), "question", "reference").distinct()
    trials = table(spark, folder, "trial_results").select("case_id", F.col("trial").cast("int").alias("trial"), F.col("answer").alias("text"))
    given = cases.where("reference IS NOT NULL").select("case_id", F.lit(0).alias("trial"), "question", F.col("reference").alias("text"))
    answered = trials.join(cases.select("case_id", "question"), "case_id", "left").select("case_id", "trial", "question", "text")
    model = train(table(spark, folder, "lang_samples").select("lang", "sample_text"), table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return defects(given.unionByName(answered), ["case_id", "trial"], "question", "text", model)


QUERIES = {"p2_found": p2_found}
ORACLE: dict[str, str] = {}
