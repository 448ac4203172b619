"""Held-out figures of the trained operators: ``python -m arbora.llm.measure FOLDER`` prints one JSON line.

Of the rows that no operator may learn from: the share of right languages (7), of right qualities (8), and of verdicts of the
quality rules' trees (4) that agree with the label, documents that the base rules fail left out.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import language, quality, rules


def _share(t: DataFrame, right) -> dict:
    r = t.agg(F.count("*").alias("rows"), F.avg(right.cast("double")).alias("right")).first()
    return {"rows": r["rows"], "right": None if r["right"] is None else round(r["right"], 4)}


def figures(spark: SparkSession, sf_dir: str) -> dict[str, dict]:
    docs = C.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    lang = language.op7_language(spark, sf_dir).filter("held_out").join(docs.select("doc_id", "lang").filter("lang IS NOT NULL"), "doc_id")
    good = quality.op8_quality(spark, sf_dir).filter("held_out").join(labels, "doc_id")
    kept = rules.op4_quality_rules(spark, sf_dir).filter(~F.col("base_failed") & (C.crc_fold("doc_id", 4) == 2)).join(labels, "doc_id")
    return {
        "op4_quality_rules": _share(kept, F.col("kept") == (F.col("quality") == 1)),
        "op7_language": _share(lang, F.col("lang_pred") == F.col("lang")),
        "op8_quality": _share(good, F.col("predicted") == F.col("quality")),
    }


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    print(json.dumps(figures(session, sys.argv[1])))
