"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardsift.llm.common import held_out, staged

#: Labelled rows a classifier is fitted on at most, by label, and characters of them: rows are taken, however long, in
#: the order of their hash until either is reached.  A single text of more characters cannot be held and is passed over.
MAX_ROWS = 2500
MAX_CHARS = 20_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[DataFrame, float]:
    """doc_id, text, label of at most ``max_rows`` documents of each label: those with the smallest hash of their id.
    And what a logit learned from them must be shifted by: log odds of the labels of all labelled documents less those
    of the sample, as the larger class is cut more (0 without documents of both labels).

    Only labels of rows that aren't held out are read; null labels and ids are skipped, and an id with several labels
    has the largest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = staged(known.join(texts.select("doc_id"), "doc_id", "left_semi"), "known")
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("label") == value).orderBy(order).limit(max_rows) for value in (0, 1)]
    chosen = staged(chosen[0].unionByName(chosen[1]), "sample")  # at most 2 * max_rows ids
    found = texts.join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    found = staged(found.withColumn("upto", upto).where(F.col("upto") <= max_chars).drop("upto"), "sampled")
    counts = [{r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} for rows in (known, found)]
    shift = _log_odds(counts[0]) - _log_odds(counts[1]) if len(counts[1]) == 2 else 0.0
    return found, shift


def _log_odds(count: dict[int, int]) -> float:
    return float(np.log(count[1] / count[0]))
