"""Bounded samples of labelled documents, and their sparse terms, for the models trained here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import bound_batches, materialise, release_memory

#: Remainder of crc32(id as text) modulo FOLDS whose rows are never learnt from.
FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str):
    """Whether a row belongs to the fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, rows: int, per_class: bool, seed: int = 0
) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled documents outside the held-out fold.

    Ids are taken in the order of a seeded hash, so reruns agree; with ``per_class`` each label gets
    an equal share. Ids labelled twice or null, and null labels, are left out. Of documents that share
    an id one counts, the one with the greatest text, so the bound holds. The sample is written to the
    shared folder: documents are scanned for it once.
    """
    bound_batches(docs.sparkSession)
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.max(label_col).cast("int").alias("label"))
        .where("n = 1")
        .withColumn("rank", F.xxhash64(F.lit(seed), "doc_id"))
    )
    if per_class:
        parts = [usable.where(F.col("label") == k).orderBy("rank", "doc_id").limit(rows // 2) for k in (0, 1)]
        usable = parts[0].unionByName(parts[1])
    else:
        usable = usable.orderBy("rank", "doc_id").limit(rows)
    # the sample is bounded by ``rows``, so it can be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(usable.select("doc_id", "label")), "doc_id")
    return materialise(found.groupBy("doc_id", "label").agg(F.max("text").alias("text")), "sample")


def term_counts(sample: DataFrame, terms: Callable[[str | None], dict[str, int]]) -> DataFrame:
    """term, and the number of sampled documents of label 0 and of others that hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch["text"], batch["label"]):
                for term in terms(text):
                    counts.setdefault(term, [0, 0])[label > 0] += 1
            yield pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["term", "n0", "n1"])
        release_memory()

    parts = sample.select("text", "label").mapInPandas(run, "term string, n0 long, n1 long")
    return parts.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def term_rows(
    sample: DataFrame, terms: Callable[[str | None], dict[str, int]], vocabulary: dict[str, int]
) -> pd.DataFrame:
    """doc_id, label, and the vocabulary numbers and counts of each sampled document's terms.

    The result is bounded by the sample's rows times the vocabulary.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, counts = [], []
            for text in batch["text"]:
                found = {vocabulary[t]: n for t, n in terms(text).items() if t in vocabulary}
                numbers.append(list(found))
                counts.append(list(found.values()))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "label": batch["label"], "numbers": numbers, "counts": counts}
            )
        release_memory()

    rows = sample.mapInPandas(run, "doc_id long, label int, numbers array<int>, counts array<int>")
    return rows.toPandas().sort_values("doc_id", ignore_index=True)
