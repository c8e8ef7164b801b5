"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserix.runtime import checked_side

#: A text counts with at most this part of its label's share of characters, so that no text is a label's whole sample.
PART = 16
#: Rows of all labels together that may come to the driver, and labels that are told apart.
MOST_ROWS, MOST_LABELS = 200_000, 5_000


def hash_rank(seed: str):
    return F.xxhash64(F.col("doc_id"), F.lit(seed))


def sampled_texts(docs: DataFrame, labels: DataFrame, per_label: int, seed: str, most_chars: int = 24_000_000, carry: tuple[str, ...] = ()) -> list[tuple]:
    """(text, label, and the columns of docs in carry) of at most per_label documents for each label value: those with the smallest hash of doc_id, so the same ones on
    every run. Every value that occurs is sampled; more than MOST_LABELS of them are refused, and all together give at most MOST_ROWS rows.

    labels: (doc_id, label as string), either a table of its own or a selection of docs. Where docs have a column label, it must agree: a text then has the
    label of its own row, also where a doc_id repeats. A (doc_id, label) that several rows have gives its first text. Null labels are left out.

    most_chars bounds what comes to the driver; it is shared out evenly over the values, and lengths are summed before any text is collected:
    a value's documents are taken in hash order while their sum stays within its share. Of a text longer than a PART-th of a share, that many
    characters are taken, at a place given by the hash, so at least PART texts of a value fit, however long they are."""
    order = Window.partitionBy("label").orderBy("h", "doc_id")
    ids = labels.filter("label is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "label").withColumn("h", hash_rank(seed))
    # hashes below twice the share that is asked for: some 2 x per_label rows of a value are ranked in one task, whatever the table
    sizes = checked_side(ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "sample-sizes")
    values = sizes.count()
    if not values:
        return []
    if values > MOST_LABELS:
        raise ValueError(f"{values} label values; a classifier here tells at most {MOST_LABELS} apart")
    per_label, share = max(1, min(per_label, MOST_ROWS // values)), max(1, most_chars // values)
    ids = ids.join(sizes, "label").filter(F.col("h") / 2.0**64 + 0.5 <= 2.0 * (per_label + 20) / F.col("n")).select("doc_id", "label", "h").distinct()
    ids = checked_side(ids.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_label).drop("k"), "sample-ids")
    own = "label" in docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([F.col("label").cast("string").alias("label")] if own else []), *carry)
    rows = rows.join(ids, ["doc_id", "label"] if own else "doc_id").groupBy("doc_id", "label", "h").agg(F.min(F.struct("text", *carry)).alias("row")).select("doc_id", "label", "h", "row.*")
    most = max(1, share // PART)
    long = F.length("text") - most
    rows = rows.withColumn("text", F.when(long > 0, F.substr("text", (F.pmod("h", F.greatest(long, F.lit(1))) + 1).cast("int"), F.lit(most))).otherwise(F.col("text")))
    rows = rows.withColumn("sum", F.sum(F.length("text")).over(order)).filter(F.col("sum") <= share)
    return [(r["text"], r["label"], *(r[c] for c in carry)) for r in rows.select("h", "doc_id", "text", "label", *carry).orderBy("h", "doc_id", "label").collect()]
