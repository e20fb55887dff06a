"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within a source, documents are dealt by
ranges of that key into buckets, sorted inside each bucket, and numbered by
prefix sums of their sizes: sums of whole buckets first, then a running sum
inside each bucket. A source's budget is then a cut through that order. A source
of any size is spread over `buckets` tasks; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.llm.store import free, keyed, settled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Passes over a source, at most.
EPOCHS = 3
#: Ranges of the random key within a source; 2**12 keep a source of 10**10 documents at some 2.4 million a task.
BUCKET_BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources by code point, null last, weigh `weights`, repeating. The share of all
    sizes is dealt by weight; what exceeds `epochs` times a source's size is dealt
    again among the others. So target = min(epochs * size, level * weight), and the
    level follows from prefix sums over the sources in order of size by weight.
    The table has one row per source, not per document.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.select("source", "source_size", weight.alias("weight"))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = F.lit(epochs) * F.col("source_size")
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = ranked.select("source", "source_size", "weight", cap.alias("cap"), (left / free).alias("level"), F.row_number().over(filling).alias("position"))
    # the level at the first source, in this order, that does not exceed its cap; those before it are full
    stays = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("position"))
    level = F.min_by("level", stays).over(everything)
    return filled.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = 20,
    bucket_bits: int = BUCKET_BITS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """What a mix takes of each document.

    docs: any table with an id, a text and a source; other columns are ignored.
    Result: one row per row of docs: doc_id, source, size, source_size, target,
    taken, key (the random key). `taken` counts words, repeats included: whole passes over the source,
    then the documents in random order up to the budget, the last one in part. A
    null text has size 0; a null source is a source of its own, the last one. Rows
    that are alike in id, source and text are taken one after the other. Empty
    tables give no rows; all texts empty give targets of 0. Reruns agree, on any
    partitioning, since keys depend on seed, id and text alone. Columns named in
    `carry` go along; they order rows that are otherwise alike.
    """
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("source_key"),
        n_words(F.col(text)).alias("size"),
        key.alias("key"),
        F.shiftrightunsigned(key, 64 - bucket_bits).alias("bucket"),
        *carry,
    )
    rows = settled(narrow, "mixing")  # the texts are read once
    name = F.when(F.col("source_key") != "", F.expr("substr(source_key, 2)")).alias("source")
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source_key").orderBy("bucket")
    whole = targets(sums.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size")).select(name, "source_size"), weights, epochs)
    whole = whole.select("source_size", "target", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"))
    buckets = sums.select("source_key", "bucket", (F.sum("bucket_size").over(ahead) - F.col("bucket_size")).alias("ahead")).join(whole, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", *carry).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = rows.join(buckets, ["source_key", "bucket"]).select("doc_id", "key", name, "size", "source_size", "target", start.alias("start"), *carry)
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).alias("taken"), "key", *carry)


def mixed(docs: DataFrame, seed: int = 20, **options: object) -> DataFrame:
    """The documents of the mix: whole ones once per pass, a cut one by its first words.

    Returns the columns of docs. A document that is not taken goes. The words of a
    cut text are joined by single spaces. docs: doc_id, text, source, any of them null;
    each row has takes of its own, also among rows that are alike.
    """
    row, size_of, taken_of, cut_of = (free(docs, n) for n in ("_row", "_size", "_taken", "_cut"))
    rows = keyed(docs, name=row)
    taken = mix(rows, seed=seed, carry=(row,), **options).filter(F.col("taken") > 0).select(row, F.col("size").alias(size_of), F.col("taken").alias(taken_of))
    size, took, cut_at = F.col(size_of), F.col(taken_of), F.col(cut_of)
    whole = F.when(size > 0, F.floor(took / size)).otherwise(F.lit(0)).cast("int")
    cut = (took - whole * size).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")))
    rows = rows.join(taken, row).withColumn(cut_of, F.explode(copies))
    text = F.when(cut_at == 0, F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(cut_at, F.lit(1))), " "))
    return rows.withColumn("text", text).select(*docs.columns)
