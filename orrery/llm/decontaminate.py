"""Benchmark decontamination, in DataFrame operations only.

A prefix-filtered join of documents with the windows of benchmark items. Words are
ordered by rarity over all documents. A window occurs only where its rarest word
does, so that word alone is its prefix: documents meet windows on it, the window's
place follows from the word's place in both (positional bound), must lie inside
the document (length bound), and is then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.store import discard, keyed, settled

#: What parts words: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window; an item of fewer is one window.
WIDTH = 10
#: Bytes of window tables that may be sent to every executor; beyond it they are joined by shuffles.
BROADCAST_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a text of ASCII alone has no other letters to leave as they are."""
    known = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(known) == F.length(known), F.lower(known)).otherwise(F.translate(known, _UPPER, _LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows: words, their number, and the ids (as strings) of their items."""
    split = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_words") - width + 1, F.lit(1))))
    each = split.select("item", "_words", at.alias("_at")).select("item", F.slice("_words", F.col("_at"), width).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("length", F.size("window"))


def _small(df: DataFrame, size: Column, limit: int) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def prefixes(spans: DataFrame, docs: DataFrame, text: str, limit: int) -> DataFrame:
    """spans with the rarest word of each window, and how far into the window it stands."""
    vocabulary = spans.select(F.explode("window").alias("word")).distinct()
    if _small(vocabulary, F.octet_length("word") + 64, limit):
        vocabulary = F.broadcast(vocabulary)
    counts = docs.select(F.explode(words(F.col(text))).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    place = spans.select("window", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset"))
    return place.groupBy("window").agg(rarest.alias("rarest")).join(spans, "window").select(F.col("rarest.word").alias("token"), F.col("rarest.offset").alias("offset"), "window", "length", "items")


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES, row: str | None = None) -> DataFrame:
    """One row per occurrence of a window, and one more per row of docs.

    Columns: doc_id, row (tells apart rows of one id), n_words, start, length,
    items; the last three are null in the extra rows. row: a long column of docs that tells
    its rows apart and is the same at each read, if there is one.
    """
    table = settled(prefixes(windows(items, item_id, item_text, width), docs, text, broadcast_bytes), "prefixes")
    own = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    rows = docs.select(*own, F.col(row).alias("row")) if row else keyed(docs, *own, name="row")
    rows = rows.select("doc_id", "row", words(F.col("text")).alias("words"))
    spread = rows.select("doc_id", "row", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    size = sum((F.octet_length(F.array_join(c, " ")) * 2 + 64 for c in ("window", "items")), F.octet_length("token"))
    start = (F.col("pos") - F.col("offset")).alias("start")
    inside = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("length") <= F.col("n_words"))
    base = F.coalesce(F.col("pos"), F.lit(0)) == 0
    if _small(table, size, broadcast_bytes):
        joined = spread.join(F.broadcast(table), F.col("word") == F.col("token"), "left")
        same = F.coalesce(inside & (F.slice("words", F.greatest(F.col("pos") - F.col("offset"), F.lit(0)) + 1, F.col("length")) == F.col("window")), F.lit(False))
        kept = joined.filter(base | same)
        return kept.select("doc_id", "row", "n_words", *(F.when(same, c).alias(n) for c, n in ((start, "start"), (F.col("length"), "length"), (F.col("items"), "items"))))
    # the words around each word go along, so that the comparison needs no second join
    low = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    near = spread.filter(F.col("pos").isNotNull()).select("doc_id", "row", "n_words", "pos", "word", low.alias("low"), F.slice("words", low + 1, 2 * width - 1).alias("near"))
    met = near.join(table.hint("merge"), F.col("word") == F.col("token")).filter(inside)
    met = met.filter(F.slice("near", F.col("pos") - F.col("offset") - F.col("low") + 1, F.col("length")) == F.col("window"))
    blank = [F.lit(None).cast(t).alias(n) for t, n in (("int", "start"), ("int", "length"), ("array<string>", "items"))]
    return spread.filter(base).select("doc_id", "row", "n_words", *blank).unionByName(met.select("doc_id", "row", "n_words", start, "length", "items"))


def decontaminate(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """How much of each document is benchmark text.

    docs needs an id and a text, items an id and a text; other columns are ignored.
    Result: one row per row of docs: doc_id, n_words, n_hit (words inside an
    occurrence of a window), n_items, item_ids (sorted as strings), contaminated. A
    null or empty text has no words; a long one is read whole. Items without words match nothing; items that
    repeat one id count once. An empty docs gives no rows; without items nothing
    is hit. Occurrences may overlap; each word counts once.
    """
    found = hits(docs, items, **options)
    span = F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end")))
    grouped = found.groupBy("doc_id", "row").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def grow(done: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], done["upto"]))
        return F.struct((done["n"] + fresh).alias("n"), F.greatest(done["upto"], span["end"]).alias("upto"))

    n_hit = F.aggregate("spans", zero, grow, lambda done: done["n"]).cast("long")
    return grouped.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids").withColumn("contaminated", F.col("n_hit") > 0)
