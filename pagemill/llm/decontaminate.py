r"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are the maximal runs of letters and digits of the lower-cased text.  A mask picks some of the token positions
from a place on and ignores the others; the hash of what it picks is a seed.  Seeds of all training texts and of all
benchmark items are joined, and around each hit the item is laid over the text on the hit's diagonal: the text holds
the item if some ``window`` consecutive tokens of it (all, if it has fewer) differ from the text in at most
``window * SUBSTITUTED`` tokens, rounded down; of 11 or 12 tokens one may differ, of fewer none.

``MASKS`` hit every window within that bound (``tests/llm`` goes through all patterns), so the join loses no such
overlap.  Items under 7 tokens hold no seed and match nothing.

Defined cases: null and empty texts hold nothing; repeated rows and rows that share an id count as one id, which holds
what any of them holds; null ids form one group; items that share an id likewise; empty tables give an empty table;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.names import fresh, own
from pagemill.llm.scratch import Scratch

#: Positions that count, from the first; found by search over families of three with six positions each.
MASKS = ((0, 1, 3, 4, 5, 6), (0, 3, 6, 7, 8, 10), (0, 1, 2, 4, 9, 10))
WINDOW, SUBSTITUTED = 16, 3 / 16
#: Benchmarks of up to so many tokens are broadcast (24 bytes a seed, about 100 MB); larger ones are joined by shuffle.
BROADCAST_TOKENS = 1_000_000
#: Keys of documents that go are broadcast up to this number (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def allowed(wide: Column) -> Column:
    """How many tokens of a window may differ."""
    return F.when(wide < 11, 0).when(wide < 13, 1).otherwise(F.floor(wide * SUBSTITUTED))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def seeds(rows: DataFrame, place: str) -> DataFrame:
    """``rows(..., h)`` with token hashes h to one row per place and mask: ``seed`` (null if the mask runs over the end)."""
    placed = rows.where(F.size("h") >= 7).withColumn(place, F.explode(F.sequence(F.lit(0), F.size("h") - 7)))
    found = []
    for m, mask in enumerate(MASKS):
        picked = [F.get("h", F.col(place) + i) for i in mask]
        found.append(F.when(F.col(place) + (mask[-1] + 1) <= F.size("h"), F.xxhash64(F.lit(m), *picked)))
    return placed.withColumn("seed", F.explode(F.array(*found))).where("seed is not null")


def _verified(hits: DataFrame, window: int) -> DataFrame:
    """``hits(id, item, h, b, diagonal)``: aligned token hashes to the matched tokens of items that are held."""
    same = hits.withColumn("same", F.expr("transform(sequence(0, size(b) - 1), j -> if(get(h, j + diagonal) = b[j], 1, 0))"))
    wide = same.withColumn("wide", F.least(F.lit(window), F.size("b")))
    best = wide.withColumn("best", F.expr("array_max(transform(sequence(0, size(b) - wide), s -> aggregate(slice(same, s + 1, wide), 0, (a, x) -> a + x)))"))
    held = best.where(F.col("best") >= F.col("wide") - allowed(F.col("wide")))
    return held.select("id", "item", F.expr("aggregate(same, 0, (a, x) -> a + x)").cast("bigint").alias("matched"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """One row per document id and benchmark item that it holds: ``matched`` is the most tokens equal on one diagonal."""
    rows = docs.select(F.col(id_col).alias("id"), token_hashes(F.col(text_col)).alias("h"))
    items = benchmark.select(F.col(item_col).alias("item"), token_hashes(F.col(item_text)).alias("h"))
    known = seeds(items, "q").select("item", "q", "seed", F.col("h").alias("b"))
    total = items.agg(F.sum(F.size("h"))).first()[0] or 0
    if total <= broadcast_tokens:
        # the text's tokens stay in the row: hits are verified where they are found, only results are shuffled
        hits = seeds(rows, "p").join(F.broadcast(known.select("item", "q", "seed")), "seed")
        hits = hits.withColumn("diagonal", F.col("p") - F.col("q")).join(F.broadcast(items.select(F.col("item").alias("i"), F.col("h").alias("b"))), F.col("item").eqNullSafe(F.col("i"))).drop("i")
    else:
        found = seeds(rows, "p").select("id", "p", "seed").join(known.select("item", "q", "seed"), "seed")
        found = found.select("id", "item", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
        found = found.join(items.select(F.col("item").alias("i"), F.col("h").alias("b")), F.col("item").eqNullSafe(F.col("i"))).drop("i")
        hits = found.join(rows.select(F.col("id").alias("d"), "h"), F.col("id").eqNullSafe(F.col("d")))
    return _verified(hits, window).groupBy("id", "item").agg(F.max("matched").alias("matched")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; a row is judged by its own text, whatever its id."""
    (name,) = fresh(docs, "key")
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.col(text_col).isNull())
    held = overlaps(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text").select("key").distinct()
    held = Scratch(docs.sparkSession, "contaminated").write("held", held.withColumnRenamed("key", name))
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    return docs.withColumn(name, key).join(held, name, "left_anti").select(*own(docs))
