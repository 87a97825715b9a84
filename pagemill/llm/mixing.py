r"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source i with the share p of all tokens (words ``[^\x20\x09-\x0D]+``) gets a weight in proportion to p ** a.  The
exponent a is a multiple of 2 ** -20 found by bisection (each round cuts the interval into 32): the least a at which no
source repeats more than ``most_repeats`` times, or the largest a whose weights have at least ``least_entropy`` nats.
A source's weight times the budget is its token budget: as many whole passes over its documents as fit, and of one more
pass the longest prefix that fits.  The order of a pass is a block permutation: documents are hashed into blocks of
about ``block_tokens`` tokens, blocks are ordered by a keyed hash, documents within a block by another.  Running totals
go over blocks, and over the documents of the one block in which a source's last pass ends; every other document is
taken or left by its hash, so no source has to lie in one task and no text is moved.  A target that can't be met (more
entropy than there are sources for, a budget that needs more repetitions) raises ``Infeasible``.

Without a budget, the budget is the least that gives every document one whole pass: weights are met, nothing is lost.

Defined cases: null sources are one source; null and empty texts have no tokens; a source without tokens has no weight
and its documents stay once; ties in an order go by text, rows equal in id and text are taken together; an empty
table gives an empty table; other columns travel along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.names import fresh, own, quoted
from pagemill.llm.scratch import Scratch

STEPS, CUTS, ROUNDS = 1 << 20, 32, 4
#: Documents are counted in so many buckets a source; blocks are runs of buckets.
BUCKETS = 1 << 16
#: The plan (under 200 bytes a source) is broadcast up to so many sources; beyond, sources are joined over so many salts.
BROADCAST_SOURCES, SALTS = 100_000, 32


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))), F.lit(0)).cast("bigint")


def bucket(id_col: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 4), 16, 10).cast("int")


class Infeasible(ValueError):
    """No exponent meets the stated limits."""


def _table(shares: DataFrame, low: int, high: int, step: int) -> list[tuple]:
    """Per exponent k: the sum of p ** a, its entropy in nats, the most and the least p ** (a - 1).  33 rows reach the driver."""
    a = F.col("k") / F.lit(STEPS)
    told = shares.select("p", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))).alias("k")).groupBy("k").agg(
        F.sum(F.pow("p", a)).alias("z"),
        F.sum(F.pow("p", a) * F.log("p")).alias("s"),
        F.max(F.pow("p", a - 1)).alias("most"),
        F.min(F.pow("p", a - 1)).alias("least"),
    )
    return sorted((k, z, math.log(z) - k / STEPS * s / z, most, least) for k, z, s, most, least in told.collect())


def exponent(shares: DataFrame, most_repeats: float | None, least_entropy: float | None, budget_ratio: float | None) -> int:
    """The exponent in steps of 2 ** -20, from ``shares(p)`` of the sources.

    With a least entropy the largest exponent that has it, else the least one that keeps the repetitions.  Both limits
    hold in the end, or ``Infeasible`` says which can't.
    """

    def repeats(z: float, most: float, least: float) -> float:
        # with no budget the least repeated source is passed once
        return most / least if budget_ratio is None else budget_ratio * most / z

    low, high = 0, STEPS
    for _ in range(ROUNDS):
        step = (high - low) // CUTS
        rows = _table(shares, low, high, step)
        if least_entropy is None:
            fits = [k for k, z, _, most, least in rows if most_repeats is None or repeats(z, most, least) <= most_repeats]
            high = min(fits, default=high)
            low = max(low, high - step)
        else:
            fits = [k for k, _, entropy, _, _ in rows if entropy >= least_entropy]
            low = max(fits, default=low)
            high = min(high, low + step)
    found = high if least_entropy is None else low
    ((_, z, entropy, most, least),) = _table(shares, found, found, 1)
    if least_entropy is not None and entropy < least_entropy - 1e-9:
        raise Infeasible(f"these sources have {entropy:.6f} nats at most, {least_entropy} are asked")
    if most_repeats is not None and repeats(z, most, least) > most_repeats * (1 + 1e-9):
        raise Infeasible(f"a source would repeat {repeats(z, most, least):.6f} times, {most_repeats} are allowed")
    return found


def _places(source: Column, block: Column, seed: int) -> Column:
    """Where a block comes in its source's permutation: a struct that orders blocks."""
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:block:"), F.coalesce(source, F.lit("")), F.lit(":"), block.cast("string"))).alias("h"), block.alias("b"))


def plan(docs: DataFrame, scratch: Scratch, most_repeats: float | None, least_entropy: float | None, budget: int | str | None, block_tokens: int, seed: int) -> DataFrame:
    """``docs(source, id, text)`` to one row per source with tokens: ``passes``, ``shift`` and where its last pass ends.

    The last pass holds all blocks before ``cut`` whole, and of the block ``cut`` the documents up to ``last``.
    """
    rows = docs.select("source", bucket(F.col("id"), seed).alias("bucket"), n_tokens(F.col("text")).alias("n"))
    counted = scratch.write("buckets", rows.groupBy("source", "bucket").agg(F.sum("n").alias("t")))
    sums = counted.groupBy("source").agg(F.sum("t").alias("t")).where("t > 0")
    total = sums.agg(F.sum("t")).first()[0] or 0
    shares = scratch.write("shares", sums.select("source", "t", (F.col("t") / F.lit(total or 1)).alias("p")))
    tokens = total if budget == "total" else budget
    a = (exponent(shares, most_repeats, least_entropy, None if tokens is None else tokens / total) if total else 0) / STEPS
    z, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1)))).first()
    if tokens is None and total:
        # w * budget / t is then 1 for the source that repeats least
        tokens = total * z / least
    own_tokens = F.floor(F.pow("p", F.lit(a)) / F.lit(z or 1.0) * F.lit(float(tokens or 0)) + 1e-6)
    if budget is None:
        # rounding must not take the one whole pass that every source has
        own_tokens = F.greatest(own_tokens, F.col("t"))
    # 2 ** shift buckets make a block
    shift = F.greatest(F.lit(0), F.lit(16) - F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("t") / F.lit(block_tokens))))).cast("int")
    known = shares.select("source", "t", own_tokens.alias("own")).select("source", F.floor(F.col("own") / F.col("t")).alias("passes"), (F.col("own") % F.col("t")).alias("rest"), shift.alias("shift"))
    # every bucket's block first, so that all joins are equalities and none pairs a source's buckets with its blocks
    blocks = counted.alias("c").join(known.alias("k"), F.expr("c.source <=> k.source")).select("k.*", F.expr("shiftright(c.bucket, k.shift)").alias("block"), "c.t")
    blocks = blocks.groupBy("source", "passes", "rest", "shift", "block").agg(F.sum("t").alias("t")).withColumn("place", _places(F.col("source"), F.col("block"), seed))
    over = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumn("before", F.sum("t").over(over) - F.col("t"))
    # the first block that doesn't fit whole; the rest is less than a pass, so there is one
    cut = placed.where(F.col("before") + F.col("t") > F.col("rest")).groupBy("source", "passes", "rest", "shift").agg(F.min(F.struct("place", "before")).alias("x"))
    cut = scratch.write("cut", cut.select("source", "passes", "rest", "shift", F.col("x.place").alias("cut"), F.col("x.before").alias("before")))
    inside = docs.select("source", "id", "text", bucket(F.col("id"), seed).alias("bucket")).alias("d").join(cut.alias("k"), F.expr("d.source <=> k.source and k.rest > 0 and shiftright(d.bucket, k.shift) = k.cut.b"))
    inside = inside.select("k.source", "k.rest", "k.before", _document(F.col("d.id"), F.col("d.text"), seed).alias("doc"), n_tokens(F.col("d.text")).alias("n"))
    # rows equal in id and text are taken together
    within = Window.partitionBy("source").orderBy("doc").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("upto", F.col("before") + F.sum("n").over(within)).where("upto <= rest")
    last = taken.groupBy("source").agg(F.max("doc").alias("last"))
    ends = cut.alias("k").join(last.alias("l"), F.expr("k.source <=> l.source"), "left").select("k.source", "k.passes", "k.shift", F.when(F.col("k.rest") > 0, F.col("k.cut")).alias("cut"), "l.last")
    ends = scratch.write("plan", ends)
    scratch.drop("buckets", "shares", "cut")
    return ends


def _document(id_col: Column, text: Column, seed: int) -> Column:
    """Where a document comes in its block: a struct that orders documents."""
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:document:"), F.coalesce(id_col.cast("string"), F.lit("")))).alias("h"), F.xxhash64(text).alias("t"))


def _copies(docs: DataFrame, name: str, ends: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The documents with their number of copies in the column ``name``; texts stay where they are if the plan is broadcast."""
    many, side = ends.count(), fresh(docs, "plan", "salt")
    inner = F.struct("source", "passes", "shift", "cut", "last")
    if many <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(ends.select(inner.alias(side[0]))), F.col(source_col).eqNullSafe(F.col(f"{side[0]}.source")), "left")
    else:
        # a source may hold a third of all rows: its rows are dealt over salts, and so is its row of the plan
        salted = ends.select(inner.alias(side[0]), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(side[1]))
        told = docs.withColumn(side[1], F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SALTS)).cast("int"))
        joined = told.alias("d").join(salted.alias("s"), F.col(source_col).eqNullSafe(F.col(f"{side[0]}.source")) & (F.col(f"d.{side[1]}") == F.col(f"s.{side[1]}")), "left")
    known = F.col(side[0])
    block = F.call_function("shiftright", bucket(F.col(id_col), seed), known["shift"])
    place = _places(F.col(source_col), block, seed)
    more = (place < known["cut"]) | (place == known["cut"]) & (_document(F.col(id_col), F.col(text_col), seed) <= known["last"])
    copies = F.coalesce(known["passes"] + F.when(known["cut"].isNotNull() & more, 1).otherwise(0), F.lit(1)).cast("bigint")
    return joined.select(*[F.col(quoted(c)) if many <= BROADCAST_SOURCES else F.col("d." + quoted(c)) for c in docs.columns], copies.alias(name))


def mix(
    docs: DataFrame,
    most_repeats: float | None = 2.0,
    least_entropy: float | None = None,
    budget: int | str | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """All documents with ``n_tokens`` and ``copies`` (0 for those that a budget leaves out).

    ``budget``: tokens, "total" for as many as there are, or None (see above).  Columns of the input that have these
    two names are left out.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("n_tokens", "copies")])
    counted = kept.withColumn("n_tokens", n_tokens(F.col(text_col)))
    ends = plan(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), Scratch(docs.sparkSession, "mixing"), most_repeats, least_entropy, budget, block_tokens, seed)
    return _copies(counted, "copies", ends, seed, id_col, text_col, source_col)


def realise(docs: DataFrame, most_repeats: float | None = 2.0, least_entropy: float | None = None, budget: int | str | None = None, block_tokens: int = 1 << 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as often as the mix has it, with all their columns."""
    ends = plan(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), Scratch(docs.sparkSession, "mixing"), most_repeats, least_entropy, budget, block_tokens, seed)
    name, copy = fresh(docs, "times", "copy")
    often = _copies(docs, name, ends, seed, id_col, text_col, source_col).where(F.col(name) > 0)
    return often.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name).cast("int")))).select(*own(docs))
