"""One gloss per term, at its first use in document order.

Where a term stands in a record doesn't depend on other records, so records are scanned in parallel; a window finds
the first use of each term on a page, and the texts are rebuilt.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.functions import glossary as G

SCANNED = "uses array<struct<term:string,place:int>>, removed array<struct<start:int,stop:int>>"


@lru_cache(256)
def _compiled(items: tuple[tuple[str, str], ...]):
    terms = G.checked(dict(items))
    return terms, G.pattern_of(terms)


def _scan(texts: pa.Array, tags: pa.Array, glossaries: pa.Array) -> pa.Array:
    out = []
    for text, own, items in zip(texts.to_pylist(), tags.to_pylist(), glossaries.to_pylist(), strict=True):
        if text is None or not items:
            out.append({"uses": [], "removed": []})
            continue
        terms, pattern = _compiled(tuple((x["term"], x["gloss"]) for x in items))
        found = G.scan(text, set(own or ()), terms, pattern)
        out.append({"uses": [{"term": t, "place": p} for t, p in found.uses], "removed": [{"start": a, "stop": b} for a, b in found.removed]})
    kinds = pa.struct([("uses", pa.list_(pa.struct([("term", pa.string()), ("place", pa.int32())]))), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
    return pa.array(out, kinds)


def _rebuild(texts: pa.Array, removed: pa.Array, inserted: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), removed.to_pylist(), inserted.to_pylist(), strict=True)
    return pa.array([t if t is None else G.rebuild(t, [(x["start"], x["stop"]) for x in r or ()], [(x["place"], x["gloss"]) for x in i or ()]) for t, r, i in rows], pa.string())


def scanned(translations: DataFrame, glossary: DataFrame, segments: DataFrame) -> DataFrame:
    """``translations(page_id, seg_ord, segment_id, text)`` with the term uses of each record."""
    terms = glossary.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("term", "gloss"))).alias("__terms"))
    tags = segments.select("page_id", F.col("id").alias("segment_id"), F.transform(F.filter("protected", lambda t: t["kind"] == "tag"), lambda t: t["token"]).alias("__tags"))
    rows = translations.join(tags, ["page_id", "segment_id"], "left").join(terms, "page_id", "left")
    return rows.withColumn("__s", arrow_udf(_scan, SCANNED)("text", "__tags", "__terms")).select(*translations.columns, "__s.uses", "__s.removed")


def first_uses(scanned_rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """(page_id, segment_id, ord, term, place, gloss): the first use of each term on its page."""
    uses = scanned_rows.select("page_id", "seg_ord", "segment_id", F.posexplode("uses").alias("ord", "u")).select("page_id", "seg_ord", "segment_id", "ord", "u.*")
    order = Window.partitionBy("page_id", "term").orderBy("seg_ord", "ord")
    first = uses.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    return first.join(glossary.select("page_id", "term", "gloss"), ["page_id", "term"])


def normalize_first_use(translations: DataFrame, glossary: DataFrame, segments: DataFrame) -> DataFrame:
    """The translations with one gloss per term and page."""
    rows = scanned(translations, glossary, segments)
    first = first_uses(rows, glossary).groupBy("page_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("ord", "place", "gloss"))).alias("__i"))
    joined = rows.join(first, ["page_id", "segment_id"], "left")
    others = [c for c in translations.columns if c != "text"]
    return joined.select(*others, arrow_udf(_rebuild, "string")("text", "removed", "__i").alias("text"))


def glossary_errors(glossary: DataFrame) -> DataFrame:
    """(page_id, term, error) of entries that break the glossary contract."""
    blank = r"(?U)^[\s\x1c-\x1f]|[\s\x1c-\x1f]$"
    error = (
        F.when(F.col("term").isNull() | F.col("gloss").isNull(), F.lit("glossary terms and glosses must be strings"))
        .when((F.col("term") == "") | F.col("term").rlike(blank), F.lit("glossary term must be non-empty and trimmed"))
        .when((F.col("gloss") == "") | F.col("gloss").rlike(blank), F.lit("glossary gloss must be non-empty and trimmed"))
        .when(~F.col("gloss").rlike("[가-힣]"), F.lit("gloss must contain Korean text"))
        .when(F.col("gloss").rlike(r"[()\r\n]"), F.lit("gloss cannot contain parentheses or newlines"))
    )
    return glossary.select("page_id", "term", error.alias("error")).where("error is not null")


def ordered_terms(glossary: DataFrame) -> DataFrame:
    """(page_id, ord, term): longer terms first, ties by code point."""
    order = Window.partitionBy("page_id").orderBy(F.desc(F.length("term")), "term")
    return glossary.select("page_id", F.row_number().over(order).alias("ord"), "term")
