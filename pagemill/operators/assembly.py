"""Translated pages from marked pages, segments and checked translations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.contract import MARKER, AssemblyError
from pagemill.functions.build import assemble
from pagemill.operators.nodes import elements, spread
from pagemill.operators.segments import CHARS, PAGES
from pagemill.operators.terminology import normalize_first_use

RESULT = "page_id bigint, html string, error string"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(held):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "html", "error"])

    held, chars = ([], [], []), 0
    for batch in batches:
        for k in range(0, batch.num_rows, PAGES):
            for row in batch.slice(k, PAGES).to_pylist():
                html = error = None
                try:
                    html = assemble(row["html"], sorted(row["segments"] or [], key=lambda s: s["seg_ord"]), row["url"])
                except AssemblyError as e:
                    error = str(e)
                for x, v in zip(held, (row["page_id"], html, error), strict=True):
                    x.append(v)
                chars += len(html or "")
                if len(held[0]) >= PAGES or chars >= CHARS:
                    yield told(held)
                    held, chars = ([], [], []), 0
    if held[0]:
        yield told(held)


def assemble_pages(marked: DataFrame, segments: DataFrame, translations: DataFrame, glossary: DataFrame, urls: DataFrame) -> DataFrame:
    """(page_id, html, error): the page, or the first reason why there is none.

    ``marked(page_id, html)``, ``translations(page_id, seg_ord, segment_id, text)``, ``urls(page_id, url)``.
    """
    texts = normalize_first_use(translations, glossary, segments).select("page_id", F.col("segment_id").alias("id"), "text")
    rows = segments.join(texts, ["page_id", "id"]).groupBy("page_id").agg(F.collect_list(F.struct("seg_ord", "id", "semantic_type", "protected", "text")).alias("segments"))
    pages = marked.select("page_id", "html").join(rows, "page_id", "left").join(urls.select("page_id", "url"), "page_id")
    return spread(pages.select("page_id", "html", "segments", "url"), urls).mapInArrow(_assemble, RESULT)


def segment_errors(segments: DataFrame) -> DataFrame:
    """(page_id, id, error): segments that can't be assembled."""
    marks = F.exists("protected", lambda t: (t["kind"] == "location") & t["value"].rlike("^<!--wt-location:(attribute:[a-z][a-z0-9-]*|content)-->$"))
    error = (
        F.when(~F.col("target"), F.lit("non-target segment cannot be assembled"))
        .when(F.col("locator") != F.concat(F.lit(f"[{MARKER}='"), "id", F.lit("']")), F.lit("segment locator must exactly match its DOM marker"))
        .when(F.col("semantic_type").startswith("located:") != marks, F.lit("segment semantic type and location tokens disagree"))
    )
    return segments.select("page_id", "id", error.alias("error")).where("error is not null")


def marker_errors(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(page_id, id, error): markers of the marked page against the segments."""
    seen = elements(nodes).where(F.map_contains_key("attrs", MARKER)).groupBy("page_id", F.col("attrs")[MARKER].alias("id")).count()
    both = seen.join(segments.select("page_id", "id", F.lit(True).alias("known")), ["page_id", "id"], "full")
    error = F.when(F.col("count") > 1, F.lit("duplicate DOM marker")).when(F.col("count").isNull(), F.lit("missing DOM marker")).when(F.col("known").isNull(), F.lit("foreign DOM marker"))
    return both.select("page_id", "id", error.alias("error")).where("error is not null")


def restored(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """Placeholders replaced by their values in one pass, in built-in functions: (page_id, id, restored).

    A value may itself look like a placeholder; it isn't replaced again.
    """
    token = "⟦WT:[0-9]{6}⟧"
    values = F.map_from_entries(F.transform("protected", lambda t: F.struct(t["token"], t["value"])))
    rows = texts.select("page_id", F.col("segment_id").alias("id"), "text").join(segments.select("page_id", "id", values.alias("m")), ["page_id", "id"])
    pieces = F.split("text", token)
    found = F.expr(f"transform(regexp_extract_all(text, '({token})', 1), t -> coalesce(try_element_at(m, t), t))")
    joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), F.concat(found, F.array(F.lit(""))).alias("v")), lambda x: F.concat(x["p"], x["v"])), "")
    return rows.select("page_id", "id", joined.alias("restored"))


def shape_errors(source_nodes: DataFrame, output_nodes: DataFrame) -> DataFrame:
    """Elements that differ between two pages at the same place: (page_id, path, tag_source, tag_output)."""
    a = elements(source_nodes).select("page_id", F.array_join("path", ".").alias("path"), F.col("tag").alias("tag_source"))
    b = elements(output_nodes).select("page_id", F.array_join("path", ".").alias("path"), F.col("tag").alias("tag_output"))
    return a.join(b, ["page_id", "path"], "full").where("not (tag_source <=> tag_output)")
