"""Repeated word spans by De Bruijn compaction.

Windows of ``size`` words are the edges of a De Bruijn graph whose nodes are the sequences of ``size - 1`` words; an edge
is named by the hashes of its two nodes.

1. ``_pieces``: runs of windows whose least ``SMER``-word hash (the anchor) lies at the same place, an edge of several
   windows each, named by its first and its last node.  Equal windows have equal anchors, so a run can hold a repeated
   window only if its anchor occurs again.  Of runs equal within one batch of documents all but the earliest are
   repeated, with the earliest as their source: a hot passage sends one row a batch and not one a copy.
2. ``_edges``: where runs with one anchor differ (the ends of repeated passages), their windows become edges of one
   window each.  Everywhere else a run stays one edge.
3. ``edge_table``: one row per repeated edge with its earliest coordinate, by an aggregation with map-side combination.
4. ``label_paths``: in- and out-degrees of the nodes; edges whose sources run on through nodes that don't branch are one
   path, named by the coordinate of its first edge.
5. Occurrences meet their edge by a join; those that continue each other on one path compact into spans, whose words
   are compared with those at their source through joins on both coordinates.

The result is that of comparing all windows.  No worker holds the rows of one edge or anchor: groups only meet
aggregates of theirs, in joins that Spark can split.

Defined cases: a null text has no words; texts under ``size`` words lose nothing; a null id comes after all others;
rows equal in id and text count as one document and give equal rows; rows that share an id but not the text are
ordered by a hash of the text; two word sequences with one hash (128 bits) stop the run instead of changing its
result; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.llm.scratch import Scratch
from pagemill.llm.words import word_lists

#: Words of the hash whose least value in a window is the window's anchor.
SMER = 6
#: Words of one batch of documents.
BATCH = 1 << 20
_U = np.uint64
_NAMES = ["anchor", "left", "right", "doc", "place", "src_doc", "src", "kind"]
_ROWS = "anchor bigint, left bigint, right bigint, doc bigint, place bigint, src_doc bigint, src bigint, kind tinyint"
#: Kinds of rows: not known to be repeated, repeated (with its source), the earliest of several in its batch.
OPEN, REPEATED, AGAIN = 0, 1, 2
#: ``place`` holds a start and in its low bits the number of windows from there.
COUNT_BITS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _U(0x9E3779B97F4A7C15) + _mix(b + _U(0xD1B54A32D192ED03)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(_U)


def text_hashes(text: bytes) -> np.ndarray:
    parts = [word_hashes(words) for words in word_lists(text)]
    return np.concatenate(parts) if parts else np.empty(0, _U)


def sequence_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values, by doubling."""
    n = h.size - size + 1
    if n <= 0:
        return np.empty(0, _U)
    out, done, level, width = None, 0, h, 1
    left = size
    while left:
        if left & 1:
            part = level[done : done + n]
            out = part if out is None else _pair(out, part)
            done += width
        left >>= 1
        if left:
            level = _pair(level[:-width], level[width:])
            width *= 2
    return _mix(out + _U(size))


def runs(h: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of documents that lie end to end in ``h``: document, start, windows, anchor, first and last node."""
    smer = min(SMER, size)
    nodes, least = sequence_hashes(h, size - 1), sequence_hashes(h, smer)
    n, width = h.size - size + 1, size - smer + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, _U))
    best, where = least[:n].copy(), np.zeros(n, np.int64)
    for d in range(1, width):
        other = least[d : d + n]
        less = other < best
        best[less] = other[less]
        where[less] = d
    where += np.arange(n)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(lengths.size), lengths)[:n]
    inside = np.arange(n) + size <= ends[doc]
    new = np.r_[True, (where[1:] != where[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])] & inside
    start = np.flatnonzero(new)
    # a run ends before the next start or before the first window that leaves its document
    stop = np.minimum(np.r_[start[1:], n], (ends - size + 1)[doc[start]]) if start.size else start
    first = ends - lengths
    return doc[start], start - first[doc[start]], stop - start, best[start], nodes[start], nodes[stop]


def _told(anchor, left, right, doc, place) -> pa.RecordBatch:
    """Edges of a batch: of equal ones the earliest stays open, the others have it as their source."""
    count = place & ((1 << COUNT_BITS) - 1)
    order = np.lexsort((place, doc, count, right, left))
    left, right, count, doc, place, anchor = (x[order] for x in (left, right, count, doc, place, anchor))
    at = np.arange(left.size)
    new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (count[1:] != count[:-1])] if left.size else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(new, at, 0))
    # the same place of the same document may come twice (repeated rows); it doesn't repeat itself
    same = (doc == doc[head]) & (place == place[head])
    again = np.zeros(left.size, bool)
    again[head[~same]] = True
    keep = np.flatnonzero(~same | (head == at))
    keep = keep[np.lexsort((place[keep], doc[keep]))]
    known, repeated = head[keep], ~same[keep]
    kind = np.where(repeated, REPEATED, np.where(again[keep], AGAIN, OPEN)).astype(np.int8)
    plain = [x[keep].view(np.int64) for x in (anchor, left, right, doc, place)]
    # hashes are needed of open rows only, sources of repeated ones only
    hashes = [pa.array(x, pa.int64(), mask=repeated) for x in plain[:3]]
    sources = [pa.array(x[known], pa.int64(), mask=~repeated) for x in (doc, place)]
    return pa.RecordBatch.from_arrays([*hashes, *map(pa.array, plain[3:]), *sources, pa.array(kind)], _NAMES)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (id, text, more) in groups of about ``BATCH`` words; a longer text comes alone."""
    group, size = [], 0
    for batch in batches:
        more = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for doc, text, extra in zip(batch.column(0).to_pylist(), batch.column(1), more, strict=True):
            group.append((doc, text_hashes(text.as_buffer().to_pybytes()) if text.is_valid else np.empty(0, _U), extra))
            size += group[-1][1].size
            if size >= BATCH:
                yield group
                group, size = [], 0
    if group:
        yield group


def _pieces(size: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _documents(batches):
            doc, start, count, anchor, left, right = runs(np.concatenate([h for _, h, _ in group]), np.array([h.size for _, h, _ in group]), size)
            ids = np.array([d for d, _, _ in group], dtype=np.int64)
            yield _told(anchor, left, right, ids[doc], start << COUNT_BITS | count)

    return pieces


def _edges(size: int):
    """All windows of the given runs, an edge each."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _documents(batches):
            parts = []
            for doc, h, places in group:
                nodes = sequence_hashes(h, size - 1)
                places = np.unique(np.array(places, dtype=np.int64))
                at, n = places >> COUNT_BITS, places & ((1 << COUNT_BITS) - 1)
                at = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                parts.append((np.zeros(at.size, _U), nodes[at], nodes[at + 1], np.full(at.size, doc), at << COUNT_BITS | 1))
            yield _told(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return edges


def _count(place: str = "place"):
    return F.col(place).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("bigint"))


def edge_table(rows: DataFrame) -> DataFrame:
    """Open ``rows(left, right, n, doc, place, kind)`` to ``(left, right, n, src_doc, src)``: the repeated edges with their earliest coordinate.

    A document lies in one batch, so it has one open row an edge at most and the least document decides alone.
    """
    found = rows.groupBy("left", "right", "n").agg(F.count(F.lit(1)).alias("many"), F.max("kind").alias("most"), F.min("doc").alias("src_doc"), F.min_by("place", "doc").alias("src"))
    return found.where((F.col("many") > 1) | (F.col("most") == AGAIN)).select("left", "right", "n", "src_doc", "src")


def label_paths(edges: DataFrame) -> DataFrame:
    """The edges with ``path``: the source of the first edge of the nonbranching path that an edge lies on."""
    out = edges.groupBy("left").count().where("count > 1").select(F.col("left").alias("node"))
    into = edges.groupBy("right").count().where("count > 1").select(F.col("right").alias("node"))
    branching = out.union(into).distinct().withColumn("branches", F.lit(True))
    marked = edges.join(branching, edges["left"] == branching["node"], "left").withColumn("at", F.shiftright("src", COUNT_BITS))
    of = Window.partitionBy("src_doc").orderBy("at")
    follows = F.lag("at").over(of) + F.lag("n").over(of) == F.col("at")
    begins = F.when(F.coalesce(follows, F.lit(False)) & F.col("branches").isNull(), F.lit(None)).otherwise(F.col("src"))
    return marked.withColumn("begins", begins).withColumn("path", F.last("begins", ignorenulls=True).over(of)).select("left", "right", "n", "src_doc", "src", "path")


def _with_text(docs: DataFrame, lists: DataFrame) -> DataFrame:
    return docs.join(lists, "doc")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the words of each asked span (start, words) of a document."""
    for batch in batches:
        for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = [w for part in word_lists(text.as_buffer().to_pybytes()) for w in part]
            found = [xxhash.xxh3_128_digest(b" ".join(words[x["start"] : x["start"] + x["n"]])) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(asked), pa.int64()), pa.array([x["start"] for x in asked], pa.int64()), pa.array([x["n"] for x in asked], pa.int64()), pa.array(found, pa.binary())], ["doc", "start", "n", "words"])


def repeated_spans(docs: DataFrame, scratch: Scratch, size: int = 20) -> DataFrame:
    """``docs(doc, text)`` with unique ids to ``(doc, start, n, src_doc, src)``: verified spans of n words whose windows all start earlier at their source."""
    if size < 2 or size > (1 << COUNT_BITS) - 1 + SMER:
        raise ValueError("window too short or too long")
    pieces = scratch.write("pieces", docs.mapInArrow(_pieces(size), _ROWS))
    known = ["doc", "place", "src_doc", "src"]
    repeated = scratch.write("repeated", pieces.where(F.col("kind") == REPEATED).select(*known))
    left = pieces.where(F.col("kind") != REPEATED).select("anchor", "left", "right", "doc", "place", "kind")
    digest = F.xxhash64("left", "right", _count())
    # a run that is repeated in its batch stands for two
    weight = F.sum(F.when(F.col("kind") == AGAIN, 2).otherwise(1))
    anchors = left.groupBy("anchor").agg(weight.alias("many"), F.min(digest).alias("low"), F.max(digest).alias("high")).where("many > 1")
    anchors = scratch.write("anchors", anchors.select("anchor", (F.col("low") != F.col("high")).alias("differ")))
    scratch.settle()
    runs_left = scratch.write("runs", left.join(anchors, "anchor").drop("anchor"))
    scratch.drop("pieces", "anchors")
    scratch.settle()
    asked = runs_left.where("differ").groupBy("doc").agg(F.collect_list("place").alias("places"))
    windows = scratch.write("windows", _with_text(docs, asked).select("doc", "text", "places").mapInArrow(_edges(size), _ROWS))
    scratch.settle()
    names = ["left", "right", _count().alias("n"), "doc", "place", "kind"]
    rows = runs_left.where("not differ").select(*names).union(windows.where(F.col("kind") != REPEATED).select(*names))
    edges = scratch.write("edges", edge_table(rows))
    paths = scratch.write("paths", label_paths(edges))
    scratch.drop("edges")
    scratch.settle()
    none = F.lit(None).cast("bigint").alias("path")
    met = rows.drop("kind").join(paths, ["left", "right", "n"]).where("doc <> src_doc or place <> src").select(*known, "path")
    of_batch = repeated.union(windows.where(F.col("kind") == REPEATED).select(*known)).select(*known, none)
    spans = scratch.write("spans", compact(of_batch.union(met), size))
    scratch.drop("repeated", "runs", "windows", "paths")
    scratch.settle()
    digests = scratch.write("digests", _span_digests(docs, spans))
    scratch.settle()
    own, there = digests.withColumnRenamed("words", "own"), digests.toDF("src_doc", "src", "n", "there")
    checked = spans.join(own, ["doc", "start", "n"]).join(there, ["src_doc", "src", "n"])
    equal = F.when(F.col("own") == F.col("there"), True).otherwise(F.raise_error(F.lit("two word sequences with one hash")).cast("boolean"))
    return checked.where(equal).select("doc", "start", "n", "src_doc", "src")


def compact(found: DataFrame, size: int) -> DataFrame:
    """Pieces that continue each other in their document, at their source and on their path, as one span."""
    piece = found.select("doc", F.shiftright("place", COUNT_BITS).alias("start"), _count().alias("count"), "src_doc", F.shiftright("src", COUNT_BITS).alias("src"), "path")
    of = Window.partitionBy("doc").orderBy("start", "src_doc", "src")
    runs_on = (F.lag("src_doc").over(of) == F.col("src_doc")) & (F.lag("src").over(of) - F.lag("start").over(of) == F.col("src") - F.col("start")) & (F.lag("start").over(of) + F.lag("count").over(of) >= F.col("start"))
    same = runs_on & F.col("path").eqNullSafe(F.lag("path").over(of))
    marked = piece.withColumn("new", F.when(same, 0).otherwise(1))
    numbered = marked.withColumn("span", F.sum("new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("doc", "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("count")).alias("stop"), F.first("src_doc").alias("src_doc"), F.min("src").alias("src"))
    return spans.select("doc", "start", (F.col("stop") - F.col("start") + (size - 1)).alias("n"), "src_doc", "src")


def _span_digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    asked = spans.select("doc", "start", "n").union(spans.select("src_doc", "src", "n")).distinct()
    lists = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    return _with_text(docs, lists).select("doc", "text", "asked").mapInArrow(_digests, "doc bigint, start bigint, n bigint, words binary")


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts, spans.to_pylist(), strict=True):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        words = [w for part in word_lists(data) for w in part]
        if own:
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(gone, [x["start"] for x in own], 1)
            np.add.at(gone, [x["start"] + x["n"] for x in own], -1)
            stays = np.cumsum(gone)[:-1] == 0
            kept = [words[i] for i in np.flatnonzero(stays).tolist()]
        else:
            kept = words
        out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` after all repeated windows are cut."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "debruijn")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    plain = rows.groupBy("doc").count().where("count > 1 or doc is null").isEmpty()
    if not plain:
        text = F.xxhash64("text")
        once = rows.groupBy("doc", "text").agg(F.count(F.lit(1)).alias("copies"))
        order = [F.col("doc").asc_nulls_last(), text]
        numbered = once.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("number", F.monotonically_increasing_id())
        numbers = scratch.write("numbered", numbered)
        rows = numbers.select(F.col("number").alias("doc"), "text")
    spans = repeated_spans(rows, scratch, size)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans")).checkpoint()
    scratch.drop(*(["spans", "digests"]))
    scratch.settle()
    kept = arrow_udf(_kept, "n_words bigint, n_removed bigint, kept_sha256 string")
    said = rows.join(lists, "doc", "left").select("doc", kept("text", "spans").alias("r"))
    if plain:
        return said.select(F.col("doc").alias(id_col), "r.*")
    back = numbers.select(F.col("number"), F.col("doc").alias("own"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return said.join(back, F.col("doc") == F.col("number")).select(F.col("own").alias(id_col), "r.*")
