"""Pages as ordered node tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.contract import ATTRIBUTES, EXCLUDED
from pagemill.functions import html as H
from pagemill.functions.protect import has_words

#: ``ancestors`` is nearest first and holds an element itself; ``own`` numbers an element among its siblings' elements.
NODES = (
    "page_id bigint, pre int, post int, depth int, kind string, tag string, attrs map<string,string>, text string, "
    "path array<int>, ancestors array<struct<pre:int,tag:string,off:boolean>>, words boolean, content boolean, attr_words array<string>"
)
_TYPES = {
    "page_id": pa.int64(), "pre": pa.int32(), "post": pa.int32(), "depth": pa.int32(), "kind": pa.string(), "tag": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "path": pa.list_(pa.int32()),
    "ancestors": pa.list_(pa.struct([("pre", pa.int32()), ("tag", pa.string()), ("off", pa.bool_())])),
    "words": pa.bool_(), "content": pa.bool_(), "attr_words": pa.list_(pa.string()),
}
#: The columns that need no search for words, which costs most.
PLAIN = tuple(n for n in _TYPES if n not in ("words", "content", "attr_words"))
#: Rows of one Arrow batch, so that large pages don't pile up.
BATCH = 4000


def _tests(order: list[H.Node], root: H.Node, free: list[bool], names: set[str]) -> dict[str, list]:
    """The columns that need a search for words, as far as they are asked for."""
    out: dict[str, list] = {}
    if "words" in names:
        out["words"] = [n.tag is None and f and n.parent is not root and bool(n.text.strip()) and has_words(n.text) for n, f in zip(order, free, strict=True)]
    if "content" in names:
        owners = H.content_owners(root)
        out["content"] = [n.element and id(n) in owners and has_words(H.inner(n, lambda x: id(x) in owners)) for n in order]
    if "attr_words" in names:
        out["attr_words"] = [[a for a in ATTRIBUTES if a in n.attrs and has_words(n.attrs[a])] if n.element and f else [] for n, f in zip(order, free, strict=True)]
    return out


def columns_of(page_id: int, html: str, names: set[str]) -> dict[str, list]:
    """The asked columns of all nodes of a page in document order."""
    root = H.parse(html)
    order = [n for n in root.walk() if n is not root]
    size: dict[int, int] = {}
    for n in reversed(order):
        size[id(n)] = 1 + sum(size[id(c)] for c in n.children)
    above: dict[int, list[dict]] = {id(root): []}
    paths: dict[int, list[int]] = {id(root): []}
    count: dict[int, int] = {}
    ups, free = [], []
    for i, n in enumerate(order):
        up = above[id(n.parent)]
        if n.element:
            place = count.get(id(n.parent), 0)
            count[id(n.parent)] = place + 1
            paths[id(n)] = [*paths[id(n.parent)], place]
            off = n.attrs.get("translate", "").strip().lower() == "no"
            above[id(n)] = up = [{"pre": i, "tag": n.tag, "off": off}, *up]
        ups.append(up)
        free.append(not any(a["off"] or a["tag"] in EXCLUDED for a in up))
    own = [paths[id(n)] if n.element else paths[id(n.parent)] for n in order]
    known = {
        "page_id": lambda: [page_id] * len(order),
        "pre": lambda: list(range(len(order))),
        "post": lambda: [i + size[id(n)] - 1 for i, n in enumerate(order)],
        "depth": lambda: list(map(len, own)),
        "kind": lambda: ["element" if n.element else "text" if n.tag is None else "comment" for n in order],
        "tag": lambda: [n.tag if n.element else None for n in order],
        "attrs": lambda: [list(n.attrs.items()) if n.element else None for n in order],
        "text": lambda: [(H.visible_text(n) if f and H.is_heading(n.tag) else None) if n.element else n.text for n, f in zip(order, free, strict=True)],
        "path": lambda: own,
        "ancestors": lambda: ups,
    }
    return {name: known[name]() for name in known if name in names} | _tests(order, root, free, names)


def rows_of(page_id: int, html: str) -> Iterator[dict]:
    """All nodes of a page in document order, with all columns."""
    found = columns_of(page_id, html, set(_TYPES))
    for row in zip(*found.values(), strict=True):
        yield dict(zip(found, row, strict=True))


def _parse(names: list[str]):
    def told(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[n], _TYPES[n]) for n in names], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = columns_of(page_id, html.as_py() or "", set(names))
                for n in names:
                    held[n] += found[n]
                if len(held[names[0]]) >= BATCH:
                    yield told(held)
                    held = {n: [] for n in names}
        if held[names[0]]:
            yield told(held)

    return parse


def spread(pages: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The rows over all cores, where the size (of ``like``, if given) would give fewer tasks than there are cores.

    Parsing costs far more than moving such a table.  A large table has its tasks and stays where it is.
    """
    spark = pages.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = (pages if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    bound = cores * spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split)
    return pages.repartition(cores) if int(str(size)) < bound else pages


def dom_nodes(pages: DataFrame, *columns: str) -> DataFrame:
    """``pages(page_id, html)`` to one row per node, with the asked columns or all; null pages are empty pages."""
    names = [n for n in _TYPES if n in columns] or list(_TYPES)
    types = {c.strip().split(" ", 1)[0]: c.strip() for c in _columns(NODES)}
    return spread(pages.select("page_id", "html")).mapInArrow(_parse(names), ", ".join(types[n] for n in names))


def _columns(schema: str) -> list[str]:
    """The columns of a schema; commas within types part nothing."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def is_candidate(ancestors: Column | None = None) -> Column:
    """No node among the ancestors is excluded from translation."""
    above = F.col("ancestors") if ancestors is None else ancestors
    return ~F.exists(above, lambda a: a["off"] | a["tag"].isin(*EXCLUDED))


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element'")


def is_heading(tag: Column) -> Column:
    return tag.rlike("^h[1-6]$")


def ancestor_pairs(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, ancestor): the tree range test as rows."""
    return elements(nodes).select("page_id", "pre", F.explode(F.transform(F.slice("ancestors", F.lit(2), F.size("ancestors")), lambda a: a["pre"])).alias("ancestor"))
