"""Nodes, segments and protected spans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.functions.protect import protect, restore
from pagemill.operators import nodes as N
from pagemill.operators import segments as S
from pagemill.plans.cut import cut
from pagemill.plans.pages import extract
from pagemill.queries import query, table

_TAGS = ("a", "article", "b", "footer", "h1", "li", "nav", "p", "title", "ul")


@query("""
SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]'))::BIGINT AS n
FROM pages, (SELECT unnest(['a','article','b','footer','h1','li','nav','p','title','ul']) AS tag)
WHERE len(regexp_extract_all(html, '<' || tag || '[ >]')) > 0
""")
def r01_element_counts(spark, sf):
    """Elements of each page by tag, from the parsed tree."""
    own = N.elements(N.dom_nodes(table(spark, sf, "pages"), "page_id", "kind", "tag")).where(F.col("tag").isin(*_TAGS))
    return own.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages
""")
def r01_link_targets(spark, sf):
    return N.elements(N.dom_nodes(table(spark, sf, "pages"), "page_id", "kind", "tag", "attrs")).where("tag = 'a'").select("page_id", F.col("attrs")["href"].alias("href"))


_ROWS = "'<table>' || repeat('<tr><td>cell</td><td translate=\"no\">x</td></tr>', cast(1 + o_orderkey % 3 as int)) || '</table><table translate=\"no\"><tr><td>y</td></tr></table>'"


@query(f"""
SELECT page_id, unnest(range(1, n + 1))::INTEGER AS row
FROM (SELECT o_orderkey AS page_id, 1 + o_orderkey % 3 AS n, {_ROWS} AS html FROM orders)
""")
def r08_table_rows(spark, sf):
    """Rows of tables numbered in document order; excluded tables have none."""
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", f"{_ROWS} html")
    return S.table_rows(N.dom_nodes(pages, *N.PLAIN)).select("page_id", "row")


_HEADS = "'<h1>A' || o_orderkey || '</h1><h3>C</h3><p>one</p><h2>B</h2><p>two</p><h3>D</h3><p>three</p><h1>E</h1><p>four</p>'"


@query("""
SELECT o_orderkey AS page_id, seg_ord, replace(path, '#', o_orderkey::VARCHAR) AS path
FROM orders, (VALUES (1, ''), (2, 'A#'), (3, 'A#/C'), (4, 'A#'), (5, 'A#/B'), (6, 'A#/B'), (7, 'A#/B/D'), (8, ''), (9, 'E')) v(seg_ord, path)
""")
def w01_heading_paths(spark, sf):
    """The headings above each segment: lower ranks end with every heading of their rank or above."""
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", f"{_HEADS} html")
    return S.targets(cut(N.dom_nodes(pages))).select("page_id", "seg_ord", F.array_join("heading_path", "/").alias("path"))


_PARAS = "repeat('<p>word</p>', cast(1 + o_orderkey % 4 as int))"


@query("""
SELECT page_id, printf('seg-%06d', k) AS id,
       concat_ws(',', CASE WHEN k > 1 THEN printf('seg-%06d', k - 1) END, CASE WHEN k < n THEN printf('seg-%06d', k + 1) END) AS context
FROM (SELECT o_orderkey AS page_id, 1 + o_orderkey % 4 AS n, unnest(range(1, 2 + o_orderkey % 4)) AS k FROM orders)
""")
def w02_neighbours(spark, sf):
    """Ids in order and the neighbours of each segment."""
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", f"{_PARAS} html")
    return S.targets(cut(N.dom_nodes(pages))).select("page_id", "id", F.array_join("context_ids", ",").alias("context"))


_PAGE = "'<h1>Order ' || o_orderkey || '</h1><p>Clients MUST read <code>x' || o_custkey || '</code> at https://e.com/' || o_orderkey || '.</p><ul><li>one <a href=\"#t\">two</a></li></ul><img alt=\"pic ' || o_orderkey || '\" title=\"t\">'"


@query("""
SELECT o_orderkey AS page_id, id, semantic_type, replace(text, '#', o_orderkey::VARCHAR) AS source_text, kinds
FROM orders, (VALUES
  ('seg-000001', 'heading', 'Order #', ''),
  ('seg-000002', 'paragraph', 'Clients ⟦WT:000000⟧ read ⟦WT:000001⟧ at ⟦WT:000002⟧.', 'keyword,code,url'),
  ('seg-000003', 'list_item', 'one ⟦WT:000000⟧two⟦WT:000001⟧', 'tag,tag'),
  ('seg-000004', 'located:attributes', '⟦WT:000000⟧pic #⟦WT:000001⟧t', 'location,location')) v(id, semantic_type, text, kinds)
""")
def r02_segments(spark, sf):
    """The main extraction: types, protected texts and kinds of tokens."""
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", "'https://e.com/' url", f"{_PAGE} html")
    found = extract(pages).segments
    return found.select("page_id", "id", "semantic_type", "source_text", F.array_join(F.transform("protected", lambda t: t["kind"]), ",").alias("kinds"))


@query("""
SELECT page_id, len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS n FROM pages WHERE len(regexp_extract_all(html, '<li[ >]')) > 0
""")
def r07_list_items(spark, sf):
    """Every list item of a page is a segment of its own."""
    found = S.targets(cut(N.dom_nodes(table(spark, sf, "pages")))).where("semantic_type = 'list_item'")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, 0::BIGINT AS left_over, TRUE AS dense FROM pages")
def r10_dense_ids(spark, sf):
    """Marked pages carry just the segments' ids, in order, and extraction is done for them."""
    pages = table(spark, sf, "pages")
    done = extract(pages)
    marked = N.dom_nodes(done.marked.select("page_id", "html"), *N.PLAIN)
    before = S.extracted_before(marked, done.segments).withColumn("dense", F.lit(True))
    errors = S.check_restorable(done.segments).groupBy("page_id").agg(F.count(F.lit(1)).alias("left_over"))
    return pages.select("page_id").join(errors, "page_id", "left").join(before, "page_id", "left").select("page_id", F.coalesce("left_over", F.lit(0)).cast("bigint").alias("left_over"), F.coalesce("dense", F.lit(False)).alias("dense"))


@query("""
SELECT o_orderkey AS page_id, n::INTEGER AS check_ord FROM orders, (VALUES (1), (2), (3)) v(n) WHERE o_orderkey % 3 = n - 1
""")
def p09_reserved_spellings(spark, sf):
    html = "case o_orderkey % 3 when 0 then '<style>[data-wt-segment]{}</style>' when 1 then '<p data-wt-segment=\"x\">y</p>' else '<p><!--wt-location:content-->y</p>' end"
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", f"{html} html")
    return S.contract_errors(pages, cut(N.dom_nodes(pages))).select("page_id", "check_ord")


def _protected(texts: pa.Array) -> pa.Array:
    rows = [protect(t) for t in texts.to_pylist()]
    return pa.array([{"text": t, "tokens": [{"token": a, "kind": k, "value": v} for a, k, v in tokens]} for t, tokens in rows],
                    pa.struct([("text", pa.string()), ("tokens", pa.list_(pa.struct([("token", pa.string()), ("kind", pa.string()), ("value", pa.string())])))]))


def protect_fragment(column):
    """``struct<text, tokens>`` of a fragment."""
    return arrow_udf(_protected, "text string, tokens array<struct<token:string,kind:string,value:string>>")(column)


_SPANS = (
    "case o_orderkey % 8 when 0 then 'Clients may retry but SHOULD NOT send ' || o_orderkey || '.'"
    " when 1 then 'See https://e.com/o_(' || o_orderkey || ').'"
    " when 2 then 'Run npm install carefully, ' || o_orderkey"
    " when 3 then 'make a careful choice ' || o_orderkey"
    " when 4 then 'Run docker run --rm img' || o_orderkey || ' echo hello before noon.'"
    " when 5 then 'Literal ⟦WT:000000⟧ and <code>x' || o_orderkey || '</code>.'"
    " when 6 then '<span title=\"1 > 0\">' || o_orderkey || '</span>'"
    " else 'git -C dir' || o_orderkey || ' status and more' end"
)


@query("""
SELECT o_orderkey AS id,
  CASE o_orderkey % 8 WHEN 0 THEN 'Clients may retry but ⟦WT:000000⟧ send ' || o_orderkey || '.' WHEN 1 THEN 'See ⟦WT:000000⟧.'
    WHEN 2 THEN 'Run ⟦WT:000000⟧ carefully, ' || o_orderkey WHEN 3 THEN 'make a careful choice ' || o_orderkey
    WHEN 4 THEN 'Run ⟦WT:000000⟧ before noon.' WHEN 5 THEN 'Literal ⟦WT:000001⟧ and ⟦WT:000002⟧.'
    WHEN 6 THEN '⟦WT:000000⟧' || o_orderkey || '⟦WT:000001⟧' ELSE '⟦WT:000000⟧ and more' END AS text,
  CASE o_orderkey % 8 WHEN 0 THEN 'keyword=SHOULD NOT' WHEN 1 THEN 'url=https://e.com/o_(' || o_orderkey || ')'
    WHEN 2 THEN 'command=npm install' WHEN 3 THEN '' WHEN 4 THEN 'command=docker run --rm img' || o_orderkey || ' echo hello'
    WHEN 5 THEN 'literal_token=⟦WT:000000⟧|code=<code>x' || o_orderkey || '</code>'
    WHEN 6 THEN 'tag=<span title="1 > 0">|tag=</span>' ELSE 'command=git -C dir' || o_orderkey || ' status' END AS spans
FROM orders
""")
def t01_protected_spans(spark, sf):
    """Keywords, addresses, commands, literal placeholders, code and tags become placeholders; prose stays."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", f"{_SPANS} html").withColumn("p", protect_fragment(F.col("html")))
    return rows.select("id", "p.text", F.array_join(F.transform("p.tokens", lambda t: F.concat_ws("=", t["kind"], t["value"])), "|").alias("spans"))


@query(f"SELECT o_orderkey AS id, {_SPANS} AS restored FROM orders")
def t12_restored(spark, sf):
    """What was protected comes back exactly."""

    def back(texts: pa.Array, tokens: pa.Array) -> pa.Array:
        return pa.array([restore(t, [(x["token"], x["kind"], x["value"]) for x in own]) for t, own in zip(texts.to_pylist(), tokens.to_pylist(), strict=True)], pa.string())

    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", f"{_SPANS} html").withColumn("p", protect_fragment(F.col("html")))
    return rows.select("id", arrow_udf(back, "string")("p.text", "p.tokens").alias("restored"))


@query("SELECT doc_id, text AS restored FROM documents")
def t12_restored_documents(spark, sf):
    """Restoring is the inverse of protecting for whole documents, tags and all."""
    rows = table(spark, sf, "documents").select("doc_id", "text").withColumn("p", protect_fragment(F.col("text")))
    pieces = F.split("p.text", "⟦WT:[0-9]{6}⟧")
    values = F.concat(F.transform("p.tokens", lambda t: t["value"]), F.array(F.lit("")))
    return rows.select("doc_id", F.array_join(F.transform(F.arrays_zip(pieces.alias("a"), values.alias("b")), lambda x: F.concat(x["a"], x["b"])), "").alias("restored"))


_KEYWORD = "'The server ' || case o_orderkey % 4 when 0 then 'MUST NOT' when 1 then 'SHALL' when 2 then 'must' else 'NOT RECOMMENDED' end || ' accept ' || o_orderkey"


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'MUST NOT' WHEN 1 THEN 'SHALL' WHEN 2 THEN '' ELSE 'NOT RECOMMENDED' END AS keyword FROM orders
""")
def t06_keywords(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", f"{_KEYWORD} html").withColumn("p", protect_fragment(F.col("html")))
    return rows.select("id", F.array_join(F.transform("p.tokens", lambda t: t["value"]), "|").alias("keyword"))


_NEST = "'<article><p>a' || o_orderkey || '</p><div><p>b</p></div></article>'"


@query("""
SELECT o_orderkey AS page_id, tag, depth::INTEGER AS depth, above FROM orders,
 (VALUES ('html', 1, ''), ('head', 2, 'html'), ('body', 2, 'html'), ('article', 3, 'body/html'), ('p', 4, 'article/body/html'), ('div', 4, 'article/body/html'), ('p', 5, 'div/article/body/html')) v(tag, depth, above)
""")
def j09_ancestors(spark, sf):
    """The elements above each element, nearest first."""
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", f"{_NEST} html")
    rows = N.elements(N.dom_nodes(pages, *N.PLAIN))
    return rows.select("page_id", "tag", "depth", F.array_join(F.transform(F.slice("ancestors", F.lit(2), F.size("ancestors")), lambda a: a["tag"]), "/").alias("above"))


@query("""
SELECT o_orderkey AS page_id, n::BIGINT AS n FROM orders, (VALUES (2)) v(n)
""")
def p04_excluded(spark, sf):
    """Scripts, code and what says translate="no" own no text."""
    html = "'<p>yes</p><pre>no</pre><div translate=\" NO \"><p>no</p></div><script>no</script><p>yes<code>no</code></p>'"
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", f"{html} html")
    return S.text_owners(N.dom_nodes(pages, "page_id", "pre", "kind", "ancestors", "words")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
