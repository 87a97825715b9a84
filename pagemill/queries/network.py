"""Addresses, assets and style sheets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.functions import urls as U
from pagemill.functions.build import executable_url
from pagemill.operators import capture as P
from pagemill.operators import qa as Q
from pagemill.operators import report as R
from pagemill.operators.nodes import PLAIN, dom_nodes
from pagemill.plans.cut import cut
from pagemill.queries import query, table

# Addresses by kind, and whether they are public.
_URLS = [
    ("https://example.com/a", True), ("http://localhost/", False), ("http://127.0.0.1/", False), ("http://0x7f000001/", False), ("http://017700000001/", False), ("http://127.1/", False), ("ftp://example.com/", False),
    ("http://u:p@example.com/", False), ("http://10.1.2.3/", False), ("http://8.8.8.8/", True), ("http://[::1]/", False), ("http://x.localhost./", False), ("http://224.0.0.1/", False), ("http://134744072/", True),
]


@query("SELECT o_orderkey AS id, (o_orderkey % 14) IN (0, 9, 13) AS public FROM orders")
def p01_public_urls(spark, sf):
    urls = F.array(*[F.lit(u) for u, _ in _URLS])
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.get(urls, (F.col("o_orderkey") % 14).cast("int")).alias("url"))
    return rows.select("id", P.url_error("url").isNull().alias("public"))


@query(r"""
WITH p AS (SELECT *, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/](\.[A-Za-z0-9]{1,10})$', 1)) AS own FROM pages)
SELECT page_id, 'assets/' || substr(sha256(url), 1, 16) || CASE page_id % 3 WHEN 0 THEN '.css' WHEN 1 THEN '.png' ELSE coalesce(nullif(own, ''), '.bin') END AS name FROM p
""")
def r29_asset_names(spark, sf):
    kind = F.expr("case page_id % 3 when 0 then 'text/css; charset=utf-8' when 1 then 'IMAGE/PNG' else null end")
    rows = table(spark, sf, "pages")
    return rows.select("page_id", P.asset_name(F.col("url"), kind).alias("name"))


@query("SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages")
def r31_fingerprints(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("bigint").alias("bytes"))


@query("""
SELECT o_orderkey AS id, v.n::INTEGER AS n, v.url || o_orderkey || '.png' AS url, v.d AS descriptor FROM orders, (VALUES (0, 'a', '1x'), (1, 'b,c', '200w'), (2, 'd', '')) v(n, url, d)
""")
def r24_srcset(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", "' a' || o_orderkey || '.png 1x, b,c' || o_orderkey || '.png 200w,d' || o_orderkey || '.png' s")
    return rows.select("id", F.posexplode(P.srcset_candidates("s")).alias("n", "c")).select("id", "n", "c.url", "c.descriptor")


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'https://e.com/a/x' || o_orderkey WHEN 1 THEN 'https://e.com/y' || o_orderkey ELSE 'http://f.org/z' END AS url FROM orders
""")
def r25_resolved(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", "case o_orderkey % 3 when 0 then 'x' || o_orderkey when 1 then '/y' || o_orderkey else 'http://f.org/z' end ref")
    return rows.select("id", P.url_join(F.lit("https://e.com/a/b?q"), "ref").alias("url"))


@query("""
SELECT o_orderkey AS id, v.context, replace(v.url, '#', o_orderkey::VARCHAR) AS url FROM orders, (VALUES ('import', 'i#.css'), ('resource', 'u#.png'), ('resource', 'q#.woff')) v(context, url)
""")
def r37_css_urls(spark, sf):
    """Addresses of a style sheet; none from comments and plain strings."""
    css = "'@import \"i' || o_orderkey || '.css\"; /* url(no) */ a{background:url(u' || o_orderkey || '.png);content:\"url(no)\"} @font-face{src:url( \"q' || o_orderkey || '.woff\" )}'"
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", f"{css} css")
    return rows.select("id", F.explode(Q.css_urls(F.col("css"))).alias("u")).select("id", "u.*")


_REFS = "'<link rel=\"stylesheet\" href=\"/s.css\"><link rel=\"icon\" href=\"i.ico\"><link rel=\"next\" href=\"n\"><img src=\"p' || o_orderkey || '.png\" srcset=\"a.png 1x, b.png 2x\"><img src=\"data:x\">'"


@query("""
SELECT o_orderkey AS page_id, v.ord::INTEGER AS ord, v.kind, v.critical, replace(v.url, '#', o_orderkey::VARCHAR) AS url FROM orders,
 (VALUES (1, 'stylesheet', TRUE, 'https://e.com/s.css'), (2, 'image', FALSE, 'https://e.com/d/i.ico'), (3, 'image', FALSE, 'https://e.com/d/p#.png'), (4, 'image', FALSE, 'https://e.com/d/a.png'), (5, 'image', FALSE, 'https://e.com/d/b.png')) v(ord, kind, critical, url)
""")
def r22_page_references(spark, sf):
    """What a page loads, in order, as whole addresses."""
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", "'https://e.com/d/p' url", f"{_REFS} html")
    nodes = cut(dom_nodes(pages, *PLAIN))
    return P.resolved_refs(P.page_refs(nodes), P.base_urls(pages, nodes)).select("page_id", "ord", "kind", "critical", "url")


def _numbered(rows):
    """Every fetch, numbered anew within its page; rows that tie are equal in all columns read."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "bytes", F.col("url").cast("bigint"))))


@query("""
WITH r AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT, l_partkey % 50) AS ord, l_partkey % 50 AS url, l_quantity::BIGINT * 4000000 AS bytes FROM lineitem),
     s AS (SELECT *, sum(bytes) OVER (PARTITION BY page_id ORDER BY ord) AS total FROM r)
SELECT page_id, min(ord)::BIGINT AS ord, 'resource budget exceeded: downloaded bytes' AS error FROM s WHERE total > 134217728 GROUP BY page_id
""")
def a10_budgets(spark, sf):
    """The first fetch of a page that breaks a budget."""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey page_id", "l_linenumber ord", "cast(l_partkey % 50 as string) url", "0 hops", "cast(l_quantity as bigint) * 4000000 bytes")
    return P.budget_errors(_numbered(rows)).select("page_id", F.col("ord").cast("bigint").alias("ord"), "error")


@query("""SELECT o_orderkey AS page_id, CASE o_orderkey % 5 WHEN 1 THEN 'unsupported authentication page' WHEN 2 THEN 'unsupported CAPTCHA page' WHEN 3 THEN 'unsupported JavaScript-only page' ELSE 'unsupported interstitial page' END AS error FROM orders WHERE o_orderkey % 5 <> 0""")
def p03_unsupported_pages(spark, sf):
    html = "case o_orderkey % 5 when 0 then '<p>how to log in and solve a captchas</p>' when 1 then '<form action=\"/login\"><input></form>' when 2 then '<div class=\"g-recaptcha\"></div>' when 3 then '<div id=\"root\"></div><script>x</script>' else '<title>Just a moment...</title><p>Checking your browser</p>' end"
    pages = table(spark, sf, "orders").selectExpr("o_orderkey page_id", f"{html} html")
    return P.unsupported_pages(pages, cut(dom_nodes(pages, *PLAIN))).select("page_id", "error")


@query("""SELECT o_orderkey AS id, (o_orderkey % 4) IN (0, 1, 2) AS executable FROM orders""")
def p13_executable_urls(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", "case o_orderkey % 4 when 0 then 'java' || char(9) || 'script:x' when 1 then ' VBScript:y' when 2 then 'data:text/html,z' else 'https://javascript:8/' end url")
    return rows.select("id", arrow_udf(lambda u: pa.array([executable_url(x) for x in u.to_pylist()], pa.bool_()), "boolean")("url").alias("executable"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'a{b:' || o_orderkey || '}' WHEN 1 THEN 'a{}' END AS css, o_orderkey % 3 = 2 AS broken FROM orders""")
def s06_data_stylesheets(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", "case o_orderkey % 3 when 0 then 'data:text/css,a%7Bb:' || o_orderkey || '}' when 1 then 'data:text/css;charset=utf-8;base64,YXt9' else 'data:text/css;base64,YX*' || o_orderkey end u")
    return rows.withColumn("d", P.data_stylesheets("u")).select("id", "d.css", F.col("d.error").isNotNull().alias("broken")).withColumn("css", F.when(~F.col("broken"), F.col("css")))


@query("""SELECT o_orderkey AS id, '`` a &lt;b&gt; \\| `' || o_orderkey || '` ``' AS span FROM orders""")
def r15_code_spans(spark, sf):
    """Inert Markdown: markup escaped, fences longer than what they hold."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), R.code_span(F.concat(F.lit("a <b> | `"), F.col("o_orderkey").cast("string"), F.lit("`"))).alias("span"))


@query("""SELECT o_orderkey AS id, 'e.com-a-b_' || o_orderkey || '-20240102-030405' AS run_id FROM orders""")
def r32_run_ids(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", "'https://E.com/a%20b_' || o_orderkey || '/?q' url", "timestamp'2024-01-02 03:04:05' at")
    return rows.select("id", P.run_id(F.col("url"), F.col("at")).alias("run_id"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '#z' || o_orderkey WHEN 1 THEN '#t' END AS fragment FROM orders""")
def r26_same_document(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", "case o_orderkey % 4 when 0 then '#z' || o_orderkey when 1 then '/d/p?q#t' when 2 then '/d/p?q' else 'other#t' end ref")
    return rows.select("id", arrow_udf(lambda r: pa.array([U.same_document(x, "https://e.com/d/p?q") for x in r.to_pylist()], pa.string()), "string")("ref").alias("fragment"))


@query("""SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN 'missing' ELSE 'unsafe' END AS problem, CASE WHEN o_orderkey % 2 = 0 THEN 'assets/x.css' ELSE '../x.css' END AS path FROM orders WHERE o_orderkey % 4 < 2""")
def v06_assets(spark, sf):
    orders = table(spark, sf, "orders")
    wanted = orders.selectExpr("o_orderkey page_id", "case when o_orderkey % 2 = 0 then 'assets/x.css' when o_orderkey % 4 = 1 then '../x.css' else 'a/../assets/x.css' end path", "'critical' class")
    listing = orders.where("o_orderkey % 4 > 1").selectExpr("o_orderkey page_id", "'assets/x.css' path")
    return Q.assets(wanted, listing).select("page_id", F.regexp_extract("code", "(missing|unsafe)$", 1).alias("problem"), F.array_join("evidence.paths", ",").alias("path"))


@query("""SELECT page_id, 'und' AS source_language FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'en' FROM pages WHERE page_id % 2 = 1""")
def r33_source_language(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "1 seg_ord", "true target", "case when page_id % 2 = 0 then '12 ⟦34⟧ !' else 'this is the text of the page and it was read by us' end source_text")
    return R.source_language(rows)
