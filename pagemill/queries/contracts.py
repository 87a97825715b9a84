"""Contracts on translations, reviews and records, over tables with known faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import contracts as C
from pagemill.operators import terminology as T
from pagemill.queries import query, table
from pagemill.sources import records as R

#: A zone of two segments per order; its results have one fault by the order's key.
_KEY = "o_orderkey % 7"


def _zones(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey page_id", "1 zone_ord", "'zone-001' id", "array('a', 'b') target_ids", "array('c') context_before_ids", "array() context_after_ids",
        "map('a', array('⟦WT:000000⟧'), 'b', array('⟦WT:000001⟧', '⟦WT:000002⟧')) expected_tokens")


def _results(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey page_id", "'zone-001' zone_id", f"""explode(case {_KEY}
        when 1 then array(struct('a' segment_id, cast(null as string) text), struct('b' segment_id, '⟦WT:000002⟧ x ⟦WT:000001⟧' text))
        when 2 then array(struct('a' segment_id, 'y ⟦WT:000000⟧' text), struct('a' segment_id, '⟦WT:000000⟧' text), struct('z' segment_id, '' text))
        when 3 then array(struct('a' segment_id, 'y ⟦WT:000000⟧' text), struct('z' segment_id, 'x' text), struct('b' segment_id, 'x' text))
        when 4 then array(struct('a' segment_id, 'y' text))
        when 5 then array(struct('a' segment_id, 'y ⟦WT:000000⟧ ⟦WT:000000⟧' text), struct('b' segment_id, '⟦WT:000002⟧ x ⟦WT:000001⟧' text))
        else array(struct('a' segment_id, 'y ⟦WT:000000⟧' text), struct('b' segment_id, '⟦WT:000002⟧ x ⟦WT:000001⟧' text)) end) r""")  # fmt: skip
    return rows.select("page_id", "zone_id", "r.*")


@query(f"""
SELECT o_orderkey AS page_id, ({_KEY})::INTEGER AS check_ord,
 CASE {_KEY} WHEN 1 THEN 'translation record must hold strings' WHEN 2 THEN 'duplicate translation IDs: a' WHEN 3 THEN 'unassigned translation IDs: z'
   WHEN 4 THEN 'missing translation IDs: b' ELSE 'protected-token multiset changed for a' END AS error
FROM orders WHERE {_KEY} BETWEEN 1 AND 5
""")
def v01_zone_results(spark, sf):
    """The first broken rule of each zone's results."""
    return C.zone_result_errors(_zones(spark, sf), _results(spark, sf)).select("page_id", "check_ord", "error")


@query(f"""
SELECT o_orderkey AS page_id, segment_id, side FROM orders,
 (VALUES (2, 'b', 'missing'), (2, 'z', 'foreign'), (3, 'z', 'foreign'), (4, 'b', 'missing')) v(k, segment_id, side) WHERE {_KEY} = k
""")
def j03_id_differences(spark, sf):
    want = _zones(spark, sf).select("page_id", F.explode("target_ids").alias("segment_id"))
    return C.id_differences(want, _results(spark, sf))


@query("SELECT o_orderkey AS page_id, 'zone-001' AS id FROM orders WHERE o_orderkey % 5 IN (0, 3)")
def e03_context_overlap(spark, sf):
    """Zones whose neighbours are also targets."""
    zones = _zones(spark, sf)
    before = F.expr("case page_id % 5 when 0 then array('c', 'b') else context_before_ids end")
    after = F.expr("case page_id % 5 when 3 then array('a') else context_after_ids end")
    return C.overlapping_context(zones.withColumns({"context_before_ids": before, "context_after_ids": after}))


@query("SELECT o_orderkey AS page_id FROM orders WHERE o_orderkey % 3 <> 1")
def v21_summaries(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey page_id", "case o_orderkey % 3 when 0 then '   ' when 1 then 'ok' else repeat('x', 4001) end summary")
    return C.summary_errors(rows)


@query("""
SELECT o_orderkey AS page_id, 'zone-001' AS zone_id,
 '{"context_after":[],"context_before":[],"document_summary":"s","glossary":{"t":"' || o_custkey || '"},"schema_version":1,"targets":[{"heading_path":["h"],"id":"a","protected":[],"semantic_type":"paragraph","source_text":"x' || o_orderkey || '"},{"heading_path":["h"],"id":"b","protected":[],"semantic_type":"paragraph","source_text":"y"}],"zone_id":"zone-001"}' AS json
FROM orders
""")
def j01_assignments(spark, sf):
    """Packages for translators: five-field records in the order of the zone."""
    orders = table(spark, sf, "orders")
    empty = "cast(array() as array<struct<token:string,kind:string,value:string>>) protected"
    segments = orders.selectExpr("o_orderkey page_id", "explode(array(struct('b' id, 'y' t), struct('a' id, 'x' || o_orderkey t))) s").selectExpr("page_id", "s.id id", "array('h') heading_path", empty, "'paragraph' semantic_type", "s.t source_text")
    terms = orders.selectExpr("o_orderkey page_id", "'t' term", "cast(o_custkey as string) gloss")
    return C.assignments(_zones(spark, sf), segments, terms, orders.selectExpr("o_orderkey page_id", "' s ' summary"))


_REVIEW = "o_orderkey % 6"


@query(f"""
SELECT o_orderkey AS page_id, k::INTEGER AS check_ord FROM orders, (VALUES (1), (3), (4), (5)) v(k) WHERE {_REVIEW} = k OR ({_REVIEW} = 3 AND k = 4 AND FALSE)
""")
def v10_reviews(spark, sf):
    """Retries, findings, their number and the derived list of unresolved items."""
    orders = table(spark, sf, "orders")
    zones = _zones(spark, sf)
    dims = ", ".join(f"'{d}'" for d in C.DIMENSIONS)
    findings = orders.selectExpr("o_orderkey page_id", "'zone-001' zone_id", f"posexplode(array({dims})) as (n, dimension)", f"{_REVIEW} k")
    findings = findings.where("not (k = 4 and n = 0)").selectExpr("page_id", "zone_id", "dimension", "case when n = 1 then 'required-fix' else 'pass' end verdict", "case when k = 3 and n = 2 then ' ' else 'seen' end evidence")
    retries = orders.selectExpr("o_orderkey page_id", "'zone-001' zone_id", f"case when {_REVIEW} = 1 then 3 else 2 end n")
    unresolved = orders.selectExpr("o_orderkey page_id", f"case when {_REVIEW} = 5 then array('zone-001:x') else array('zone-001:{C.DIMENSIONS[1]}') end items")
    return C.review_errors(zones, findings, retries, unresolved).select("page_id", "check_ord")


# ---- records

_LINES = """case o_orderkey % 6 when 0 then '{"segment_id":"a","text":"x' || o_orderkey || '"}' when 1 then '{"segment_id":1,"text":"x"}' when 2 then '{"segment_id":"a","text":["x"]}'
 when 3 then 'no json' when 4 then '{"segment_id":"a","text":"x","notes":null,"glossary_observations":{"k":1}}' else '{"segment_id":"a","text":"x","notes":7}' end"""


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'segment_id must be a string' WHEN 2 THEN 'text must be a string' WHEN 3 THEN 'line must be valid JSON'
  WHEN 4 THEN 'glossary_observations must be an object' ELSE 'notes must be a string' END AS error,
  CASE WHEN o_orderkey % 6 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 6 IN (1, 4, 5) THEN 'x' END AS text FROM orders
""")
def s09_strict_records(spark, sf):
    """Records with wrong types are told apart, not coerced."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey id", f"{_LINES} line")
    return R.checked(rows, R.TRANSLATION).select("id", "error", "record.text")


@query("""SELECT '{"id":' || doc_id || ',"lang":"' || lang || '","missing":null}' AS value FROM documents""")
def s08_json_lines(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id id", "lang", "cast(null as string) missing")
    return R.json_lines(rows, ["id", "lang", "missing"], ["id"])


@query("SELECT o_orderkey AS page_id, term, gloss FROM orders, (VALUES ('x', '가'), ('y', '나')) v(term, gloss)")
def s14_glossary(spark, sf):
    lines = table(spark, sf, "orders").selectExpr("o_orderkey page_id", """'{"x":"가","y":"나"}' json""")
    return R.glossary_rows(lines)


@query("""SELECT n, CASE WHEN z.zone SIMILAR TO 'zone-[0-9]{3,}' THEN substr(z.zone, 6)::INTEGER END AS ordinal FROM (SELECT unnest(range(1, 1201)) AS n), LATERAL (SELECT CASE WHEN n % 50 = 0 THEN 'zone-' || n ELSE printf('zone-%03d', n) END AS zone) z""")
def s11_zone_order(spark, sf):
    rows = spark.range(1, 1201).selectExpr("id n", "case when id % 50 = 0 then 'zone-' || id else format_string('zone-%03d', id) end zone")
    return rows.select("n", R.zone_ordinal(F.col("zone")).alias("ordinal"))


# ---- terminology


def _terms(spark, sf):
    return table(spark, sf, "nation").selectExpr("n_regionkey page_id", "'w' || n_nationkey term", "'가' || n_nationkey gloss")


@query("""SELECT n_regionkey AS page_id, 'w' || n_nationkey AS term, row_number() OVER (PARTITION BY n_regionkey ORDER BY length('w' || n_nationkey) DESC, 'w' || n_nationkey)::INTEGER AS ord FROM nation""")
def o02_term_order(spark, sf):
    return T.ordered_terms(_terms(spark, sf)).select("page_id", "term", "ord")


@query("""
WITH t AS (SELECT o_custkey % 5 AS page_id, o_orderkey AS seg_ord, 'w' || (o_orderkey % 40) AS a, 'w' || (o_custkey % 40) AS b FROM orders),
     u AS (SELECT page_id, seg_ord, 0 AS ord, a AS term FROM t UNION ALL SELECT page_id, seg_ord, 1, b FROM t),
     k AS (SELECT u.* FROM u JOIN nation ON n_regionkey = page_id AND term = 'w' || n_nationkey),
     f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id, term ORDER BY seg_ord, ord) = 1)
SELECT page_id, seg_ord, term FROM f
""")
def w11_first_use(spark, sf):
    """Where each term of a page is used first."""
    rows = table(spark, sf, "orders").selectExpr("o_custkey % 5 page_id", "o_orderkey seg_ord", "'s' || o_orderkey segment_id", "'use w' || (o_orderkey % 40) || ' and w' || (o_custkey % 40) text")
    empty = rows.selectExpr("page_id", "segment_id id", "cast(array() as array<struct<token:string,kind:string,value:string>>) protected")
    scanned = T.scanned(rows, _terms(spark, sf), empty)
    return T.first_uses(scanned, _terms(spark, sf)).select("page_id", F.col("seg_ord").cast("bigint").alias("seg_ord"), "term")


@query("""
WITH t AS (SELECT o_orderkey AS page_id, v.* FROM orders, (VALUES (1, 'Spring and Boot'), (2, 'Boot(부트) again')) v(seg_ord, text))
SELECT page_id, seg_ord::INTEGER AS seg_ord, CASE seg_ord WHEN 1 THEN 'Spring(스프링) and Boot(부트)' ELSE 'Boot again' END AS text FROM t
""")
def w12_glosses(spark, sf):
    """One gloss per term and page at its first use; glosses that stand elsewhere go."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey page_id", "explode(array(struct(1 n, 'Spring and Boot' t), struct(2 n, 'Boot(부트) again' t))) x").selectExpr("page_id", "x.n seg_ord", "'s' || x.n segment_id", "x.t text")
    terms = table(spark, sf, "orders").selectExpr("o_orderkey page_id", "explode(map('Spring', '스프링', 'Boot', '부트')) as (term, gloss)")
    empty = rows.selectExpr("page_id", "segment_id id", "cast(array() as array<struct<token:string,kind:string,value:string>>) protected")
    return T.normalize_first_use(rows, terms, empty).select("page_id", "seg_ord", "text")


@query("""SELECT o_orderkey AS page_id FROM orders WHERE o_orderkey % 6 <> 0""")
def v19_glossary_errors(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey page_id", "case o_orderkey % 6 when 1 then ' t' when 2 then '' else 't' end term", "case o_orderkey % 6 when 3 then 'latin' when 4 then '가(나)' when 5 then null else '가' end gloss")
    return T.glossary_errors(rows).select("page_id")
