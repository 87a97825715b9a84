"""Sections, units, zones and their neighbours over a table of segments made from line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import zones as Z
from pagemill.queries import query, table

#: Segments: a page per order, a segment per line (numbered anew, as keys repeat); every fourth line number a heading, some lines in table rows.
_SEG = """l_orderkey page_id, l_linenumber seg_ord, 's' || l_linenumber id,
 case when l_linenumber % 4 = 1 then 'heading' when l_partkey % 3 = 0 then 'table_cell:row:00000' || (l_linenumber % 2) else 'paragraph' end semantic_type,
 repeat('x', cast(1 + l_partkey % 40 as int)) source_text, l_suppkey % 5 <> 0 target"""
_DUCK = """seg AS (SELECT l_orderkey AS page_id, l_linenumber AS seg_ord, 's' || l_linenumber AS id,
 CASE WHEN l_linenumber % 4 = 1 THEN 'heading' WHEN l_partkey % 3 = 0 THEN 'table_cell:row:00000' || (l_linenumber % 2) ELSE 'paragraph' END AS semantic_type,
 (1 + l_partkey % 40)::INTEGER AS n, l_suppkey % 5 <> 0 AS target
 FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_linenumber) FROM lineitem))"""
_SECT = """h AS (SELECT *, count(*) FILTER (semantic_type = 'heading') OVER (PARTITION BY page_id ORDER BY seg_ord) AS hn FROM seg),
 t AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY hn) AS section FROM h WHERE target)"""
_UNIT = """p AS (SELECT *, row_number() OVER (PARTITION BY page_id, section ORDER BY seg_ord) AS spot, CASE WHEN semantic_type LIKE 'table_cell:row:%' THEN semantic_type END AS key FROM t),
 e AS (SELECT *, CASE WHEN key IS NOT NULL AND spot = min(spot) OVER (PARTITION BY page_id, section, key) THEN max(spot) OVER (PARTITION BY page_id, section, key) ELSE spot END AS reach FROM p),
 g AS (SELECT *, CASE WHEN spot <= coalesce(max(reach) OVER (PARTITION BY page_id, section ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 0 ELSE 1 END AS new FROM e),
 u AS (SELECT *, sum(new) OVER (PARTITION BY page_id, section ORDER BY spot) AS unit FROM g)"""
_LIMIT = 60
_PACK = f"""s AS (SELECT *, sum(n) OVER (PARTITION BY page_id, section) AS whole FROM u),
 i AS (SELECT page_id, section, CASE WHEN whole <= {_LIMIT} THEN 0 ELSE unit END AS part, sum(n) AS n FROM s GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY section, part) AS item FROM i),
 z AS (SELECT page_id, item, section, part, n AS fill, 1 AS zone FROM o WHERE item = 1
       UNION ALL SELECT o.page_id, o.item, o.section, o.part, CASE WHEN z.fill + o.n > {_LIMIT} THEN o.n ELSE z.fill + o.n END, z.zone + CASE WHEN z.fill + o.n > {_LIMIT} THEN 1 ELSE 0 END
       FROM z JOIN o ON o.page_id = z.page_id AND o.item = z.item + 1)"""


def _numbered(rows):
    """Every line, with a number of its own within its order; rows that tie are equal in all columns read."""
    return rows.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))


def _segments(spark, sf):
    token = "array(named_struct('token', '⟦WT:000000⟧', 'kind', 'url', 'value', id)) protected"
    return _numbered(table(spark, sf, "lineitem")).selectExpr(*[x.strip() for x in _split(_SEG)]).selectExpr("*", "array('h') heading_path", token)


def _split(text: str) -> list[str]:
    """Top-level columns of a select list."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


@query(f"WITH {_DUCK}, {_SECT} SELECT page_id, seg_ord, section::INTEGER AS section FROM t")
def w03_sections(spark, sf):
    return Z.sections(_segments(spark, sf)).select("page_id", "seg_ord", "section")


@query(f"WITH {_DUCK}, {_SECT}, {_UNIT} SELECT page_id, seg_ord, section::INTEGER AS section, unit::BIGINT AS unit FROM u")
def w04_atomic_units(spark, sf):
    return Z.units(Z.sections(_segments(spark, sf))).select("page_id", "seg_ord", "section", "unit")


@query(f"WITH RECURSIVE {_DUCK}, {_SECT}, {_UNIT}, {_PACK} SELECT page_id, item::INTEGER AS item, zone::INTEGER AS zone FROM z")
def w05_greedy_pack(spark, sf):
    """Greedy packing in built-in functions."""
    return Z.greedy_sql(Z.items(Z.units(Z.sections(_segments(spark, sf))), _LIMIT, atomic=False), _LIMIT).select("page_id", "item", "zone")


_ZONES = f"WITH RECURSIVE {_DUCK}, {_SECT}, {_UNIT}, {_PACK}, a AS (SELECT u.*, z.zone FROM u JOIN z ON u.page_id = z.page_id AND u.section = z.section AND (z.part = 0 OR z.part = u.unit))"


@query(_ZONES + """ SELECT page_id, printf('zone-%03d', zone) AS zone_id, string_agg(id, ',' ORDER BY seg_ord) AS targets, sum(n)::BIGINT AS chars FROM a GROUP BY page_id, zone""")
def w09_zones(spark, sf):
    """Zones with their targets in order; sections stay whole where they fit."""
    segments = _segments(spark, sf)
    planned = Z.plan(segments, _LIMIT)
    sizes = Z.zone_targets(planned).join(segments.select("page_id", F.col("id").alias("segment_id"), F.length("source_text").alias("n")), ["page_id", "segment_id"]).groupBy("page_id", "zone_id").agg(F.sum("n").alias("chars"))
    return planned.select("page_id", F.col("id").alias("zone_id"), F.array_join("target_ids", ",").alias("targets")).join(sizes, ["page_id", "zone_id"])


@query(_ZONES + f""",
 n2 AS (SELECT *, lag(id, 1) OVER w AS b1, lag(n, 1) OVER w AS bn1, lag(id, 2) OVER w AS b2, lag(n, 2) OVER w AS bn2,
               lead(id, 1) OVER w AS a1, lead(n, 1) OVER w AS an1, lead(id, 2) OVER w AS a2, lead(n, 2) OVER w AS an2 FROM seg WINDOW w AS (PARTITION BY page_id ORDER BY seg_ord)),
 f AS (SELECT page_id, zone, {_LIMIT} - sum(n) AS budget, min(seg_ord) AS first, max(seg_ord) AS last FROM a GROUP BY page_id, zone),
 c AS (SELECT f.*, x.b1, x.bn1, x.b2, x.bn2, y.a1, y.an1, y.a2, y.an2 FROM f JOIN n2 x ON x.page_id = f.page_id AND x.seg_ord = f.first JOIN n2 y ON y.page_id = f.page_id AND y.seg_ord = f.last),
 c1 AS (SELECT *, coalesce(budget > 0 AND bn1 <= budget, FALSE) AS t1, budget - CASE WHEN budget > 0 AND bn1 <= budget THEN bn1 ELSE 0 END AS l1 FROM c),
 c2 AS (SELECT *, coalesce(budget > 0 AND an1 <= l1, FALSE) AS t2, l1 - CASE WHEN budget > 0 AND an1 <= l1 THEN an1 ELSE 0 END AS l2 FROM c1),
 c3 AS (SELECT *, coalesce(budget > 0 AND bn2 <= l2, FALSE) AS t3, l2 - CASE WHEN budget > 0 AND bn2 <= l2 THEN bn2 ELSE 0 END AS l3 FROM c2),
 c4 AS (SELECT *, coalesce(budget > 0 AND an2 <= l3, FALSE) AS t4 FROM c3)
 SELECT page_id, printf('zone-%03d', zone) AS zone_id, concat_ws(',', CASE WHEN t3 THEN b2 END, CASE WHEN t1 THEN b1 END) AS before, concat_ws(',', CASE WHEN t2 THEN a1 END, CASE WHEN t4 THEN a2 END) AS after FROM c4""")
def w10_context(spark, sf):
    """Read-only neighbours, nearest first, as far as the budget goes."""
    planned = Z.plan(_segments(spark, sf), _LIMIT)
    return planned.select("page_id", F.col("id").alias("zone_id"), F.array_join("context_before_ids", ",").alias("before"), F.array_join("context_after_ids", ",").alias("after"))


@query()
def w06_balanced_zones(spark, sf):
    """Three zones as even as can be; held to goldens and invariants in the tests."""
    planned = Z.plan(_segments(spark, sf), 200, 3)
    return planned.select("page_id", F.col("id").alias("zone_id"), F.array_join("target_ids", ",").alias("targets"))


@query(f"WITH {_DUCK} SELECT page_id FROM seg WHERE target GROUP BY page_id HAVING page_id % 5 = 0 OR page_id % 5 = 1 AND count(*) > 1")
def a04_partition_errors(spark, sf):
    """Pages whose zones aren't an exact partition of the targets: one lost, or two in the wrong order; all others are."""
    segments = _segments(spark, sf)
    broken = F.expr("case when page_id % 5 = 0 and zone_ord = 1 then slice(target_ids, 2, size(target_ids)) else target_ids end")
    turned = F.when(F.col("page_id") % 5 == 1, -F.col("zone_ord")).otherwise(F.col("zone_ord"))
    planned = Z.plan(segments, _LIMIT).select("page_id", turned.alias("zone_ord"), F.when(F.col("page_id") % 5 == 1, F.reverse("target_ids")).otherwise(broken).alias("target_ids"))
    return Z.partition_errors(segments, planned)


@query(f"""WITH {_DUCK}, {_SECT}, {_UNIT} SELECT page_id, min(seg_ord) AS first FROM u GROUP BY page_id, section, unit HAVING sum(n) > 50""")
def v05_oversized_units(spark, sf):
    return Z.oversized(Z.units(Z.sections(_segments(spark, sf))), 50).select("page_id", "first")


@query("SELECT l_orderkey AS page_id, 's' || l_linenumber AS id FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a01_duplicate_ids(spark, sf):
    return Z.duplicate_ids(table(spark, sf, "lineitem").selectExpr("l_orderkey page_id", "'s' || l_linenumber id"))


@query(_ZONES + """ SELECT page_id, printf('zone-%03d', zone) AS zone_id, id AS segment_id, (row_number() OVER (PARTITION BY page_id, zone ORDER BY seg_ord) - 1)::INTEGER AS pos FROM a""")
def j01_zone_targets(spark, sf):
    return Z.zone_targets(Z.plan(_segments(spark, sf), _LIMIT)).select("page_id", "zone_id", "segment_id", "pos")
