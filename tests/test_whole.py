"""Queries over all orders and line items, whole."""

import pytest

from pagemill import queries
from tests.compare import SF

QUERIES, _ = queries.load()
EVERY_ORDER = ("r08_table_rows", "w01_heading_paths", "w02_neighbours", "r02_segments", "p09_reserved_spellings", "j09_ancestors", "p04_excluded", "t12_assembly_errors", "j05_unresolved_anchors", "a08_dependencies", "streaming_zone_status", "r22_page_references", "s14_glossary", "w12_glosses")


@pytest.mark.parametrize("name", EVERY_ORDER)
def test_every_order_is_built(spark, name):
    orders = {r.o_orderkey for r in queries.table(spark, SF, "orders").select("o_orderkey").collect()}
    assert {r.page_id for r in QUERIES[name](spark, SF).select("page_id").collect()} == orders


def test_every_line_is_zoned(spark):
    lines = queries.table(spark, SF, "lineitem")
    targets = lines.where("l_suppkey % 5 <> 0").count()
    assert targets > lines.dropDuplicates(["l_orderkey", "l_linenumber"]).where("l_suppkey % 5 <> 0").count()
    assert QUERIES["w03_sections"](spark, SF).count() == targets
    assert QUERIES["j01_zone_targets"](spark, SF).count() == targets
    balanced = QUERIES["w06_balanced_zones"](spark, SF).selectExpr("explode(split(targets, ',')) t")
    assert balanced.count() == targets
    assert QUERIES["a04_partition_errors"](spark, SF).count() == 0
