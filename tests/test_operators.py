"""Operators over small tables."""

import random

import pytest

from pagemill.contract import ZoneError
from pagemill.operators import nodes as N
from pagemill.operators import qa as Q
from pagemill.operators import segments as S
from pagemill.operators import zones as Z
from pagemill.plans.pages import extract, translate
from pagemill.sources import bundle, records

SEGMENTS = "page_id long, seg_ord int, id string, semantic_type string, heading_path array<string>, source_text string, protected array<struct<token:string,kind:string,value:string>>, target boolean"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "https://e.com/p", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_heading_paths(spark):
    df = pages(spark, "<h1>One</h1><h3>Three</h3><h2>Two</h2><p>Body</p><h1>Next</h1>")
    rows = S.targets(N.dom_nodes(df)).orderBy("seg_ord").collect()
    assert [r.heading_path for r in rows] == [[], ["One"], ["One"], ["One", "Two"], []]


def test_nested_tables_and_attributes(spark):
    df = pages(spark, '<table><tr><td>x<table><tr><th>h</th><td>c</td></tr></table></td></tr></table><img alt="pic" title="t" aria-label="al">')
    rows = extract(df).segments.orderBy("seg_ord").collect()
    assert [r.semantic_type for r in rows] == ["table_cell:row:000001", "table_header:row:000002", "table_cell:row:000002", "located:attributes"]
    assert [t.kind for t in rows[3].protected] == ["location"] * 3
    assert [t.kind for t in rows[0].protected].count("segment") == 2


def test_empty_and_null_pages(spark):
    df = pages(spark, None, "", "<p>   </p><code>x</code>")
    assert extract(df).segments.count() == 0
    assert N.dom_nodes(df.limit(0)).count() == 0


def _plan(spark, rows, limit=12000, zones=None):
    df = spark.createDataFrame([(1, i, f"s{i}", t, ["h"], "x" * n, [], own) for i, (t, n, own) in enumerate(rows, 1)], SEGMENTS)
    return [(r.target_ids, r.context_before_ids, r.context_after_ids) for r in Z.plan(df, limit, zones).orderBy("zone_ord").collect()]


def test_zone_goldens(spark):
    found = _plan(spark, [("heading", 7000, True), ("heading", 7000, True), ("heading", 2000, True)])
    assert [f[0] for f in found] == [["s1"], ["s2", "s3"]] and found[1][1] == []
    context = _plan(spark, [("p", 1, False)] * 2 + [("p", 1, True)] + [("p", 1, False)] * 2, 5)
    assert context == [(["s3"], ["s1", "s2"], ["s4", "s5"])]
    rows = _plan(spark, [("table_cell:row:000001", 3, True)] * 2 + [("table_cell:row:000002", 3, True)] * 2, 6)
    assert [f[0] for f in rows] == [["s1", "s2"], ["s3", "s4"]]
    big = _plan(spark, [("heading", 10, True)] + [("p", 12000, True)] * 20)
    assert len(big) == 21


@pytest.mark.parametrize(("limit", "zones"), [(0, None), (True, None), (10, 0), (10, 65)])
def test_zone_parameters(limit, zones):
    with pytest.raises(ZoneError):
        Z.check_parameters(limit, zones)


def _round(spark, html, change=lambda t: t):
    df = pages(spark, html)
    done = extract(df)
    texts = spark.createDataFrame([(r.page_id, r.id, change(r.source_text)) for r in done.segments.collect()], "page_id long, segment_id string, text string")
    none = spark.createDataFrame([], "page_id long, term string, gloss string")
    return translate(df, done, texts, none, spark.createDataFrame([], "page_id long, items array<string>"))


def test_unchanged_page_passes(spark):
    out = _round(spark, "<h1>T</h1><p>You MUST run <code>x</code> at https://e.com/a.</p><ul><li>a<ul><li>b</li></ul></li></ul><a href='#t' id='t'>l</a>")
    assert out.gates.first().passed and out.output.first().error is None


def test_changed_page_is_found(spark):
    out = _round(spark, "<p>You MUST go.</p>", lambda t: t.replace("⟦WT:000000⟧", "must"))
    assert not out.gates.first().passed and "exactly once" in out.output.first().error


def test_paths(spark):
    rows = spark.createDataFrame([("a/../b",), ("../x",), ("/abs",), ("./a//b",), ("a/../../b",)], "p string")
    assert [r[0] for r in rows.select(Q.normal_path(rows.p)).collect()] == ["b", None, None, "a/b", None]


def test_stage_tables(spark, tmp_path):
    df = spark.range(100).selectExpr("id page_id", "'x' || id v")
    bundle.write_stage(df, str(tmp_path), "segments", 8)
    back = spark.read.parquet(f"{tmp_path}/segments")
    assert bundle.page_of(back, 42, 8).select("v").collect()[0][0] == "x42" and back.count() == 100
    with pytest.raises(Exception, match="exists"):
        bundle.write_stage(df, str(tmp_path), "segments", 8)


def test_bundles_and_fingerprints(spark, tmp_path):
    out = _round(spark, "<p>x</p>").output
    written = bundle.write_pages(out, str(tmp_path / "out")).collect()
    assert written[0].path == "0/index.html" and (tmp_path / "out/0/index.html").stat().st_size == written[0].bytes
    found = bundle.fingerprints(spark, str(tmp_path / "out/0/index.html"))
    changed = found.selectExpr("path", "'0' sha256")
    assert bundle.changed_files(changed, found).first().problem == "changed"


def test_zone_files(spark, tmp_path):
    (tmp_path / "zone-001.jsonl").write_text('{"segment_id":"a","text":"x"}\n\n{"segment_id":"b","text":1}\n')
    sound, broken = records.read_translations(spark, str(tmp_path))
    assert [(r.zone_id, r.segment_id) for r in sound.collect()] == [("zone-001", "a")]
    assert broken.first().error == "text must be a string"


def test_stream(spark, tmp_path):
    from pagemill.streaming.validation import validate_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "7_zone-001.jsonl").write_text('{"segment_id":"a","text":"x"}')
    (folder / "8_zone-001.jsonl").write_text('{"segment_id":"b","text":"x"}')
    zones = spark.createDataFrame([(p, 1, "zone-001", ["a"], {"a": []}) for p in (7, 8)], "page_id long, zone_ord int, id string, target_ids array<string>, expected_tokens map<string,array<string>>")
    segments = spark.createDataFrame([(p, "a", []) for p in (7, 8)], "page_id long, id string, protected array<struct<token:string,kind:string,value:string>>")
    seen = []
    query = validate_stream(spark, str(folder), zones, segments, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert {(r.page_id, r.ok) for r in seen} == {(7, True), (8, False)}


def test_page_source(spark):
    from pagemill.sources.pages import register

    register(spark)
    rows = spark.read.format("pagemill-pages").option("urls", "https://e.com/\nhttp://127.0.0.1/").option("fetcher", "tests.fetcher:fetch").load().orderBy("page_id").collect()
    assert rows[0].html == "<p>https://e.com/</p>" and rows[1].error == "non-public IP URLs are not allowed"


def test_one_pass_tells_what_the_operators_tell(spark):
    """Segments and marked pages from one tree are those of the node table, its windows and joins."""
    rnd = random.Random(4)
    tags = ["h1", "h2", "h3", "h6", "p", "div", "ul", "li", "table", "tr", "td", "th", "a", "code", "span", "section", "button", "svg", "pre"]

    def piece(depth):
        if depth == 0 or rnd.random() < 0.25:
            return rnd.choice(["word", " ", "You MUST go", "https://e.com/a.", "<br>", "<img alt='pic' title=''>", "<!--c-->", "&lt;b&gt;", "<input placeholder='p'>"])
        tag, off = rnd.choice(tags), rnd.choice(["", "", "", "", ' translate="no"', ' title="t"', ' data-wt-segment="x"'])
        return f"<{tag}{off}>" + "".join(piece(depth - 1) for _ in range(rnd.randint(0, 4))) + (f"</{tag}>" if rnd.random() < 0.95 else "")

    htmls = [None, "", "<td>x</td>", "<h2></h2><p>a</p>", "<tr translate=no><td>x</td></tr><tr><td>y</td></tr>", "<h1 translate=no>A</h1><h3>C</h3><h2>B</h2><p title=t>p</p>"]
    df = pages(spark, *htmls, *("".join(piece(4) for _ in range(5)) for _ in range(150)))
    done, nodes = extract(df), N.dom_nodes(df).cache()
    want, columns = S.extract(df, nodes), done.segments.columns
    assert want.columns == columns and want.count() > 500
    assert sorted(map(str, done.segments.collect())) == sorted(map(str, want.collect()))
    assert sorted(done.marked.collect()) == sorted(S.mark_pages(df, S.targets(nodes)).select("page_id", "html").collect())


def test_output_alone_builds_no_findings(spark, monkeypatch):
    """Pages are assembled without a search for findings; that runs when findings or gates are read."""
    monkeypatch.setattr(Q, "structure", lambda *_: pytest.fail("findings were searched"))
    assert _round(spark, "<p>one</p>").output.first().error is None
