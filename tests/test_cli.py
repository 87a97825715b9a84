import json

from pagemill import cli
from pagemill.operators.contracts import DIMENSIONS


def test_commands(spark, tmp_path, capsys):
    run = str(tmp_path / "run")

    def call(*argv):
        code = cli.main([*argv, "--run-dir", run], spark)
        line = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert line["exit_code"] == code and line["command"] == argv[0]
        return code

    def table(name, rows, schema):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(path)
        return path

    pages = table("pages", [(1, "https://e.com/p", "<h1>T</h1><p>You MUST go.</p>")], "page_id long, url string, html string")
    glossary = table("glossary", [(1, "go", "가다")], "page_id long, term string, gloss string")
    summaries = table("summaries", [(1, "A page.")], "page_id long, summary string")
    assert call("capture", "--pages", pages, "--captured-at", "2024-01-01T00:00:00Z") == 0
    assert call("extract") == 0
    assert call("plan-zones", "--max-chars", "100") == 0
    assert call("prepare-assignments", "--glossary", glossary, "--summaries", summaries) == 0
    rows = [(1, "zone-001", "seg-000001", "T"), (1, "zone-001", "seg-000002", "You ⟦WT:000000⟧ go.")]
    good = table("good", rows, "page_id long, zone_id string, segment_id string, text string")
    bad = table("bad", rows[:1], "page_id long, zone_id string, segment_id string, text string")
    assert call("validate-translations", "--translations", bad) == cli.CONTRACT
    assert call("validate-translations", "--translations", good, "--zone-id", "zone-001") == 0
    assert call("validate-translations", "--translations", good) == 0
    assert call("assemble", "--translations", good, "--glossary", glossary, "--output-dir", str(tmp_path / "out")) == 0
    assert "You MUST go(가다)." in (tmp_path / "out/1/index.html").read_text()
    qa = ("qa", "--translations", good, "--glossary", glossary, "--output-dir", str(tmp_path / "out"))
    assert call(*qa) == 0
    done = json.loads(spark.read.parquet(f"{run}/manifests").first().json)
    assert done["qa_status"] == "passed" and done["coverage"] == {"segments": 2, "target_segments": 2, "translated_segments": 2, "zones": 1}
    # an item that the review leaves open fails the command
    left = table("left", [(1, [f"zone-001:{DIMENSIONS[0]}"])], "page_id long, items array<string>")
    noted = [(1, "zone-001", d, "pass" if i else "required-fix", "seen") for i, d in enumerate(DIMENSIONS)]
    noted = table("noted", noted, "page_id long, zone_id string, dimension string, verdict string, evidence string")
    assert call(*qa, "--review", left, "--findings", noted) == cli.QA
    assert json.loads(spark.read.parquet(f"{run}/manifests").first().json)["qa_status"] == "failed"
    assert "FAIL" in spark.read.parquet(f"{run}/reports").first().markdown
    assert call(*qa, "--findings", noted) == cli.CONTRACT


def test_bad_arguments(capsys):
    assert cli.main(["plan-zones"]) == cli.ARGUMENTS
    assert json.loads(capsys.readouterr().out)["status"] == "error"


def test_login_page(spark, tmp_path, capsys):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "https://e.com/", "<input type=password>")], "page_id long, url string, html string").write.parquet(path)
    assert cli.main(["capture", "--pages", path, "--captured-at", "x", "--run-dir", str(tmp_path / "r")], spark) == cli.CAPTURE
