import hashlib
import random

import pytest

from pagemill.llm import warc


class Held:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_damage_costs_only_damaged_records(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    rnd = random.Random(chunk)
    for _ in range(150):
        parts, bad = [], set(rnd.sample(range(10), rnd.randint(0, 4)))
        payloads = [bytes(rnd.choice(b"ab\r\nWARC/1.1\x1f\x8b\x08") for _ in range(rnd.randint(0, 300))) for _ in range(10)]
        for i, p in enumerate(payloads):
            data = warc.record_bytes(i, "http://x/ y", p, hashlib.sha256(p).hexdigest(), len(p), None, "d")
            data = data if rnd.random() < 0.3 else warc.member(data)
            if i in bad:
                at, kind = rnd.randrange(len(data)), rnd.randrange(3)
                data = data[:at] if kind == 0 else data[:at] + bytes([data[at] ^ 1 << rnd.randrange(8)]) + data[at + 1 :] if kind == 1 else b"junk" * rnd.randint(1, 9) + data[3:]
            parts.append(data)
        found = list(warc.records(warc.Bytes(Held(b"".join(parts)))))
        at = 0
        for x in found:
            assert x.offset == at
            at += x.length
        assert at == sum(map(len, parts))
        got = {x.headers.get("warc-record-id"): x.payload for x in found if isinstance(x, warc.Record)}
        for i, p in enumerate(payloads):
            assert i in bad or got[f"<urn:page:{i}>"] == p


def test_round_trip(spark):
    big = "x" * 150 + "é"
    rows = [(1, "http://a/", big), (2, "http://b/ c\r\nd", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", big), (1, "http://a/", big)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)

    def want(i, html):
        data = (html or "").encode()
        revisit = len(data) >= 100 and i not in (1, None)
        return (i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None)

    assert got == sorted((want(i, h) for i, _, h in rows), key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_gaps_are_logged(spark, tmp_path):
    good = [warc.member(warc.record_bytes(i, "u", b"p", hashlib.sha256(b"p").hexdigest(), 1, None, "d")) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(good[0] + good[1][:-9] + good[2])
    rows = warc.read(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "uri string")).orderBy("offset").collect()
    assert [r.gap is None for r in rows] == [True, False, True] and rows[1].length == len(good[1]) - 9
    assert bytes(rows[2].payload) == b"p"


LONG = "http://a/" + " " * 30_000 + "x" * 200_000


@pytest.mark.parametrize("url", [LONG, "http://a/WARC/1.1", "WARC/1.0"])
@pytest.mark.parametrize("pack", [bytes, warc.member])
@pytest.mark.parametrize("read", [64, 1 << 16])
def test_any_url_is_read_back(monkeypatch, url, pack, read):
    monkeypatch.setattr(warc, "HEADER_READ", read)
    digest = hashlib.sha256(b"p").hexdigest()
    data = [pack(warc.record_bytes(i, url, b"p" if i else None, digest, 1, None if i else 1, "d")) for i in range(3)]
    found = list(warc.records(warc.Bytes(Held(b"".join(data)))))
    assert [x.headers["warc-target-uri"] for x in found] == [url.replace(" ", "%20")] * 3
    # without its first byte a record is a gap, whatever its url ends like
    found = list(warc.records(warc.Bytes(Held(data[0][1:] + data[1]))))
    assert [type(x) for x in found] == [warc.Gap, warc.Record] and found[1].headers["warc-record-id"] == "<urn:page:1>"


def test_round_trip_of_any_url(spark):
    big = "x" * 150
    rows = [(1, LONG, big), (2, "http://b/WARC/1.1", big), (3, "http://c/WARC/1.0", "short")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]


def test_round_trip_fails_on_a_gap(spark, monkeypatch):
    monkeypatch.setattr(warc, "member", lambda data: data[:-9])
    with pytest.raises(Exception, match="gap in an archive"):
        warc.round_trip(spark.createDataFrame([(1, "u", "p")], "page_id long, url string, html string")).collect()
