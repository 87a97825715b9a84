import collections
import random

import pytest

from pagemill.llm import langid

SF = "/root/testdata/sf0.01"


def brute(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    out = collections.Counter()
    for w in filter(None, low.split(" ")):
        p = "\0" + w + "\0"
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = [ord(c) for c in p[i : i + n]]
                if g != [0]:
                    out[g[0] << 42 if n == 1 else (g[0] << 42 | g[1] << 21 | 1 << 63) if n == 2 else g[0] << 42 | g[1] << 21 | g[2]] += 1
    return out


@pytest.mark.parametrize("piece", [1 << 20, 1, 2, 3, 5])
def test_counts(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rnd = random.Random(piece)
    for _ in range(200):
        text = "".join(rnd.choice("aBcÉß 1,\n한😀") for _ in range(rnd.randint(0, 25)))
        keys, counts = langid.count_ngrams(text)
        assert dict(zip(keys.tolist(), counts.tolist())) == brute(text)


def test_profiles_count_all_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 10)
    rows = [("de", "der die das und"), ("de", "und der"), ("en", "the of and"), (None, "x"), ("en", None)]
    got = langid.learn(spark.createDataFrame(rows, "lang string, text string"), size=15)
    for lang in ("de", "en"):
        total = sum((brute(t) for k, t in rows if k == lang and t), collections.Counter())
        assert got[lang].tolist() == [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:15]]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (langid.fold_of(r.doc_id) == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_defined_cases(spark):
    rows = [(i, "the of and to in is", "en") for i in range(9)] + [(50, None, "en"), (51, "12 !", None), (None, "the", "xx"), (52, "", "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and got[50].score == 0 and not got[None].held_out and got[None].lang_pred == "en"
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.count() == 10
    none = spark.createDataFrame([], df.schema)
    assert langid.identify(none).count() == 0


def brute_predictions(docs, size=400):
    """Language and score of each text, by the definition: out-of-place distance of ranked n-grams."""

    def ranked(counts):
        return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}

    counted = {}
    for i, text, lang in docs:
        if i is not None and langid.fold_of(i) != 1 and lang is not None and text is not None:
            counted.setdefault(lang, collections.Counter()).update(brute(text))
    profiles = {lang: ranked(c) for lang, c in counted.items() if c}
    wide = max(map(len, profiles.values()))
    out = []
    for i, text, _ in docs:
        own = {g: r for r, (g, _) in enumerate(sorted(brute(text or "").items(), key=lambda x: (-x[1], x[0]))[:wide])}
        away = {lang: sum(abs(p[g] - r) if g in p else wide for g, r in own.items()) for lang, p in sorted(profiles.items())}
        best = min(away, key=lambda k: away[k])
        out.append((i, best, round(1 - away[best] / (len(own) * wide), 9)) if own else (i, "und", 0.0))
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [1000, 2])
def test_predictions_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(langid, "LANGUAGES", at_once)
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(9000 + i, f"zu{i} ka{i % 3}", f"l{i % 7}") for i in range(30)] + [(None, "the", "en"), (9100, None, "en"), (9101, "12", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(df).collect()), key=str)
    assert got == brute_predictions(docs)


def test_stage_rejects_what_is_in_no_language(spark):
    rnd = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(100_000 + i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(200)), None, "p", 1) for i in range(20)]
    junk += [(200_000, "你好世界" * 30, None, "p", 1), (200_001, "12 34", None, "p", 1)]
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(spark.createDataFrame(junk, docs.schema))).select("doc_id").collect()}
    assert not kept & {r[0] for r in junk} and {r.doc_id for r in docs.where(r"text rlike '[\\p{L}]'").select("doc_id").collect()} <= kept
    some = {r.doc_id for r in langid.keep_known(docs, languages=["de"]).select("doc_id").collect()}
    german = {r.doc_id for r in docs.where("lang = 'de'").select("doc_id").collect()}
    assert len(some & german) > 0.98 * len(german) and len(some - german) < 0.02 * len(some)


def test_without_labels_every_text_with_a_letter_stays(spark):
    rows = [(i, "sound English letters", None, i) for i in range(50)] + [(60, "12", None, 1), (61, None, None, 1)]
    assert langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string, p int")).count() == 50
