"""Decontamination, mixing, licences."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, licences, mixing


def free(n):
    return 0 if n < 11 else 1 if n < 13 else n * 3 // 16


@pytest.mark.parametrize("n", range(7, 17))
def test_masks_hit_every_window(n):
    places = [{at + i for i in mask} for mask in decontaminate.MASKS for at in range(n - mask[-1])]
    for k in range(free(n) + 1):
        for wrong in itertools.combinations(range(n), k):
            assert any(not p & set(wrong) for p in places)


def brute_overlaps(docs, items):
    import re

    def tokens(t):
        return [x for x in re.split(r"[^\w]|_", (t or "").lower()) if x]

    out = {}
    for d, t in docs:
        w = tokens(t)
        for i, b in items:
            x = tokens(b)
            wide = min(16, len(x))
            for diagonal in range(-len(x), len(w)) if len(x) >= 7 else ():
                same = [0 <= diagonal + j < len(w) and w[diagonal + j] == x[j] for j in range(len(x))]
                if any(sum(same[s : s + wide]) >= wide - free(wide) for s in range(len(x) - wide + 1)):
                    out[d, i] = max(out.get((d, i), 0), sum(same))
    return out


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_TOKENS, 0])
def test_overlaps(spark, broadcast):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([8, 11, 13, 16, 20, 35])))) for i in range(12)] + [(90, "a b c"), (91, None)]
    docs = [(0, None), (1, ""), (2, "x")]
    for d in range(3, 60):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 50))]
        piece = rnd.choice(items[:12])[1].split(" ")
        for _ in range(rnd.randint(0, 4)):
            piece[rnd.randrange(len(piece))] = "changed"
        at = rnd.randint(0, len(body))
        docs.append((d, " ".join(body[:at] + [p.upper() + rnd.choice([",", "", "..."]) for p in piece] + body[at:])))
    docs += [docs[10], (None, docs[11][1])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, id int, h int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(df, bench, broadcast_tokens=broadcast).collect()}
    assert got == brute_overlaps(docs, items) and len(got) > 10
    kept = decontaminate.keep_clean(df, bench)
    held = {d for d, _ in brute_overlaps(docs, items)}
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in held), key=str)
    assert decontaminate.overlaps(df.limit(0), bench, broadcast_tokens=broadcast).count() == 0
    assert decontaminate.overlaps(df, bench.limit(0), broadcast_tokens=broadcast).count() == 0


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_TOKENS, 0])
def test_items_without_id(spark, broadcast):
    words = [f"w{i}" for i in range(60)]
    items = [(None, " ".join(words[:20])), (None, " ".join(words[20:30])), (1, " ".join(words[30:45]))]
    docs = [(1, "x " + items[0][1]), (2, items[1][1] + " y"), (3, items[2][1]), (4, "x y z " * 9), (None, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(df, bench, broadcast_tokens=broadcast).collect()}
    assert got == {(1, None): 20, (2, None): 10, (3, 1): 15, (None, None): 10} == brute_overlaps(docs, items)
    assert [r.doc_id for r in decontaminate.keep_clean(df, bench).collect()] == [4]


def _docs(spark, seed=1):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.randint(1, 30), rnd.choice("aaaaaaab") if i % 9 else "c") for i in range(300)]
    rows += [(400, None, "a"), (401, "", None), (402, "x y", None), (403, None, "empty"), (404, "z z", "a"), (404, "z z", "a")]
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, copies_of int")


def _totals(df):
    rows = df.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("copies")).alias("got")).collect()
    return {r.source: (r.t, r.got) for r in rows}


def test_total_budget(spark):
    totals = _totals(mixing.mix(_docs(spark), most_repeats=2.0, budget="total", block_tokens=50))
    have = {s: t for s, (t, _) in totals.items() if t}
    total = sum(have.values())

    def weights(a):
        z = sum((t / total) ** a for t in have.values())
        return {s: (t / total) ** a / z for s, t in have.items()}

    k = next(k for k in range((1 << 20) + 1) if max(weights(k / 2**20)[s] * total / t for s, t in have.items()) <= 2)
    for s, w in weights(k / 2**20).items():
        want = w * total
        assert want - 40 <= totals[s][1] <= want + 1e-3
    assert totals["empty"] == (0, 0)


def test_nothing_is_lost_without_budget(spark):
    df = _docs(spark)
    mixed = mixing.mix(df, most_repeats=1.5)
    assert mixed.columns == [*df.columns, "n_tokens", "copies"] and mixed.count() == df.count()
    assert mixed.agg(F.min("copies"), F.max("copies")).first() == (1, 2)
    for t, got in _totals(mixed).values():
        assert t <= got <= 1.5 * t + 1e-3
    assert {r.doc_id for r in mixing.realise(df).select("doc_id").collect()} == {r.doc_id for r in df.select("doc_id").collect()}


def test_target_entropy(spark):
    totals = _totals(mixing.mix(_docs(spark), most_repeats=None, least_entropy=1.0, budget=100_000, block_tokens=1000))
    got = [x for _, x in totals.values() if x]
    shares = [x / sum(got) for x in got]
    assert abs(-sum(p * math.log(p) for p in shares) - 1.0) < 0.01


def test_empty_mix(spark):
    assert mixing.mix(_docs(spark).limit(0)).count() == 0


def test_licences(spark):
    mit = licences.TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ;")), (2, mit + " more"), (3, "Prose.\n  Released under the MIT Licence!\nMore."), (4, None), (5, ""),
        (6, "Licensed under the Apache License, version 2.0"), (7, "We are not released under the MIT License."), (6, "Licensed under the Apache License, version 2.0"),
        (8, licences.TEXTS["0BSD"].replace("authorization", "authorisation")),
        (9, mit.replace("subject to the following conditions:", "subject to the following conditions:\n(c) Commercial use is strictly forbidden.")),
        (10, "Copyright (c) 2024 Acme. Licensed under the Apache License, Version 2.0."), (11, "MIT License\n\nCopyright 2001, 2003 by A.B. Inc. All rights reserved.\n\n" + mit),
        (12, "# Copyright (C) The Authors\n# All rights reserved.\n" + licences.TEXTS["BSD-3-Clause"]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license_id string")
    got = {(r.doc_id, r.license_id, r.whole, r.lines) for r in licences.scan(df, licences.known(spark)).collect()}
    assert got == {(1, "MIT", True, 0), (3, "MIT", False, 1), (6, "Apache-2.0", True, 2), (8, "0BSD", True, 0), (10, "Apache-2.0", True, 1), (11, "MIT", True, 0), (12, "BSD-3-Clause", True, 0)}
    assert licences.scan(df.limit(0), licences.known(spark)).count() == 0


@pytest.mark.parametrize("forms", [1, 101, 5000])
def test_size_of_a_registry_changes_no_result(spark, forms):
    """The search for words must not lose a text, whatever is taken out of it."""
    texts = ["permission is given", "we favour http://x.org & others"]
    known = [("P", texts[0]), ("F", texts[1])] + [(f"x{i}", f"unrelated{i} words{i}") for i in range(forms - 1)]
    rows = ["permhttp://ission is given", "PERMISSION -- is\ngiven", "we favor HTTPS://x.org and others", "perm\nission is given", "copyright (c) x\npermission is given", "perm(c) 2020ission is given", "per© mission is given"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.license_id) for r in licences.scan(df, spark.createDataFrame(known, "license_id string, text string")).collect()}
    assert got == {(1, "P"), (2, "F"), (4, "P")}


def test_licences_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Do as you like.\nBut be kind.")
    df = spark.createDataFrame([(1, "do as you like; but be kind")], "doc_id long, text string")
    assert [(r.license_id, r.whole) for r in licences.scan(df, licences.known(spark, str(tmp_path))).collect()] == [("Own-1.0", True)]


def test_targets_that_cannot_be_met(spark):
    df = _docs(spark)
    total = sum(t for t, _ in _totals(mixing.mix(df, most_repeats=1.5)).values())
    with pytest.raises(mixing.Infeasible, match="repeat"):
        mixing.mix(df, most_repeats=2.0, budget=10 * total)
    with pytest.raises(mixing.Infeasible, match="nats"):
        mixing.mix(df, most_repeats=None, least_entropy=5.0)
    with pytest.raises(mixing.Infeasible, match="repeat"):
        mixing.mix(df, most_repeats=1.01, least_entropy=1.3)


@pytest.mark.parametrize("broadcast", [mixing.BROADCAST_SOURCES, 0])
def test_other_columns_stay(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    names = "block before passes rest copies n_tokens times plan salt bucket source_ p t".split()
    df = _docs(spark).select("doc_id", "text", "source", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = mixing.realise(df, most_repeats=1.5)
    assert out.columns == df.columns and out.select(*names).distinct().collect() == df.select(*names).distinct().collect()
    mixed = mixing.mix(df, most_repeats=1.5)
    assert mixed.columns == [c for c in df.columns if c not in ("copies", "n_tokens")] + ["n_tokens", "copies"]
    assert mixed.agg(F.sum("copies")).first()[0] == out.count()


def test_decontamination_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6), (2, " ".join(f"w{i}" for i in range(20)), 7, 8)], "doc_id long, text string, key int, __key int")
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.keep_clean(df, bench).collect()] == [(1, "a b", 5, 6)]
