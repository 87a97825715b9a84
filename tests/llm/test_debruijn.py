import hashlib
import random

import pytest

from pagemill.llm import debruijn


def brute(rows, size):
    order = sorted({(d is None, d or 0, t) for d, t in rows})
    first, words = {}, {}
    for key in order:
        words[key] = (key[2] or "").encode().split()
        for p in range(len(words[key]) - size + 1):
            first.setdefault(tuple(words[key][p : p + size]), (key, p))
    out = []
    for d, t in rows:
        key = (d is None, d or 0, t)
        w = words[key]
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] != (key, p):
                gone[p : p + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, size):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, doc int, place int")
    return sorted((tuple(r) for r in debruijn.remove_repeats(df, size=size).collect()), key=str)


@pytest.mark.parametrize(("size", "batch"), [(7, 40), (7, 1 << 20), (20, 100)])
def test_against_brute_force(spark, monkeypatch, size, batch):
    monkeypatch.setattr(debruijn, "BATCH", batch)
    rnd = random.Random(size + batch)
    parts = ["a b c d e", "x y z", "q", "q q q q q q q q", "m n o p r s t u", "é 1 2 3"]
    rows = [(i * 7 % 151, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(120)]
    rows += [(900, ""), (901, "a b"), (902, " ".join("ab"[i % 2] for i in range(300)))]
    assert got(spark, rows, size) == brute(rows, size)


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " x"), (None, text), (3, None)]
    assert got(spark, rows, 20) == brute(rows, 20)
    assert got(spark, [], 20) == []


def test_words_are_cut_at_the_six_bytes_only():
    assert [w for part in debruijn.word_lists("a b\x0bc\x1cd\x85e".encode(), 3) for w in part] == ["a b".encode(), "c\x1cd\x85e".encode()]


def test_a_million_rows_on_one_edge(spark):
    rows = spark.range(1_000_000).selectExpr("7L left", "9L right", "1L n", "id + 5 doc", "(id % 11) * 64 + 1 place", "cast(0 as tinyint) kind")
    assert [tuple(r) for r in debruijn.edge_table(rows).collect()] == [(7, 9, 1, 5, 1)]


def test_paths_end_at_branches(spark):
    # 1-2-3-4 and 1-2-3-5: the node 3 branches, so its edges begin paths of their own
    edges = [(1, 2, 2, 0, 0), (2, 3, 1, 0, 2), (3, 4, 1, 0, 3), (4, 6, 5, 0, 4), (3, 5, 1, 8, 0)]
    df = spark.createDataFrame([(a, b, n, d, p << 6 | n) for a, b, n, d, p in edges], "left long, right long, n long, src_doc long, src long")
    assert {(r.left, r.right): r.path >> 6 for r in debruijn.label_paths(df).collect()} == {(1, 2): 0, (2, 3): 0, (3, 4): 3, (4, 6): 3, (3, 5): 0}
