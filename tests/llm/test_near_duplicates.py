import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

from pagemill.llm import simhash


def brute_kept(rows, size=5, least=0.8):
    """One id a group, with no limit on what is compared."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()), key=str)


def sample():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(240):
        text = rnd.choices(words, k=300)
        if i >= 60 and rnd.random() < 0.8:
            text = list(rows[rnd.randrange(60)][1].split(" "))
            for _ in range(rnd.randint(1, 9)):
                text[rnd.randrange(300)] = rnd.choice(words)
        rows.append((i, " ".join(text)))
    return rows


def test_pipeline_against_brute_force(spark):
    rows = [*sample(), (1000, None), (1001, ""), (1002, " \n"), (1003, "Ab C"), (1004, "aB c"), (None, "ab c"), (2000, "again"), (2000, "again"), (None, "lone"), (None, "lone")]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, fp int, n string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == brute_kept(rows)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_a_large_group_keeps_its_links_linear(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[: i % 295], f"own{i}", *base[i % 295 + 1 :]])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(df).collect()] == [0]


def test_links_beside_a_forest_are_not_lost(spark, monkeypatch):
    """In one run of a key, a pair whose forest link fails the check still meets through the second search."""
    monkeypatch.setattr(simhash, "WIDE_RUN", 2)
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in simhash.keep_one(df).collect()), key=str) == brute_kept(rows)


def test_recall_of_candidates():
    """Of pairs at a similarity of 0.8 to 0.82, nine of ten and more share a key within the radius; unrelated ones don't."""
    rnd = np.random.default_rng(5)
    met = far = total = 0
    for _ in range(300):
        base = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
        other = base.copy()
        other[:42] = rnd.integers(0, 1 << 63, 42, dtype=np.uint64)
        assert 0.8 <= simhash.similarity(np.unique(base), np.unique(other)) <= 0.82
        a, b, c = (simhash.wide_fingerprint(np.unique(x)) for x in (base, other, rnd.integers(0, 1 << 63, 400, dtype=np.uint64)))
        keys = simhash.wide_keys(np.stack([a, b]))
        total += 1
        met += bool((keys[0] == keys[1]).any() and np.bitwise_count(a ^ b).sum() <= simhash.RADIUS)
        far += bool(np.bitwise_count(a ^ c).sum() <= simhash.RADIUS)
    assert met / total > 0.93 and not far


def test_sketches_rule_out_only_what_is_apart():
    """A pair of 0.8 and more is never left out; of a group of texts just under it, hardly a pair is checked."""
    rnd = np.random.default_rng(7)
    for n in (1, 5, 40, 150, 900, 6000):
        for least in (0.8, 0.5, 1.0):
            for _ in range(30):
                a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
                b = np.unique(np.concatenate([a[: rnd.integers(0, n + 1)], rnd.integers(0, 1 << 63, rnd.integers(0, n // 4 + 1), dtype=np.uint64)]))
                assert simhash.may_reach(simhash.sketch(a), simhash.sketch(b), least) or simhash.similarity(a, b) < least
    base = rnd.integers(0, 1 << 63, 146, dtype=np.uint64)
    group = [np.unique(np.concatenate([np.delete(base, rnd.choice(146, 12, replace=False)), rnd.integers(0, 1 << 63, 12, dtype=np.uint64)])) for _ in range(120)]
    pairs = [(x, y) for i, x in enumerate(group) for y in group[:i]]
    close = [np.bitwise_count(simhash.wide_fingerprint(x) ^ simhash.wide_fingerprint(y)).sum() <= simhash.RADIUS for x, y in pairs[:700]]
    assert max(simhash.similarity(x, y) for x, y in pairs) < 0.79 and sum(close) > 300
    assert not any(simhash.may_reach(simhash.sketch(x), simhash.sketch(y), 0.8) for x, y in pairs)


def test_a_group_just_under_the_threshold_makes_no_pairs(spark):
    """Texts that share most shingles with a base but too few with each other: each stays, and next to none is paired."""
    rnd = random.Random(11)
    rows = []
    for i in range(100):
        text = [f"w{k}" for k in range(300)]
        for k in rnd.sample(range(0, 296, 5), 5):
            text[k] = f"own{i}x{k}"
        rows.append((i, " ".join(text)))
    sets = [simhash.shingle_set(t.encode()) for _, t in rows]
    columns = [pa.array([0] * 100), pa.array([simhash.wide_fingerprint(x).tobytes() for x in sets]), pa.array(range(100)), pa.array([simhash.sketch(x).tobytes() for x in sets])]
    plain, bounded = (sum(b.num_rows for b in simhash._wide_scan(simhash.RADIUS, True, 0.8)([pa.RecordBatch.from_arrays(columns[:n], list("abcd")[:n])])) for n in (3, 4))
    assert plain > 1000 and bounded < 50
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == brute_kept(rows)
