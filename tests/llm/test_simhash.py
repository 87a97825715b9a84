import random

import pytest
import xxhash

from pagemill.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=4):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d is None, d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def sample(n=150, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            words = list(rnd.choice(rows)[1].split(" "))
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [simhash.TILE, 3])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = [*sample(), (1000, None), (1001, ""), (1002, " \n"), (1003, "Ab C"), (1004, "aB c"), (None, "ab c"), (2000, "again"), (2000, "again")]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == brute_components(rows)


def test_many_close_fingerprints_leave_a_forest():
    import numpy as np

    rnd = random.Random(2)
    fps = np.unique(np.array([sum(1 << rnd.randrange(64) for _ in range(2)) & (2**64 - 1) for _ in range(3000)], dtype=np.uint64))
    links = simhash._links(np.zeros(fps.size, np.int64), fps, 4)
    assert links.shape[1] < fps.size


def test_long_texts_are_read_in_pieces(monkeypatch):
    from pagemill.llm import words

    text = " ".join(f"W{i % 97}é" for i in range(3000))
    want = brute_fingerprint(text)
    monkeypatch.setattr(words.word_lists, "__defaults__", (50,))
    assert simhash.fingerprint(text.encode()) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
