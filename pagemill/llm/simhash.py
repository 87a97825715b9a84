"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint is cut into ``bits + 2`` blocks.  Two fingerprints within ``bits`` differing bits agree
on at least two whole blocks, so each goes under one key per pair of blocks and all close pairs share a
key.  Within a key the Hamming distance decides; a key's rows leave only a spanning forest of its links,
which keeps the components and not the square of a group.  Components come from alternating stars.

``keep_one`` uses the same blocks for near-duplicates by shingle similarity.  Texts whose sets of five-word shingles have
a Jaccard similarity of 0.8 differ in about 15 % of a fingerprint's bits, which no guaranteed split of 64 bits finds.  So
fingerprints there have 512 bits, over the set of shingles, the first 252 in 36 blocks of 7.  Blocks lie in groups of four and
two texts meet if two blocks of one group agree, which loses a pair of similarity 0.8 with a chance of 1.4 in a hundred
and one of 0.85 with one in a thousand.  Pairs within ``RADIUS`` bits are candidates (98 of 100 at 0.8, more above), and
each link is checked on the texts themselves.  A sketch of each set, the parity of its hashes in ``SKETCH`` places, and the
set's size bound the similarity from above (two sets differ in no fewer members than their sketches do in bits), so pairs
that can't reach 0.8 are left out without a check, and none that can.  Of sets of some hundred shingles only pairs just
under 0.8 are left to be checked in vain; the bound is loose where two sets differ in more than about ``SKETCH`` / 2 members.

Defined cases: null or word-less texts have fingerprint zero and link like any other; equal rows share
a component; of rows equal in id and text one stays, of rows that share an id but not the text that with the smaller
hash of the text comes first; a null id never becomes a component's id (the id is null if the component has no other);
an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.llm.components import roots
from pagemill.llm.names import fresh, own
from pagemill.llm.scratch import Scratch
from pagemill.llm.words import word_lists

#: Keys with more fingerprints than this are compared tile by tile, each pair of tiles a group of its own.
TILE = 8192
#: Runs up to this length are compared by offsets over a whole batch, longer ones by a search of their own.
SHORT_RUN = 8


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all ``size``-word shingles of the ASCII-lower-cased text."""
    digest = xxhash.xxh64_digest
    counts, total, carry, short = np.zeros(64, dtype=np.int64), 0, [], True
    for words in word_lists(text.lower()):
        words = carry + words
        if len(words) >= size:
            short = False
            line = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[:-1]]
            hashes = b"".join([digest(line[s : e - 1], seed) for s, e in zip(starts, ends[size - 1 :], strict=False)])
            bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
            counts += np.add.reduce(bits, axis=0, dtype=np.int64)
            total += len(bits)
            words = words[len(words) - size + 1 :] if size > 1 else []
        carry = words
    if short and carry:
        counts, total = np.unpackbits(np.frombuffer(digest(b" ".join(carry), seed), dtype=np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint_column(text, size: int = 4, seed: int = 42):
    """A column of fingerprints as signed 64-bit integers."""

    @arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t.as_buffer().to_pybytes(), size, seed) if t.is_valid else 0 for t in texts]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())

    return of(text)


def block_keys(bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each pair of the ``bits + 2`` blocks: a table number and the (shift, width) of both blocks."""
    n = bits + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [(t, list(pair)) for t, pair in enumerate(combinations(blocks, 2))]


def _forest(fps: np.ndarray, bits: int) -> list[np.ndarray]:
    """Edges (2 x m arrays) of a spanning forest of the links among distinct fingerprints."""
    out, left = [], fps
    while left.size:
        reach, left = [left[0]], left[1:]
        while reach and left.size:
            at = reach.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                out.append(np.stack([np.full(found.size, at), found]))
                reach.extend(found)
                left = left[~near]
    return out


def _links(keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Links within runs of equal keys (sorted), at most a spanning forest for long runs."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    length = np.diff(cuts)
    out = []
    small = np.repeat(length <= SHORT_RUN, length)
    for d in range(1, SHORT_RUN):
        same = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not same.size:
            break
        a, b = fps[same], fps[same + d]
        near = np.bitwise_count(a ^ b) <= bits
        out.append(np.stack([a[near], b[near]]))
    for s, n in zip(cuts[:-1][length > SHORT_RUN], length[length > SHORT_RUN], strict=True):
        out += _forest(np.unique(fps[s : s + n]), bits)
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), dtype=np.uint64)


def _scan(bits: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def told(k, f):
            found = _links(k, f, bits).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not k.size:
                continue
            cut = np.searchsorted(k, k[-1]) if (k[1:] >= k[:-1]).all() else int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
            yield told(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        if rest_k.size:
            yield told(rest_k, rest_f)

    return scan


def links(fps: DataFrame, scratch: Scratch, bits: int = 4) -> DataFrame:
    """``fps(fp)`` of distinct fingerprints to ``(a, b)``: links enough to keep every component."""
    rows = fps.select(F.explode(F.array(*_narrow_keys(bits))).alias("key"), "fp")
    return _dealt(rows, scratch).mapInArrow(_scan(bits), "a bigint, b bigint")


def _narrow_keys(bits: int) -> list:
    keys = []
    for t, pair in block_keys(bits):
        key = F.lit(t).cast("bigint")
        for shift, width in pair:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        keys.append(key)
    return keys


def _dealt(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(key, fp, ...)`` sorted by key; keys of many fingerprints are dealt over pairs of tiles."""
    others = rows.columns[1:]
    hot = scratch.write("hot", rows.groupBy("key").count().where(F.col("count") > 2 * TILE))
    if not hot.isEmpty():
        tiles = F.ceil(F.col("count") / TILE).cast("int")
        at = F.pmod(F.xxhash64("fp"), F.col("t")).cast("int")
        rows = (
            rows.join(hot.select("key", tiles.alias("t")), "key", "left")
            .withColumn("at", F.coalesce(at, F.lit(0)))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("t", F.lit(1)) - 1)))
            .select(F.when(F.col("t").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("at", "other"), F.greatest("at", "other"))).alias("key"), *others)
        )
    return rows.repartition("key").sortWithinPartitions("key")


def components(fps: DataFrame, scratch: Scratch, bits: int = 4) -> DataFrame:
    """``fps(fp, first)`` with one row per fingerprint to ``(fp, root, component_id)``: the least ``first`` reachable."""
    stars = roots_of(fps, scratch, bits)
    rooted = fps.join(stars.toDF("fp", "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def roots_of(fps: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    return roots(links(fps.select("fp"), scratch, bits), scratch)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    marked = docs.select(F.col(id_col).alias(id_col), fingerprint_column(F.col(text_col), size, seed).alias("fp")).checkpoint()
    fps = scratch.write("fps", marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    found = components(fps, scratch, bits).select("fp", "component_id").checkpoint()
    scratch.drop()
    return marked.join(found, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near-duplicates by shingle similarity

#: 64-bit words of a wide fingerprint; bits of a block, blocks of a group, groups.
WORDS, WIDTH, IN_GROUP, GROUPS = 8, 7, 4, 9
#: Differing bits of candidates, of 512.
RADIUS = 95
#: Bits of a sketch; 64-bit words of a size and a sketch.
SKETCH = 1024
SET_WORDS = 1 + SKETCH // 64
#: Runs up to this length are compared by offsets over a whole batch, longer ones by a search of their own.
WIDE_RUN = 64
_U = np.uint64


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles (fewer words: of the whole sequence), ASCII-lower-cased."""
    digest, carry, out = xxhash.xxh64_digest, [], []
    for words in word_lists(text.lower()):
        words = carry + words
        if len(words) >= size:
            line = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[:-1]]
            hashes = b"".join([digest(line[s : e - 1]) for s, e in zip(starts, ends[size - 1 :], strict=False)])
            out.append(np.unique(np.frombuffer(hashes, dtype=_U)))
            words = words[len(words) - size + 1 :] if size > 1 else []
        carry = words
    if not out and carry:
        out.append(np.frombuffer(digest(b" ".join(carry)), dtype=_U))
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=_U)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; empty ones are equal."""
    common = np.intersect1d(a, b, assume_unique=True).size
    return common / (a.size + b.size - common) if a.size or b.size else 1.0


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """The majority bits over ``WORDS`` hashes of each member of a set."""
    out = np.zeros(WORDS, dtype=_U)
    for w in range(WORDS):
        x = own + _U((0x9E3779B97F4A7C15 * (w + 1)) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> _U(31))).view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(bits), 255):
            counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
        out[w] = np.packbits(2 * counts > own.size).view(_U)[0]
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """The size of a set, and the parity of its members' numbers in each of ``SKETCH`` places."""
    odd = np.bincount((own % _U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.concatenate([np.array([own.size], dtype=_U), np.packbits(odd.astype(np.uint8)).view(_U)])


def may_reach(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sketches can have that similarity: they differ in as many members at least as the sketches in bits."""
    return _apart(a[..., 1:], b[..., 1:]) <= (a[..., 0] + b[..., 0]).astype(np.float64) * ((1 - least) / (1 + least)) + 1e-6


def wide_column(text, size: int = 5):
    """The wide fingerprint of each text, and behind it the sketch of its set."""

    @arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in texts)
        return pa.array([wide_fingerprint(x).tobytes() + sketch(x).tobytes() for x in sets], pa.binary())

    return of(text)


def _wide(column: pa.Array, words: int = WORDS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=_U).reshape(-1, words)


def wide_keys(fps: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint, one per pair of blocks of a group."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)[:, : GROUPS * IN_GROUP * WIDTH]
    blocks = bits.reshape(len(fps), GROUPS, IN_GROUP, WIDTH).astype(np.int64) @ (1 << np.arange(WIDTH))
    pairs = list(combinations(range(IN_GROUP), 2))
    keys = [(((g * len(pairs) + k) << WIDTH | blocks[:, g, i]) << WIDTH) | blocks[:, g, j] for g in range(GROUPS) for k, (i, j) in enumerate(pairs)]
    return np.stack(keys, axis=1)


def wide_keys_column(fp):
    @arrow_udf("array<bigint>")
    def of(fps: pa.Array) -> pa.Array:
        keys = wide_keys(_wide(fps))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))

    return of(fp)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


#: Tells which of the rows at the first indices are candidates of those at the second.
Close = Callable[[np.ndarray, np.ndarray | int], np.ndarray]


def _pairs_within(keys: np.ndarray, of: np.ndarray, close: Close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of runs of equal keys (sorted) that are close and belong to different ``of``."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    length = np.diff(cuts)
    small = np.repeat(length <= WIDE_RUN, length)
    for d in range(1, WIDE_RUN):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not at.size:
            break
        at = at[of[at] != of[at + d]]
        at = at[close(at, at + d)]
        yield at, at + d
    for s, n in zip(cuts[:-1][length > WIDE_RUN], length[length > WIDE_RUN], strict=True):
        for i in range(s, s + n - 1):
            near = i + 1 + np.flatnonzero(of[i + 1 : s + n] != of[i])
            near = near[close(near, i)]
            if near.size:
                yield np.full(near.size, i), near


def _spanning(keys: np.ndarray, of: np.ndarray, close: Close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that leave, in every run of equal keys, a spanning forest of the links between different ``of``."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    length = np.diff(cuts)
    small = np.repeat(length <= WIDE_RUN, length)
    run = np.repeat(np.arange(length.size), length)
    root: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    first, second = [], []
    for d in range(1, WIDE_RUN):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not at.size:
            break
        at = at[of[at] != of[at + d]]
        for i in at[close(at, at + d)].tolist():
            a, b = find((run[i], of[i])), find((run[i], of[i + d]))
            if a != b:
                root[max(a, b)] = min(a, b)
                first.append(i)
                second.append(i + d)
    yield np.array(first, dtype=np.int64), np.array(second, dtype=np.int64)
    for s, n in zip(cuts[:-1][length > WIDE_RUN], length[length > WIDE_RUN], strict=True):
        left = np.arange(s, s + n)
        while left.size:
            own = of[left] == of[left[0]]
            reach, left = list(left[own]), left[~own]
            while reach and left.size:
                at = reach.pop()
                found = left[close(left, at)]
                if found.size:
                    # one link a label is enough; all rows of these labels are reached with it
                    labels, one = np.unique(of[found], return_index=True)
                    yield np.full(one.size, at), found[one]
                    now = np.isin(of[left], labels)
                    reach.extend(left[now])
                    left = left[~now]


def _wide_scan(radius: int, every: bool, least: float):
    """Sorted (key, fp, of) to candidate pairs of different ``of``: a forest per key, or ``every`` pair.

    With a fourth column of sketches, without the pairs that can't reach ``least``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def told(k, f, of, *sets):
            def close(i, j):
                near = _apart(f[i], f[j]) <= radius
                for x in sets:
                    near[near] = may_reach(x[i[near]], x[j if np.ndim(j) == 0 else j[near]], least)
                return near

            for a, b in (_pairs_within if every else _spanning)(k, of, close):
                if a.size:
                    swap = [(x, y, d) if x < y else (y, x, d) for i, j, d in zip(a.tolist(), b.tolist(), _apart(f[a], f[b]).tolist(), strict=True) if (x := f[i].tobytes()) != (y := f[j].tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in swap], t) for n, t in enumerate((pa.binary(), pa.binary(), pa.int32()))], ["a", "b", "d"])

        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), _wide(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)]
            now += [_wide(c, SET_WORDS) for c in batch.columns[3:]]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            k = now[0]
            if not k.size:
                continue
            cut = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
            yield from told(*(x[:cut] for x in now))
            rest = [x[cut:] for x in now]
        if rest is not None and rest[0].size:
            yield from told(*rest)

    return scan


def similar_column(a, b, size: int, least: float):
    @arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        held = lru_cache(256)(lambda t: shingle_set(t, size))
        pairs = zip(left, right, strict=True)
        return pa.array([similarity(*(held(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in pair)) >= least for pair in pairs], pa.bool_())

    return of(a, b)


def similar_links(texts: DataFrame, nodes: DataFrame, scratch: Scratch, size: int, least: float, radius: int = RADIUS) -> DataFrame:
    """``texts(id, mark, text)``, ``nodes(fp, rep, sketch)`` to the root of each linked fingerprint, ``(a, b)``.

    First every fingerprint is checked, on the texts, with the nearest of its candidates: one check a fingerprint, however
    large its group.  Then a forest of the candidates between what is still apart, then all that are left, so that no
    link is lost where one of a forest didn't hold.  The second and third search are among fingerprints that have a candidate at all,
    and leave out pairs whose sketches rule the similarity out.
    """

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.write(f"{name}-pairs", pairs)
        used = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        reps = nodes.join(used, "fp").select("fp", F.col("rep.id").alias("i"), F.col("rep.mark").alias("m"))
        said = texts.join(reps, (F.col("mark") == F.col("m")) & F.col("id").eqNullSafe(F.col("i"))).dropDuplicates(["fp"]).select("fp", "text")
        said = scratch.write(f"{name}-texts", said)
        both = pairs.join(said.toDF("a", "left"), "a").join(said.toDF("b", "right"), "b")
        links = scratch.write(f"{name}-links", both.where(similar_column(F.col("left"), F.col("right"), size, least)).select("a", "b"))
        scratch.drop(f"{name}-pairs", f"{name}-texts")
        return links

    def candidates(labels: DataFrame, every: bool) -> DataFrame:
        rows = labels.select(F.explode(wide_keys_column(F.col("fp"))).alias("key"), *labels.columns)
        return _dealt(rows, scratch).mapInArrow(_wide_scan(radius, every, least), "a binary, b binary, d int")

    def labelled(found: DataFrame) -> DataFrame:
        rows = nodes.join(near.select(F.col("x").alias("fp")), "fp", "left_semi").join(found.toDF("fp", "root"), "fp", "left")
        return rows.select("fp", F.xxhash64(F.coalesce("root", "fp")).alias("of"), "sketch")

    alone = nodes.select("fp", F.xxhash64("fp").alias("of"))
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    near = candidates(alone, False).select(both.alias("p"), "d").groupBy("p.x").agg(F.min(F.struct("d", "p.y")).alias("n")).select("x", "n.y")
    near = scratch.write("near", near)
    links = checked(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "first")
    found = roots(links, scratch)
    for name, every in (("second", False), ("third", True)):
        scratch.settle()
        more = checked(candidates(labelled(found), every).select("a", "b").distinct(), name)
        if not more.isEmpty():
            found = roots(found.union(more), scratch)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The documents with one of each group of similar ones left: that with the smallest id (nulls last)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    mark = F.xxhash64(F.col(text_col), F.col(text_col).isNull())
    texts = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    marked = scratch.write("marked", texts.select("id", "mark", wide_column(F.col("text"), size).alias("wide")))
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    parts = [F.substring("wide", a, n).alias(c) for a, n, c in ((1, 8 * WORDS, "fp"), (1 + 8 * WORDS, 8 * SET_WORDS, "sketch"))]
    nodes = scratch.write("nodes", marked.select("id", "mark", *parts).groupBy("fp").agg(F.min(rep).alias("rep"), F.min_by("sketch", rep).alias("sketch")))
    linked = similar_links(texts, nodes, scratch, size, least, radius)
    rooted = nodes.join(linked.toDF("fp", "root"), "fp", "left").select("rep", F.coalesce("root", "fp").alias("root"))
    name, other, key = fresh(docs, "mark", "id_of", "mark_of")
    stays = rooted.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.id").alias(other), F.col("rep.mark").alias(key)).checkpoint()
    repeats = not marked.groupBy("id", "mark").count().where("count > 1").isEmpty()
    scratch.drop()
    kept = docs.withColumn(name, mark).join(stays, (F.col(name) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(other)), "left_semi")
    return (kept.dropDuplicates([id_col, name]) if repeats else kept).select(*own(docs))
