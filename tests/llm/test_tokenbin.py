import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import tokenbin
from pagemill.llm.scratch import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("width", range(1, 33))
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 333, dtype=np.uint64).astype(np.uint32)
    data = tokenbin.pack(ids, width)
    assert len(data) == -(-333 * width // 8) and (tokenbin.unpack(data, 333, width) == ids).all()


def test_least_width():
    assert [tokenbin.width_of(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


ENCODER = tokenbin.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAé́   \x85\n\tİΣς<|>'sl9한\x01\x1c\x00😀‍", max_size=12) | st.sampled_from(["<|endoftext|>", "Word, ", "it's "]), max_size=5).map("".join))
def test_words_encode_like_whole_texts(text):
    assert ENCODER.encode(text.encode()).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_bounded_cache(monkeypatch):
    monkeypatch.setattr(tokenbin, "KEPT_WORDS", 20)
    monkeypatch.setattr(tokenbin, "LONG_WORD", 5)
    monkeypatch.setattr(tokenbin, "GROUP", 7)
    rnd = random.Random(1)
    own = tokenbin.Encoder(PATH)
    texts = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    assert [x.tolist() for x in own.encode_many(t.encode() for t in texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.index) <= 20


def rows_for(rows):
    start, out = 0, []
    for d, t in rows:
        ids = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    rnd = random.Random(2)
    rows = [(i * 13 % 401 - 7, " ".join(rnd.choice(["Hello", "wörld,", "x1"]) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    rows = sorted(rows) + [(900, None), (901, ""), (902, "long " * 70_000)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    got = sorted(tuple(r) for r in tokenbin.encode(df, PATH, 1).collect())
    assert got == rows_for(rows)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b"), (1, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in tokenbin.encode(df, PATH, 1).collect()), key=lambda r: r[1])
    assert got == rows_for([(None, "a"), (1, None), (2, "b"), (2, "b")])
    assert tokenbin.encode(df.limit(0), PATH, 1).count() == 0


def test_random_access(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "BLOCK", 10)
    out = tokenbin.Writer(Scratch(spark, "test").path("t"), 1000, 0)
    ids = np.arange(95, dtype=np.uint32) * 7 % 1000
    for a in range(0, 95, 19):
        out.add(a, ids[a : a + 19])
    out.close()
    reader = tokenbin.Reader(out.uri)
    assert reader.head["width"] == 10
    for a in range(0, 95, 6):
        for b in range(a, 95, 11):
            assert (reader.ids(a, b) == ids[a:b]).all()
    assert [x.tolist() for _, _, x in reader.documents()] == [ids[a : a + 19].tolist() for a in range(0, 95, 19)]
