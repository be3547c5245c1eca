"""Byte-level BPE against the tiktoken library, and decoding as an exact round trip."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from brindle.llm import bpe

from .conftest import rows_by_id, texts_of


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer()


@pytest.fixture(scope="module")
def reference(tokenizer):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_query_is_tiktoken(spark, folder, reference):
    out = rows_by_id(bpe.op6_bpe(spark, folder))
    for i, t in texts_of(spark, folder).items():
        ids = reference.encode_ordinary(t or "")
        assert tuple(out[i])[1:] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())), i


def wild():
    r = random.Random(5)
    letters = "abcdeè 's\n\t 中文字한글😀1٣²_#!\x1c 　﻿"
    return [
        None, "", " ", "\n\n  x", "a" * 5000, "ab" * 3000, "the" * 1000, "😀" * 200, "<|endoftext|>",
        *["".join(r.choice(letters) for _ in range(r.randrange(300))) for _ in range(150)],
        *["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (127, 128, 129, 3000)],
    ]


@pytest.mark.parametrize("warm", [False, True])
def test_wild_texts(spark, tokenizer, reference, warm, monkeypatch):
    monkeypatch.setattr(bpe, "_BATCH", 5000)
    texts = wild()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    if warm:
        tokenizer.warm(df, most=200)
        assert 0 < len(tokenizer.common.hashes) <= 200
    encoded = tokenizer.encode(df, ("ids", "n_tokens", "ids_text", "decoded"))
    for i, r in rows_by_id(encoded).items():
        assert list(r["ids"]) == reference.encode_ordinary(texts[i] or ""), i
        assert bytes(r["decoded"]) == (texts[i] or "").encode()
        assert r["n_tokens"] == len(r["ids"]) and r["ids_text"] == ",".join(map(str, r["ids"]))
    decoded = tokenizer.decode(encoded.drop("decoded"))
    assert all(bytes(r["decoded"]) == (texts[i] or "").encode() for i, r in rows_by_id(decoded).items())


def test_heap_and_fold_agree(spark, tokenizer):
    from pyspark.sql import functions as F

    r = random.Random(1)
    words = [bytes(r.choice(b"ethanoi rs") for _ in range(r.randrange(1, 40))) for _ in range(200)]
    parts = [[int(tokenizer.byte[b]) for b in w] for w in words]
    df = spark.createDataFrame([(parts,)], "words array<array<bigint>>")
    folded = bpe._all_merged(df, "words", tokenizer.start, tokenizer.cells).select(F.explode("words")).collect()
    assert [list(x[0]) for x in folded] == [bpe._heaped(p, tokenizer.start, tokenizer.cells) for p in parts]


def test_same_hash_is_not_the_same_word(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe.xxhash, "xxh64_intdigest", lambda w: 7 if w < b"m" else 9)
    lengths = np.array([len(p) for p in tokenizer.pieces])
    one, two = tokenizer.ranks[b"a"], tokenizer.ranks[b"z"]
    common = bpe.Common(np.array([9, 7], np.uint64), np.array([2, 1]), np.array([two, two, one]))
    told = lambda *ids: np.array(ids, np.int32).tobytes()
    assert common.find([b"a", b"b", b"zz", b"z", b"zy"], tokenizer.pieces, lengths) == [told(one), None, told(two, two), None, None]
    assert common.find([b"a", b"zz"], tokenizer.pieces, lengths) == [told(one), told(two, two)]
    assert common.find([], tokenizer.pieces, lengths) == []


def test_repeated_rows_and_null_ids(spark, tokenizer):
    df = spark.createDataFrame([(1, " the"), (1, " the"), (None, " the"), (None, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"], len(r["ids"])) for r in tokenizer.encode(df).collect()), key=str) == sorted([(1, 1), (1, 1), (None, 1), (None, 0)], key=str)


def test_a_pattern_of_ones_own(spark, tokenizer):
    own = bpe.Tokenizer(pattern=r".|\s")
    df = spark.createDataFrame([(1, "the\n cat")], "doc_id long, text string")
    assert own.encode(df).first()["ids"] == [own.ranks[c.encode()] for c in "the\n cat"]


def test_ranks_must_hold_all_bytes(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "ranks"))
