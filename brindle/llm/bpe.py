"""Byte-level BPE by higher-order functions.

A batch of texts is cut into words, and each different word is merged once: a fold over its bytes whose steps by turns find the
pair of least rank, the leftmost of equal ones, and merge it, with a rank map that stands in the plan as a value. The map
is a table over pairs of ids: the pair (a, b) has its place at start[a] + b, and the cell there names a, so a lookup is two
array reads. Texts are then lists of places among the words. Decoding concatenates the pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bind, saved, small_batches, table, text_key

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
#: Characters of text in a batch, about; a longer text is a batch of its own.
_BATCH = 2_000_000
#: Bytes of the longest word that the fold merges. It takes steps times length; longer words are merged over a heap.
_LONGEST = 128
#: A cell is the pair's first id above _RANK + _PLACE bits and the rank above _PLACE; the place in the word goes below.
_PLACE, _RANK = 8, 20
_NONE = 1 << (_PLACE + _RANK)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a file with a token in base 64 and its rank on each line, all 256 bytes among them."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no rank")
    if max(ranks.values()) >= 1 << _RANK:
        raise ValueError(f"a rank has over {_RANK} bits")
    return ranks


def rank_map(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """start and cells: for each pair of ids (a, b) whose bytes together have a rank, cells[start[a] + b] holds a and the rank."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a = ranks.get(token[:i])
            b = None if a is None else ranks.get(token[i:])
            if b is not None:
                rows.setdefault(a, []).append((b, rank))
    ids = max(ranks.values()) + 1
    size = ids + 4 * sum(map(len, rows.values()))
    start, cells, rnd = np.zeros(ids, np.int64), np.full(size, ids, np.int64) * _NONE, np.random.default_rng(0)
    for a, pairs in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b = np.array([x[0] for x in pairs])
        while True:  # the cells are a quarter full at the end, and the long rows come first: a few throws find room
            at = rnd.integers(0, size - ids + 1, 64)
            free = (cells[at[:, None] + b] // _NONE == ids).all(axis=1)
            if free.any():
                break
        start[a] = at[free.argmax()]
        cells[start[a] + b] = [a * _NONE | rank << _PLACE for _, rank in pairs]
    return start, cells


def _heaped(parts: list[int], start: np.ndarray, cells: np.ndarray) -> list[int]:
    """What the fold makes of parts, in time n log n: a linked list and a heap of its pairs."""
    n = len(parts)
    parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))

    def rank(i: int) -> int | None:
        j = after[i]
        if j >= n:
            return None
        a, r = divmod(int(cells[start[parts[i]] + parts[j]]), _NONE)
        return r >> _PLACE if a == parts[i] else None

    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:  # one of them has been merged since
            continue
        parts[i], parts[j], after[i] = r, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
    return [p for p in parts if p >= 0]


@cache
def _finder(pattern: str):
    """A function from a text to its matches of pattern. For texts without characters over U+FFFF the classes that
    pattern names are spelled out, by what they match one by one, for the faster of the two regex modules."""
    whole = regex.compile(pattern).findall

    def ranges(kind: str) -> str:
        found = [c for c in range(0x10000) if regex.match(kind, chr(c))]
        ends = [i for i in range(len(found)) if i == 0 or found[i] != found[i - 1] + 1] + [len(found)]
        return "".join(f"\\u{found[a]:04x}-\\u{found[b - 1]:04x}" for a, b in zip(ends, ends[1:]))

    if pattern != PATTERN:
        return whole
    l, n, s = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+").findall
    return lambda text: plain(text) if text.isascii() or max(text) <= "\uffff" else whole(text)


def _counted(pattern: str, shared):
    """The words of texts that the fold merges, with their numbers."""

    def run(batches):
        find, ranks = _finder(pattern), shared.value
        counts, n = Counter(), 0

        def told() -> pa.RecordBatch:
            own = [(w, n) for w, n in counts.items() if len(d := w.encode()) <= _LONGEST and d not in ranks]
            counts.clear()
            return pa.record_batch([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                counts.update(find(text))
                n += len(text)
                if n > _BATCH:
                    yield told()
                    n = 0
        yield told()

    return run


def _lists(data: bytes, sizes: list[int], of: np.ndarray | None = None) -> pa.Array:
    """Lists of the given sizes: data's ints, or what of holds for each of its bytes."""
    values = np.frombuffer(data, np.int32) if of is None else of[np.frombuffer(data, np.uint8)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values))


def _one(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _spelled(byte: np.ndarray):
    """A list of words for each batch, and of their bytes as ids."""

    def run(batches):
        for b in batches:
            data = [w.encode() for w in b.column(0).to_pylist()]
            yield pa.record_batch([_one(b.column(0)), _one(_lists(b"".join(data), [*map(len, data)], byte))], names=["word", "parts"])

    return run


class _Places(dict):
    """Words by their places, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class Common:
    """The ids of common words: sorted hashes of the words, and their ids one after the other, all in small types."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order, starts = np.argsort(hashes), np.cumsum(np.concatenate([[0], sizes]))[:-1]
        self.hashes, self.sizes, self.starts = hashes[order], sizes[order].astype(np.uint8), starts[order].astype(np.uint32)
        self.ids = ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.int32)

    def find(self, words: list[bytes], pieces: list[bytes], lengths: np.ndarray) -> list[bytes | None]:
        """Each word's ids as the bytes of ints; None for a word that isn't there, which its ids' pieces tell from one
        with the same hash. lengths: those of pieces."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.hashes) or not words:
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hits = np.flatnonzero(self.hashes[at] == h)
        if not len(hits):
            return out
        sizes = self.sizes[at[hits]].astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[at[hits]].astype(np.int64) - begins, sizes)]
        own = [words[i] for i in hits.tolist()]
        spelled = [pieces[x] for x in ids.tolist()]
        same = np.add.reduceat(lengths[ids], begins) == np.fromiter(map(len, own), np.int64, len(own))
        if not same.all() or b"".join(spelled) != b"".join(own):
            same = np.array([b"".join(spelled[a:b]) == w for w, a, b in zip(own, begins.tolist(), ends.tolist())])
        data = ids.astype(np.int32).tobytes()
        for i, a, b, right in zip(hits.tolist(), (4 * begins).tolist(), (4 * ends).tolist(), same.tolist()):
            if right:
                out[i] = data[a:b]
        return out


def _packed(batches):
    """Hashes of words, and the numbers and the ids of what they are merged to."""
    for b in batches:
        for k in range(len(b)):
            words, ids = (b.column(c).slice(k, 1).flatten() for c in range(2))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words.to_pylist()), np.uint64, len(words))
            yield pa.record_batch([pa.array([hashes.view(np.int64)]), pa.array([np.diff(ids.offsets.to_numpy())]), pa.array([ids.flatten().to_numpy()])], names=["hashes", "sizes", "ids"])


_COLUMNS = {"ids": "array<long>", "keys": "array<long>", "sizes": "array<int>", "places": "array<int>", "known": "array<array<int>>", "others": "array<array<long>>"}


def _dictionary(pattern: str, byte: np.ndarray, shared):
    """From texts to batches: the rows' ids, keys and numbers of words, the words as places among the batch's
    different ones, the ids of these that are known and the bytes, as ids, of the others."""

    def run(batches):
        find = _finder(pattern)
        pieces, common, start, cells = shared.value
        ranks = {token: rank for rank, token in enumerate(pieces) if token is not None}
        lengths = np.array([len(p or b"") for p in pieces])

        def told(ids, keys, texts, place) -> pa.RecordBatch:
            words = [w.encode() for w in place]
            known: list[bytes] = []
            others: list[bytes] = []
            to = np.zeros(len(words), np.int32)  # from 0 among the known, from -1 down among the others
            rest = []
            for i, w in enumerate(words):
                if (own := ranks.get(w)) is not None:
                    to[i] = len(known)
                    known.append(own.to_bytes(4, sys.byteorder))
                else:
                    rest.append(i)
            for i, merged in zip(rest, common.find([words[i] for i in rest], pieces, lengths)):
                w = words[i]
                if merged is None and len(w) > _LONGEST:
                    merged = np.array(_heaped(byte[np.frombuffer(w, np.uint8)].tolist(), start, cells), np.int32).tobytes()
                if merged is None:
                    others.append(w)
                    to[i] = -len(others)
                else:
                    to[i] = len(known)
                    known.append(merged)
            to = np.where(to < 0, len(known) - 1 - to, to)
            places = pa.array(to[np.concatenate([np.zeros(0, np.int32), *texts])])
            lists = [_lists(b"".join(known), [len(x) // 4 for x in known]), _lists(b"".join(others), [*map(len, others)], byte)]
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([*map(len, texts)], pa.int32()), places, *lists]
            return pa.record_batch([_one(c) for c in columns], names=[*_COLUMNS])

        ids, keys, texts, place, n = [], [], [], _Places(), 0
        for b in batches:
            for i, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                if ids and n + len(text) > _BATCH:
                    yield told(ids, keys, texts, place)
                    ids, keys, texts, place, n = [], [], [], _Places(), 0
                words = find(text)
                texts.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                keys.append(key)
                n += len(text)
        if ids:
            yield told(ids, keys, texts, place)
        pa.default_memory_pool().release_unused()

    return run


def _merged(word: Column, start: Column, cells: Column) -> Column:
    """The ids of a word of at most _LONGEST bytes."""

    def step(a: Column, _: Column) -> Column:
        parts, least = a["parts"], a["least"]
        # the first id cancels out of a pair's own cell, and stays above the rank in any other
        ranked = lambda x, i: F.get(cells, F.get(start, x) + F.get(parts, i + 1)).bitwiseXOR(F.shiftleft(x, _RANK + _PLACE)) + i
        at = least.bitwiseAND((1 << _PLACE) - 1).cast("int")
        merged = F.filter(F.transform(parts, lambda x, i: F.when(i == at, F.shiftright(least, _PLACE)).otherwise(x)), lambda x, i: i != at + 1)
        return (
            F.when(least.isNull(), F.struct(parts.alias("parts"), F.coalesce(F.array_min(F.transform(parts, ranked)), F.lit(_NONE)).alias("least")))
            .when(least < _NONE, F.struct(merged.alias("parts"), F.lit(None).cast("long").alias("least")))
            .otherwise(a)
        )

    steps = F.sequence(F.lit(1), 2 * F.size(word))
    return F.aggregate(steps, F.struct(word.alias("parts"), F.lit(None).cast("long").alias("least")), step, lambda a: a["parts"])


def _all_merged(df: DataFrame, words: str, start: np.ndarray, cells: np.ndarray) -> DataFrame:
    """df with the lists in the column words merged. The rank map enters the plan as the value of a subquery of one row."""
    one = pa.table({"start": pa.array([start], pa.list_(pa.int64())), "cells": pa.array([cells], pa.list_(pa.int64()))})
    one = df.sparkSession.createDataFrame(one)
    df = df.select("*", one.select("start").scalar().alias("_start"), one.select("cells").scalar().alias("_cells"))
    plain = lambda c: F.transform(c, lambda x: x + 0)  # noqa: E731  plain arrays are read faster than a row's own
    merged = bind(plain(F.col("_start")), lambda s: bind(plain(F.col("_cells")), lambda c: F.transform(words, lambda w: _merged(w, s, c).cast("array<int>"))))
    return df.withColumn(words, merged).drop("_start", "_cells")


def _slices(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """The binary values joined between the given ends."""
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets[ends].tobytes()), values.buffers()[2]]).cast(pa.binary())


#: What encode() can give of each row's ids.
_OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_text": "string", "decoded": "binary"}


def _applied(shared, outputs: list[str]):
    """From batches with all words merged to rows: doc_id, row and outputs."""

    def run(batches):
        pieces = pa.array(shared.value, pa.large_binary())
        numerals = pa.array([f"{i}," for i in range(len(pieces))], pa.large_binary())
        for b in batches:
            for i in range(len(b)):
                ids, keys, sizes, places, known, others = (b.column(c).slice(i, 1).flatten() for c in _COLUMNS)
                words = pa.concat_arrays([known, others]).take(places)
                starts, tokens = words.offsets.to_numpy(), words.values
                ends = starts[np.cumsum([0, *sizes.to_numpy()])]
                made = {
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens),
                    "n_tokens": lambda: pa.array(np.diff(ends), pa.int64()),
                    "ids_text": lambda: pc.utf8_rtrim(_slices(numerals.take(tokens), ends).cast(pa.string()), ","),
                    "decoded": lambda: _slices(pieces.take(tokens), ends),
                }
                yield pa.record_batch([ids, keys, *[made[c]() for c in outputs]], names=["doc_id", "row", *outputs])
        pa.default_memory_pool().release_unused()

    return run


def _decoded(shared, column: int):
    def run(batches):
        pieces = pa.array(shared.value, pa.large_binary())
        for b in batches:
            lists = b.column(column)
            ends = np.cumsum([0, *(0 if n is None else n for n in pc.list_value_length(lists).to_pylist())])
            yield pa.record_batch([*b.columns, _slices(pieces.take(lists.flatten()), ends)], names=[*b.schema.names, "decoded"])

    return run


class Tokenizer:
    """Ranks and a pattern, and after warm() the ids of common words."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.ranks, self.pattern = read_ranks(path), pattern
        self.start, self.cells = rank_map(self.ranks)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.common = Common(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        token = {rank: token for token, rank in self.ranks.items()}
        self.pieces = [token.get(i) for i in range(len(self.start))]

    def warm(self, docs: DataFrame, text_col: str = "text", sample: int = 30_000, most: int = 1_000_000) -> "Tokenizer":
        """Merges the words of about sample rows ahead, at most the most common most of them. No result depends on which
        they are: a word that isn't among them is merged once in each batch that holds it."""
        spark = docs.sparkSession
        small_batches(spark)
        texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).sample(min(1.0, sample / max(1, docs.count())), 42)
        words = texts.mapInArrow(_counted(self.pattern, spark.sparkContext.broadcast(self.ranks)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        words = saved(words)
        least, above = 1, 0
        for n, words_of_n in words.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).limit(most).collect():
            above += words_of_n
            if above > most:
                least = n + 1
                break
        spelled = words.where(F.col("n") >= least).select("word").mapInArrow(_spelled(self.byte), "word array<string>, parts array<array<long>>")
        found = _all_merged(spelled, "parts", self.start, self.cells).mapInArrow(_packed, "hashes array<long>, sizes array<int>, ids array<int>").toArrow()
        hashes, sizes, ids = (found.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in range(3))
        self.common = Common(hashes.view(np.uint64), sizes, ids)
        return self

    def encode(self, docs: DataFrame, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, row (a hash of the text) and outputs for each row of docs: ids (array of int), n_tokens, ids_text (the ids in
        decimal, comma-joined), decoded (the pieces of the ids, concatenated).

        A null text is an empty one and has no ids. Repeated rows all come back, as do null ids. Other columns are ignored; an
        empty table gives an empty result.

        Cost: one scan; texts never move. A batch holds its texts' words once. Words over a bound of bytes are merged over a
        heap, since the fold takes steps times length.
        """
        small_batches(docs.sparkSession)
        text, share = F.coalesce(F.col(text_col), F.lit("")), docs.sparkSession.sparkContext.broadcast
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("row"), text.alias("text"))
        batches = rows.mapInArrow(_dictionary(self.pattern, self.byte, share((self.pieces, self.common, self.start, self.cells))), ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))
        merged = _all_merged(batches, "others", self.start, self.cells)
        return merged.mapInArrow(_applied(share(self.pieces), [*outputs]), ", ".join(["doc_id long", "row long", *[f"{c} {_OUTPUTS[c]}" for c in outputs]]))

    def decode(self, rows: DataFrame, ids_col: str = "ids") -> DataFrame:
        """rows and decoded: the pieces of their ids (array of int), concatenated. Null or no ids give no bytes; an unknown id is an error."""
        schema = StructType([*rows.schema.fields, StructField("decoded", BinaryType())])
        return rows.mapInArrow(_decoded(rows.sparkSession.sparkContext.broadcast(self.pieces), rows.columns.index(ids_col)), schema)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and, of their decoding, decoded_sha256 for each row of docs; see Tokenizer.encode()."""
    out = Tokenizer().warm(docs, text_col).encode(docs, ("n_tokens", "ids", "decoded"), id_col, text_col)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = Tokenizer().warm(docs).encode(docs, ("n_tokens", "ids_text", "decoded"))
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
