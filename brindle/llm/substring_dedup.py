"""Substring dedup by level-wise doubling.

Windows of a few words come first; those repeated at one length alone are extended to twice that length (of an odd length one
less), level by level, up to the whole window; the whole windows that are repeated count. Short windows are taken at places that the content itself
picks (the least hash among those that one whole window spans), so two copies of a whole window pick the same place and none is
missed, while few are compared. A short window may be extended to the right or, where the whole window ends too soon, to the left: each whole
window follows one such chain of extensions. Windows longer than the length asked for need no level of their own: they cover no word that theirs don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, apart_binary, saved, table, text_key

#: Lengths on the way to a whole window, itself included, at most.
_LEVELS = 4  # the hashes of all between the first and the last fit into one long
#: Windows of a text that are hashed at a time, and the bits that number the places among them.
_PIECE, _BITS = 1 << 17, 18
_TIMES = 0x9E3779B97F4A7C15
#: A random number for each byte.
_BYTES = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Chain(NamedTuple):
    """Where a short window's extensions begin, in words before it, level by level; and how far it may lie from the start of its whole window."""

    left: tuple[int, ...]
    low: int
    high: int


def lengths_of(window: int) -> list[int]:
    """The levels' lengths, ascending: each at most twice the last."""
    out = [window]
    while len(out) < _LEVELS and out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def chains_of(lengths: list[int]) -> list[Chain]:
    """For every place of the shortest window in the whole one, one chain that stays inside it."""
    window, out = lengths[-1], [Chain((0,), 0, lengths[-1] - lengths[0])]
    for short, long in zip(lengths[:-2], lengths[1:-1]):
        new = []
        for left, low, high in out:
            right = min(high, window - long + left[-1])  # up to here the whole window holds the extension to the right
            if low <= right:
                new.append(Chain((*left, left[-1]), low, right))
            if max(low, right + 1) <= high:
                new.append(Chain((*left, left[-1] + long - short), max(low, right + 1), high))
        out = new
    return out


class Hasher:
    """Hashes of word windows of a text, by their bytes, in pieces of bounded size."""

    def __init__(self, window: int):
        self.window, self.lengths = window, lengths_of(window)
        self.chains = chains_of(self.lengths)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 2 * n
            steps = [np.full(size, x, np.uint64) for x in (_TIMES, pow(_TIMES, -1, 1 << 64))]
            for x in steps:
                x[0] = 1
            self.up, self.down = map(np.cumprod, steps)
        return self.up, self.down

    def pieces(self, words: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        """From which word on, the words joined by spaces, and where in that they begin and end; the pieces hold each whole window once."""
        for k in range(0, len(words) - self.window + 1, _PIECE):
            own = words[k : k + _PIECE + self.window - 1]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            ends = np.cumsum(sizes + 1) - 1
            yield k, b" ".join(own), ends - sizes, ends

    @staticmethod
    def least(h: np.ndarray, width: int) -> np.ndarray:
        """The least of each width consecutive values."""
        done = 1
        while done * 2 <= width:
            h = np.minimum(h[: len(h) - done], h[done:])
            done *= 2
        return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h

    def short(self, words: list[bytes]) -> Iterator[list[np.ndarray]]:
        """For the places that whole windows pick and their chains: the hashes of all levels but the last, and the first and last start of those whole windows."""
        for first, data, starts, ends in self.pieces(words):
            up, down = self.powers(len(data) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[: len(data)])])

            def hashed(at: np.ndarray, n: int) -> np.ndarray:
                h = (sums[ends[at + n - 1]] - sums[starts[at]]) * down[starts[at]]
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                return h ^ (h >> np.uint64(32))

            n = self.lengths[0]
            h = hashed(np.arange(len(starts) - n + 1), n)
            # of equal hashes the first place counts, in every copy
            low = np.uint64((1 << _BITS) - 1)
            picked = (self.least((h & ~low) | np.arange(len(h), dtype=np.uint64), self.window - n + 1) & low).astype(np.int64)
            turns = np.flatnonzero(np.diff(picked, prepend=-1))
            place, begin, end = picked[turns], turns, np.append(turns[1:], len(picked)) - 1
            for left, near, far in self.chains:
                a, b = np.maximum(begin, place - far), np.minimum(end, place - near)
                own = np.flatnonzero(a <= b)
                at = place[own]
                yield [h[at], *[hashed(at - x, m) for x, m in zip(left[1:], self.lengths[1:-1])], a[own] + first, b[own] + first]

    def whole(self, words: list[bytes], spans: list[tuple[int, int]]) -> tuple[np.ndarray, bytes]:
        """The starts that lie in spans (first and last, inclusive), and 16-byte hashes of the whole windows there, one after the other."""
        live = np.zeros(len(words) + 1, np.int64)
        for a, b in spans:
            live[a] += 1
            live[b + 1] -= 1
        at, out = np.flatnonzero(np.cumsum(live)), []
        digest = xxhash.xxh3_128_digest
        for first, data, starts, ends in self.pieces(words):
            own = at[(at >= first) & (at < first + _PIECE)] - first
            out += [digest(data[a:b]) for a, b in zip(starts[own].tolist(), ends[own + self.window - 1].tolist())]
        return at, b"".join(out)


#: Rows in a batch that goes back to Spark, about.
_ROWS = 1 << 16
#: Texts, by their hashes, that a task remembers.
_SEEN = 1 << 18


def _short_windows(window: int):
    """short: the least level's hash; long: 32 bits of each further level's, which count together with it; row; span: first and last start.
    Copies of a text tell nothing new: of those that a task meets the first is hashed, as far as it remembers."""

    def run(batches):
        hasher, found, n, seen = Hasher(window), [], 0, set()

        def told() -> pa.RecordBatch:
            row = np.concatenate([np.full(len(f[0]), r) for r, f in found])
            short, *longer, first, last = (np.concatenate([f[k] for _, f in found]) for k in range(len(found[0][1])))
            long = np.zeros(len(row), np.uint64)
            for k, h in enumerate(longer):
                long |= (h >> np.uint64(32)) << np.uint64(32 * k)
            columns = [short.view(np.int64), long.view(np.int64), row, first << 32 | last]
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["short", "long", "row", "span"])

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                if row in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(row)
                words = text.as_py().split()
                for own in hasher.short(words) if len(words) >= window else ():
                    found.append((row, own))
                    n += len(own[0])
                if n >= _ROWS:
                    yield told()
                    found, n = [], 0
        if n:
            yield told()

    return run


def _whole_windows(window: int):
    def run(batches):
        hasher, found, n = Hasher(window), [], 0

        def told() -> pa.RecordBatch:
            data, at = b"".join(x[3] for x in found), np.concatenate([x[2] for x in found])
            whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(data)]).cast(pa.binary())
            key, row = (np.concatenate([np.full(len(x[2]), x[k]) for x in found]) for k in range(2))
            return pa.record_batch([whole, pa.array(key), pa.array(row), pa.array(at.astype(np.int32))], names=["whole", "key", "row", "pos"])

        for b in batches:
            for key, row, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                at, data = hasher.whole(text.as_py().split(), [(x["first"], x["last"]) for x in spans])
                found.append((key, row, at, data))
                n += len(at)
                if n >= _ROWS:
                    yield told()
                    found, n = [], 0
        if n:
            yield told()

    return run


def _cut(window: int):
    def run(batches):
        for b in batches:
            ids, texts, n_words, n_removed = [], [], [], []
            for i, text, copy, starts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                words = text.as_py().split()
                n = len(words)
                gone = np.zeros(n + 1, np.int32)
                if copy and n >= window:
                    kept = []
                elif starts.is_valid:
                    at = np.array(starts.values, np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                else:
                    kept = words
                ids.append(i)
                texts.append(b" ".join(kept))
                n_words.append(n)
                n_removed.append(n - len(kept))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text (the words that stay, joined by one space), n_words, n_removed.

    A word goes if a window of that many consecutive words covers it whose word sequence also starts in a document with
    a smaller doc_id. Windows are judged on the input.

    A null or empty text has no words. A text of fewer words than the window loses none. A null doc_id is above all
    others; rows that share a doc_id are not smaller than each other. Repeated rows all come back. Other columns are
    ignored; an empty table gives an empty result.

    Cost: a text is hashed at once for all short lengths, at about one place in window / 2 words, to count the shortest and to find the repeated ones; each
    level's survivors go to the checkpoint folder, and a level moves its candidates twice. Texts move once, by document. Whole windows are made only where
    all shorter lengths are repeated, for one document of each group of equal texts, to count them and to find the repeated ones. A window that many hold reaches a
    reducer as one row a task, counted map-side.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("key"), text_key(text).alias("row"), text.alias("text"))
    texts = rows.select("row", F.col("text").cast("binary").alias("text"))
    same = F.unhex(F.md5(F.col("text").cast("binary")))

    alive = texts.mapInArrow(_short_windows(window), "short long, long long, row long, span long")
    for level in range(levels := len(lengths_of(window)) - 1):
        # with the shortest windows' hashes those of the longer ones up to this level: none of them, half of the long, or all of it
        own, keys = (alive.withColumn("grown", F.col("long").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))), ["short", "grown"]) if level == 1 else (alive, ["short", "long"][: 1 + level])
        repeated = own.groupBy(*keys).agg(F.min("row").alias("a"), F.max("row").alias("b")).where(F.col("a") < F.col("b")).select(*[apart(F.col(k)).alias(k) for k in keys])
        alive = own.join(repeated, keys, "left_semi").drop("grown")
        alive = saved(alive) if level < levels - 1 else alive
    first, last = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(F.lit((1 << 32) - 1).cast("long")).cast("int")
    alive = saved(alive.groupBy("row").agg(F.collect_set(F.struct(first.alias("first"), last.alias("last"))).alias("alive")))

    firsts = rows.select(same.alias("same"), "row", "key").groupBy("same").agg(F.min("key").alias("first"), F.min("row").alias("first_row"))
    spread = firsts.select("first", "first_row").join(alive.select(F.col("row").alias("first_row"), "alive"), "first_row")
    # all columns of rows go in, here as in the last join, so that one shuffle of the texts serves both
    around = rows.join(spread, (F.col("key") == F.col("first")) & (F.col("row") == F.col("first_row")))
    around = around.select("key", "row", F.col("text").cast("binary").alias("text"), "alive", "doc_id")
    # the same text may stand in several rows of one doc_id; its windows are then told twice, which changes nothing
    wholes = around.mapInArrow(_whole_windows(window), "whole binary, key long, row long, pos int")
    repeated = wholes.groupBy("whole").agg(F.min("key").alias("least"), F.max("key").alias("most")).where(F.col("least") < F.col("most"))
    later = wholes.join(repeated.select(apart_binary(F.col("whole")).alias("whole"), "least"), "whole").where(F.col("key") > F.col("least"))
    starts = later.groupBy("key", "row").agg(F.collect_set("pos").alias("starts")).select(F.col("key").alias("cut_key"), F.col("row").alias("cut_row"), "starts")

    copies = (
        rows.select(same.alias("same"), "key", "row")
        .join(firsts.select(apart_binary(F.col("same")).alias("same"), "first"), "same")
        .where(F.col("key") > F.col("first"))
        .select(F.col("key").alias("copy_key"), F.col("row").alias("copy_row"))
        .distinct()
        .withColumn("copy", F.lit(True))
    )
    whole = rows.join(starts, (F.col("key") == F.col("cut_key")) & (F.col("row") == F.col("cut_row")), "left")
    whole = whole.join(copies, (F.col("key") == F.col("copy_key")) & (F.col("row") == F.col("copy_row")), "left")
    cut = whole.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
    return cut.mapInArrow(_cut(window), "doc_id long, text binary, n_words long, n_removed long").withColumn("text", F.col("text").cast("string"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL: all windows of 50 words, spelled out.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS s FROM words
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM starts
), least AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(s, s + 50)))) AS g FROM windows JOIN least USING (h) WHERE first < doc_id GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, len(w) AS n_words, CASE WHEN g IS NULL THEN w ELSE [x FOR x, i IN w IF NOT list_contains(g, i)] END AS k FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
