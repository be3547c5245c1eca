"""SimHash near-dedup with vantage-point trees.

Fingerprints that differ in few bits are linked. A vantage-point tree over all 64 bits prunes nothing here: distances of
unlike texts crowd around 32, and nearly all of them lie within the search radius of any split. So the bits are cut
into blocks and each choice of some blocks has a tree of its own, with the Hamming distance on those blocks as its metric: two
fingerprints at most radius bits apart differ in few bits, the tree's slack, on some choice. In that tree the triangle
bound is tight: the distances of such a pair to a vantage point differ by the slack at most. Each level
splits at the data's median distance from a vantage point; a fingerprint within the slack of the split goes to both sides, so
every pair meets in some shard, where the full distances are computed. With as many blocks as leave a choice that the pair's bits
spare, the slack is 0: the bound then separates all that differ, nothing is copied, and the rows dealt for a fingerprint are the number of trees.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, packed, saved, table, text_key
from .components import components

_PIECE = 1 << 20


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size. bytes.split() splits at [\\x20\\x09-\\x0D], bytes.lower() changes A-Z alone."""
    if len(data) <= _PIECE:
        yield data.lower().split()
        return
    start = 0
    while start < len(data):
        end = min(start + _PIECE, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield data[start:end].lower().split()
        start = end


def shingles(data: bytes | None, width: int) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's shingles of width words, in arrays of bounded size; fewer words are one shingle."""
    few, last = True, []
    for words in _words(data or b""):
        words = last + words
        if len(words) >= width:
            digest = xxhash.xxh64_digest
            yield np.frombuffer(b"".join([digest(x, 42) for x in map(b" ".join, zip(*[words[i:] for i in range(width)]))]), ">u8").astype(np.uint64)
            few = False
        last = words[max(0, len(words) - width + 1) :]
    if few and last:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), 42)], np.uint64)


def fingerprint(data: bytes | None, width: int = 4) -> int:
    """The 64-bit SimHash, unsigned, of a text's shingles of width words."""
    counts, n, last = np.zeros(64, np.int64), 0, []
    for words in _words(data or b""):
        words = last + words
        if len(words) >= width:
            digest = xxhash.xxh64_digest
            hashes = np.frombuffer(b"".join([digest(x, 42) for x in map(b" ".join, zip(*[words[i:] for i in range(width)]))]), np.uint8).reshape(-1, 8)
            for k in range(0, len(hashes), 1 << 16):
                counts += np.unpackbits(hashes[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int32)
            n += len(hashes)
        last = words[max(0, len(words) - width + 1) :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(last), 42) if last else 0
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches):
        for b in batches:
            marks = np.array([fingerprint(x.as_py(), width) for x in b.column(2)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(marks)], names=["doc_id", "row", "mark"])

    return run


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of the text), mark (the fingerprint as a signed long) for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("row"), text.cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(width), "doc_id long, row long, mark long")


def slack_of(radius: int, blocks: int, chosen: int) -> int:
    """In how many bits two fingerprints radius apart differ at most on the choice of blocks where they differ least: the worst is an even spread."""
    each, more = divmod(radius, blocks)
    return chosen * each + max(0, chosen - (blocks - more))


class Tree:
    """A choice of blocks of bits, its vantage points and, once they are set, its splits."""

    def __init__(self, view: int, mask: int, slack: int, depth: int, seed: int = 42):
        rnd = random.Random(f"{seed}:{view}")
        self.view, self.mask, self.slack = view, mask, slack
        self.points = [rnd.getrandbits(64) & mask for _ in range(depth)]
        self.splits = [mask.bit_count() // 2] * depth

    def distances(self, marks: np.ndarray, level: int) -> np.ndarray:
        return np.bitwise_count((marks & np.uint64(self.mask)) ^ np.uint64(self.points[level])).astype(np.int64)

    def shards(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in marks and shard numbers; one on a boundary stands in both shards.

        Left holds distances up to split, right those from split + 1 - slack: a pair at most slack apart is whole on one side.
        """
        at, path = np.arange(len(marks)), np.zeros(len(marks), np.int64)
        for level, split in enumerate(self.splits):
            d = self.distances(marks[at], level)
            left, right = d <= split, d >= split + 1 - self.slack
            at, path = np.concatenate([at[left], at[right]]), np.concatenate([path[left] * 2, path[right] * 2 + 1])
        return at, path


def trees_of(radius: int, blocks: int, chosen: int, depth: int) -> list[Tree]:
    """A tree for each choice of blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in own) for own in combinations(range(blocks), chosen)]
    return [Tree(v, mask, slack_of(radius, blocks, chosen), depth) for v, mask in enumerate(masks)]


def _measured(trees: list[Tree]):
    """view, level, d and n: how many marks lie at each distance from each vantage point."""

    def run(batches):
        counts = [np.zeros((len(t.points), 65), np.int64) for t in trees]
        for b in batches:
            marks = b.column(0).to_numpy().view(np.uint64)
            for t, own in zip(trees, counts):
                for level in range(len(t.points)):
                    own[level] += np.bincount(t.distances(marks, level), minlength=65)
        found = [(t.view, level, d, int(own[level, d])) for t, own in zip(trees, counts) for level, d in zip(*np.nonzero(own))]
        yield pa.record_batch([pa.array([int(x[k]) for x in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["view", "level", "d", "n"])

    return run


def split_by(trees: list[Tree], marks: DataFrame) -> None:
    """Sets each level's split to the median distance of marks. What comes to the driver has a row for each tree, level and distance."""
    found = marks.select("mark").mapInArrow(_measured(trees), "view int, level int, d int, n long").groupBy("view", "level", "d").agg(F.sum("n").alias("n")).collect()
    counts = {}
    for r in found:
        counts.setdefault((r["view"], r["level"]), np.zeros(65, np.int64))[r["d"]] = r["n"]
    for t in trees:
        for level in range(len(t.points)):
            if (t.view, level) in counts:
                sums = np.cumsum(counts[t.view, level])
                # of the two splits around the median the one that parts the marks more evenly
                k = int(np.searchsorted(sums, sums[-1] / 2))
                t.splits[level] = k - 1 if k and sums[-1] / 2 - sums[k - 1] < sums[k] - sums[-1] / 2 else k


def _dealt(trees: list[Tree]):
    def run(batches):
        for b in batches:
            marks = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(marks), 4096):
                part = marks[k : k + 4096]
                for tree in trees:
                    at, path = tree.shards(part)
                    yield pa.record_batch([pa.array(np.full(len(at), tree.view, np.int32)), pa.array(path), pa.array(part[at].view(np.int64))], names=["view", "shard", "mark"])

    return run


def linked(marks: np.ndarray, radius: int) -> np.ndarray:
    """For each of marks (distinct, unsigned) the place of the first that it is linked to within marks, by any chain."""
    n = len(marks)
    root = np.arange(n)
    for k in range(0, n, 256):
        near = np.bitwise_count(marks[k : k + 256, None] ^ marks[None, :]) <= radius
        rows = np.flatnonzero(near.sum(axis=1) > 1)
        if not len(rows):
            continue
        near = near[rows]
        columns = np.flatnonzero(near.any(axis=0))
        near, rows = near[:, columns], rows + k
        while True:
            least = np.where(near, root[columns][None, :], n).min(axis=1)  # of each row's neighbours, itself included
            reach = np.minimum(root[columns], np.where(near, least[:, None], n).min(axis=0))
            to = np.arange(n)
            np.minimum.at(to, root[columns], reach)
            np.minimum.at(to, root[rows], least)
            if (to == np.arange(n)).all():
                break
            while not (to[to] == to).all():
                to = to[to]
            root = to[root]
    return root


def _edges(radius: int):
    def run(group: pa.Table) -> pa.Table:
        marks = np.unique(group.column("mark").to_numpy()).view(np.uint64)
        root = linked(marks, radius)
        own = np.flatnonzero(root != np.arange(len(marks)))
        return pa.table({"a": marks[own].view(np.int64), "b": marks[root[own]].view(np.int64)})

    return run


def planned(n: int, radius: int, leaf: int, blocks: int | None = None, chosen: int = 1) -> tuple[int, int, int]:
    """Blocks, how many of them a tree takes, and the trees' depth, for n marks. Unless blocks are given the slack is 0: radius + 1 blocks
    leave one that a pair's bits spare, and one more block one more that they spare, until the spared bits can tell enough shards apart."""
    if n <= leaf:
        return 1, 1, 0
    if blocks is None:
        most = min(64, radius + 4)
        blocks = next((b for b in range(radius + 1, most) if 64 * (b - radius) // b >= log2(n / leaf)), most)
        chosen = max(1, blocks - radius)
    # vantage points see much alike, so it takes twice the levels of halves; with copies on boundaries the fewest that do
    depth = 2 * ceil(log2(n / leaf)) if not slack_of(radius, blocks, chosen) else ceil(log2(n / leaf) / -log2(0.6))
    return blocks, chosen, min(depth, 62)


def links(marks: DataFrame, radius: int = 4, blocks: int | None = None, chosen: int = 1, leaf: int = 1000, most: int = 8192) -> DataFrame:
    """a, b: edges that connect what the pairs of marks (distinct longs, column mark) within radius bits connect.

    Each shard gives a spanning forest of its pairs, not the pairs: fewer rows than it holds. The trees' number and depth follow
    the number of marks (see planned), so shards hold about leaf of them. A shard with more than most (marks that crowd together) is
    dealt into chunks and every two chunks meet in a task of their own.
    """
    n = marks.count()
    blocks, chosen, depth = planned(n, radius, leaf, blocks, chosen)
    trees = trees_of(radius, blocks, chosen, depth)
    if depth:
        split_by(trees, marks)
    dealt = marks.select("mark").mapInArrow(_dealt(trees), "view int, shard long, mark long")
    full = dealt.groupBy("view", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    full = full.select("view", apart(F.col("shard")).alias("shard"), F.ceil(F.col("n") / (most // 2)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    parts = dealt.join(full, ["view", "shard"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    parts = parts.select("view", "shard", "mark", F.explode(tasks).alias("part"))
    return parts.groupBy("view", "shard", "part.i", "part.j").applyInArrow(_edges(radius), "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """doc_id, row, fingerprint (16 hex digits), component_id, root for each row of docs.

    Fingerprints at most radius bits apart are linked; component_id is the least doc_id reachable through links, the
    document's own included, and root is one fingerprint for each component.

    A null or empty text, or one of blanks alone, has the fingerprint zero and is linked like any other. A null doc_id
    links documents but is never the least; a component of null ids alone has a null component_id. Repeated rows
    all come back. Other columns are ignored; an empty table gives an empty result.

    Cost: texts are read once and never move. Equal fingerprints are merged map-side before the trees see them; all that
    follows handles 16 bytes for each distinct fingerprint.
    """
    marked = saved(fingerprints(docs, width, id_col, text_col))
    marks = marked.groupBy("mark").agg(F.min("doc_id").alias("first"))
    roots = components(links(marks, radius, **tree)).select(F.col("node").alias("mark"), "root")
    rooted = marks.join(roots, "mark", "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).select(apart(F.col("root")).alias("root"), "component_id")
    labels = rooted.select("mark", "root").join(least, "root").select(apart(F.col("mark")).alias("mark"), "root", "component_id")
    return marked.join(labels, "mark").select("doc_id", "row", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id", "root")


def near_dedup(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", similar: float | None = None) -> DataFrame:
    """docs with one row of each component: the least doc_id (a null one only if there is no other), whole as it was.

    With similar, texts whose shingles of five words have that Jaccard similarity are linked too, however far their fingerprints.

    Null and empty texts, and those of blanks alone, have the fingerprint zero and are copies of each other. Of repeated rows one stays. Other columns may have any
    name; an empty table gives an empty result. Texts move once to those of them that stay, and as similar_links() says.
    """
    groups = simhash_components(docs, width, radius, id_col, text_col)
    if similar is not None:
        from .similar import joined, similar_links

        groups = joined(groups, similar_links(docs, similar, text_col=text_col))
    keepers = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k"))
    # null ids have a key of their own; equal keys on both sides serve the join and the choice among repeated rows, so documents move once
    keyed = lambda df, c: df.withColumn("none", F.col(c).isNull()).withColumn("key", F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")))
    keepers = keyed(keepers.select(F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("row")), "keep_id").select("none", "key", "row")
    kept = keyed(packed(docs, id_col, text_col), "doc_id").join(keepers, ["none", "key", "row"])
    return kept.groupBy("none", "key", "row").agg(F.first("doc").alias("doc")).select("doc.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
