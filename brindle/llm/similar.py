"""Links between texts whose sets of word shingles have at least a given Jaccard similarity.

MinHash bands put texts into buckets; texts that share a bucket are compared on all their shingles. First the bucket's
most typical text, the one with the most company over all bands, meets the others of its bucket, in chunks of bounded size,
and texts in a chunk meet each other. Buckets that the links found so far don't connect are then compared whole: every two
chunks that hold texts not yet connected meet in a task of their own. Tasks give spanning forests, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, saved, text_key
from .components import components
from .simhash import shingles

#: Texts and bytes of text in a chunk, about.
_TEXTS, _BYTES = 1024, 8 << 20
#: Hashes of texts that share a bucket, up to which they are broadcast to find these texts.
FEW = 500_000
#: Texts up to which a shingle's pairs are listed; those of more common ones come from a product of matrices.
_LISTED = 32


def _buckets(width: int, bands: int, rows: int, seed: int = 42):
    draws = np.random.default_rng(seed).integers(0, 1 << 63, (3, bands * rows), dtype=np.uint64)
    times, plus, mix = draws * np.uint64(2) + np.uint64(1)
    mix = mix.reshape(bands, rows)

    def bucket(data: bytes) -> np.ndarray:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for h in shingles(data, width):
            for k in range(0, len(h), 1024):
                np.minimum(least, (np.multiply.outer(times, h[k : k + 1024]) + plus[:, None]).min(axis=1), out=least)
        # the high bits vary most; a band's number is in its own factors
        return ((least.reshape(bands, rows) >> np.uint64(16)) * mix).sum(axis=1, dtype=np.uint64)

    def run(batches):
        for b in batches:
            marks = [bucket(x.as_py()) for x in b.column(1)]
            at = np.repeat(b.column(0).to_numpy(), bands)
            yield pa.record_batch([pa.array(at), pa.array((np.concatenate(marks) if marks else np.zeros(0, np.uint64)).view(np.int64))], names=["row", "bucket"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """For every two of sets (arrays of different values) how many values they share."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, own = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.repeat(np.arange(n), sizes)[np.argsort(own, kind="stable")]
    counts = np.bincount(own, minlength=len(values))
    starts = np.cumsum(counts) - counts
    both = np.zeros(n * n, np.int64)
    for d in range(2, min(_LISTED, n) + 1):
        if len(first := starts[counts == d]):
            members = at[first[:, None] + np.arange(d)]  # a row for each value, of the sets that hold it
            for k in range(0, len(members), 4096):
                part = members[k : k + 4096]
                both += np.bincount((part[:, :, None] * n + part[:, None, :]).ravel(), minlength=n * n)
    both = both.reshape(n, n)
    often = np.flatnonzero(counts > _LISTED)
    for k in range(0, len(often), 2048):
        part = np.zeros((n, min(2048, len(often) - k)), np.float32)
        for c, v in enumerate(often[k : k + 2048]):
            part[at[starts[v] : starts[v] + counts[v]], c] = 1
        both += (part @ part.T).astype(np.int64)
    both[np.diag_indices(n)] = sizes
    return both


def similar_pairs(texts: list[bytes], width: int, least: float) -> np.ndarray:
    """Which two of texts have the similarity least or more, by the sets of their shingles' 64-bit hashes. Texts without words have none."""
    sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(t, width)])) for t in texts]
    both, sizes = _common(sets), np.array([len(s) for s in sets])
    return (both > 0) & (both >= least * (sizes[:, None] + sizes[None, :] - both))


def _forest(rows: np.ndarray, near: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what the pairs in near do: a breadth-first tree of each component."""
    a, b, new = [], [], np.ones(len(rows), bool)
    for start in range(len(rows)):
        if not new[start]:
            continue
        new[start], queue = False, [start]
        for x in queue:
            found = np.flatnonzero(near[x] & new)
            new[found] = False
            a += rows[found].tolist()
            b += [int(rows[x])] * len(found)
            queue += found.tolist()
    return a, b


def _links(width: int, least: float):
    def run(group: pa.Table) -> pa.Table:
        rows, first = np.unique(group.column("row").to_numpy(), return_index=True)
        texts = [x.as_py() for x in group.column("text").take(first)]
        a, b = _forest(rows, similar_pairs(texts, width, least)) if len(rows) > 1 else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _chunks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / _TEXTS), F.ceil(size / _BYTES), F.lit(1)).cast("int")


def similar_links(docs: DataFrame, least: float = 0.8, width: int = 5, bands: int = 25, rows: int = 5, text_col: str = "text") -> DataFrame:
    """a, b: hashes of unequal texts (text_key) with a Jaccard similarity of least or more; they connect all such pairs that share a bucket.

    A pair of similarity s shares one with the probability 1 - (1 - s^rows)^bands: at 0.8 all but 5 in 100,000. Texts of fewer
    than width words are one shingle, those without words, null ones too, have no links. Only case of A-Z and blanks are ignored.
    Repeated texts count once. Other columns are ignored; an empty table has no links.

    Cost: texts are hashed in one scan; 16 bytes for each text and band are dealt by bucket. Texts that share a bucket move once to be kept, all texts if these are
    many, and again for each typical text that they meet and for each chunk that they must meet of buckets whose texts aren't connected. There the comparisons
    grow with the square of the bucket, in tasks of two chunks: texts that share buckets and aren't similar can't be told otherwise.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text_key(text).alias("row"), text.cast("binary").alias("text")).where(F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")) != "")
    marked = saved(texts.mapInArrow(_buckets(width, bands, rows), "row long, bucket long"))
    one = marked.groupBy("bucket").agg(F.min("row").alias("r"), F.max("row").alias("s")).where(F.col("r") != F.col("s")).select(apart(F.col("bucket")).alias("bucket"))
    members = saved(marked.join(one, "bucket").distinct())
    # a text's company is what it meets over all bands; the bucket's most typical text has the most
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    company = members.join(sizes.select(apart(F.col("bucket")).alias("bucket"), "n"), "bucket").groupBy("row").agg(F.sum("n").alias("company"))
    typical = members.join(company.select(apart(F.col("row")).alias("row"), "company"), "row").groupBy("bucket").agg(F.max(F.struct("company", "row")).alias("t"))
    typical = typical.select(apart(F.col("bucket")).alias("bucket"), F.col("t.row").alias("typical"))
    needed = members.select("row").distinct()
    needed = F.broadcast(needed) if needed.count() <= FEW else needed.select(apart(F.col("row")).alias("row"))
    own = saved(texts.join(needed, "row", "left_semi").dropDuplicates(["row"]))
    told = own.select(apart(F.col("row")).alias("row"), "text")

    def linked(tasks: DataFrame, keys: list[str]) -> DataFrame:
        return saved(tasks.join(told, "row").groupBy(*keys).applyInArrow(_links(width, least), "a long, b long"))

    stars = saved(members.join(typical, "bucket").select("typical", "row").where(F.col("row") != F.col("typical")).distinct())
    bytes_of = own.select(apart(F.col("row")).alias("row"), F.octet_length("text").alias("size"))
    chunks = stars.join(bytes_of, "row").groupBy("typical").agg(_chunks(F.count(F.lit(1)), F.sum("size")).alias("chunks"))
    tasks = stars.join(chunks.select(apart(F.col("typical")).alias("typical"), "chunks"), "typical")
    tasks = tasks.select("typical", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("i"), "row")
    each = chunks.select("typical", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.col("typical").alias("row"))
    links = linked(tasks.unionByName(each), ["typical", "i"])

    roots = components(links).select(apart(F.col("node")).alias("row"), "root")
    placed = saved(members.join(roots, "row", "left").select("bucket", "row", F.coalesce("root", "row").alias("root")))
    parts = placed.join(bytes_of, "row").groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    # the bucket's largest component needs no comparison within itself; the others are chunked together
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", "root", "size")).alias("big"), F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("n") > F.col("big.n"))
    split = split.select(
        apart(F.col("bucket")).alias("bucket"), F.col("big.root").alias("big"), _chunks(F.col("big.n"), F.col("big.size")).alias("n_big"), _chunks(F.col("n") - F.col("big.n"), F.col("size") - F.col("big.size")).alias("n_rest")
    )
    rest = placed.join(split, "bucket")
    in_big, draw = F.col("root") == F.col("big"), F.xxhash64("row")
    at = F.when(in_big, F.pmod(draw, F.col("n_big")) + F.col("n_rest")).otherwise(F.pmod(draw, F.col("n_rest"))).cast("int")
    meets = F.when(in_big, F.sequence(F.lit(0), F.col("n_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_rest") + F.col("n_big") - 1))
    tasks = rest.select("bucket", "row", F.explode(F.transform(meets, lambda k: F.struct(F.least(k, at).alias("i"), F.greatest(k, at).alias("j")))).alias("p"))
    return links.unionByName(linked(tasks.select("bucket", "row", "p.i", "p.j"), ["bucket", "i", "j"]))


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (doc_id, row and root, as of simhash_components) with those that links between rows connect made one."""
    groups = saved(groups)
    first = groups.groupBy("root").agg(F.min("row").alias("b"))
    own = groups.select(F.col("row").alias("a"), "root").distinct().join(first.select(apart(F.col("root")).alias("root"), "b"), "root").select("a", "b")
    roots = components(own.unionByName(links)).select(apart(F.col("node")).alias("row"), F.col("root").alias("wider"))
    return groups.join(roots, "row", "left").select("doc_id", "row", F.coalesce("wider", "row").alias("root"))
