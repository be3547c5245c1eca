"""Language ID by compression: a text is in the language whose dictionary makes it smallest.

Each language has a raw-content dictionary for zstandard, pieces of its labelled texts. A text is cut into pieces, each
compressed alone with every dictionary, and the sums of the sizes are compared. On both sides letters are lower-cased, since a
text in capitals shares few bytes with any dictionary, and what stands between letters becomes one space.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

_PIECE = 2048
_HEADER = 2  # bytes of a frame without size, checksum or dictionary id, about: the same for all languages


def plain(text: Column) -> Column:
    """The letters of a text in lower case, and a space for what stands between."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def held_out(id_col: str) -> Column:
    """Whether the remainder of the id's CRC-32 by 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, texts: int = 48, long: int = 16_384, most_langs: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, those with more texts first: whole texts of it, at most texts of them, those with the least hashes; texts of over long
    characters teach only where there aren't enough others.

    Rows without a text, a label or an id, and those held out, teach nothing. Copies of a text count once. Over most_langs
    different labels are an error.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), (F.char_length(text_col) > long).alias("long"), held_out(id_col).alias("out"), F.col(id_col).alias("id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~F.col("out"))
    number = lambda of: F.approx_count_distinct(F.when(of, F.col("h")), 0.02)
    counts = rows.groupBy("lang").agg(number(~F.col("long")).alias("n_usual"), number(F.col("long")).alias("n_long"), F.count(F.lit(1)).alias("n"))
    # the hashes below this bound hold the texts asked for, with a margin, and few more
    part = lambda n: F.least(F.lit(1.0), F.lit(2.0 * texts + 50) / F.greatest(F.col(n), F.lit(1)))
    counts = saved(counts.select("lang", "n", part("n_usual").alias("part"), F.when(F.col("n_usual") < 2 * texts, part("n_long")).otherwise(-1.0).alias("part_long")))
    if counts.count() > most_langs:
        raise ValueError(f"over {most_langs} labels; every task would hold a dictionary for each")
    few = rows.join(F.broadcast(counts.select("lang", "part", "part_long")), "lang")
    few = few.where((F.col("h") / float(1 << 63) + 1) / 2 <= F.when(F.col("long"), F.col("part_long")).otherwise(F.col("part")))
    few = saved(few.select("lang", "long", "h", plain(F.col("text")).alias("piece")).dropDuplicates(["lang", "h"]))
    out = {}
    for lang in [r[0] for r in counts.orderBy(F.desc("n"), "lang").select("lang").collect()]:
        pieces = few.where(F.col("lang") == lang).orderBy("long", "h").limit(texts).select("piece").collect()
        out[lang] = "\n".join(r[0] for r in pieces).encode()
    return out


def _classify(dictionaries: dict[str, bytes], margin: float, level: int):
    def run(batches):
        params = zstandard.ZstdCompressionParameters.from_level(level, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        tools = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            tools.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        langs = list(dictionaries)
        for b in batches:
            preds, scores, rejected = [], [], []
            for text, letters in zip(b.column(2), b.column(3).to_pylist()):
                data = text.as_py()
                if not letters or not langs:
                    preds.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                sizes = [0] * len(langs)
                for k in range(0, len(data), _PIECE):
                    piece = data[k : k + _PIECE]
                    for i, compress in enumerate(tools):
                        sizes[i] += len(compress(piece)) - _HEADER
                first, *rest = sorted(zip(sizes, range(len(langs))))
                score = 1.0 if not rest else min(1.0, max(0.0, (rest[0][0] - first[0]) / max(1, rest[0][0])))
                preds.append(langs[first[1]])
                scores.append(score)
                rejected.append(score < margin)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, margin: float = 0.02, level: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is the language whose dictionary leaves the fewest bytes, the first of those that tie. score is the share by which
    the second best is larger, from 0 to 1 (1 if there is one language alone); a prediction with a score under margin is rejected.
    dictionaries is learn(docs) unless given; the prediction sees the text alone.

    A null text, or one without a letter, is und with score 0, rejected; so are all if no language could be learned. Repeated
    rows all come back. Other columns are ignored; an empty table gives an empty result.

    Cost: two scans to learn, one to predict; texts never move. The driver and each task hold a dictionary of fixed size for
    each language.
    """
    dictionaries = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col) if dictionaries is None else dictionaries
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), plain(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text"), letters.alias("letters"))
    return rows.mapInArrow(_classify(dictionaries, margin, level), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
