import random
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
WORDS = "stone river cloud amber field north winter garden copper silent bridge morning window paper candle forest harbour meadow violet thunder".split()


def prose(seed, n):
    """n words; unlike for different seeds."""
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "s", "ed", "er", "ly")) for _ in range(n))


def odd_texts():
    """Texts at the edges: null, empty, blanks, ties, repeats, very long, many lines, other scripts."""
    shared = prose("passage", 60)
    near = prose("near", 400)
    line = "This licence line is long enough to count and stands in many documents."
    texts = [
        None, None, "", "", " ", "\n", "\n\n", "\t \x0b\x0c\r", "a", "A", "one two three", "ONE  two\tTHREE", "word " * 3000, "x" * 20_000, "中文 字" * 40, "é" * 60 + "\n" + "😀 " * 30,
        prose(1, 80), prose(1, 80), prose(1, 80).upper(), prose(2, 3000), prose(3, 55) + " " + shared, shared + " " + prose(4, 70), prose(5, 30) + " " + shared + " " + prose(6, 30) + " " + shared,
        near, near + " end", near.replace("stone", "Stone"), "\n".join([line] * 3 + [prose(7, 60)]),
        *[f"{line.upper() if k % 2 else '  ' + line}\n{prose(100 + k, 90)}\n{line}" for k in range(8)],
        "a b c d　e", "\x1c\x1d word\x1e", "tail\n", "\nhead", "#*$%&|<>" * 20,
    ]
    return texts


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables at the edges, whose columns' names could clash with an operator's own."""
    at = tmp_path_factory.mktemp("odd")
    rows = [(i, t, ["en", "de", None][i % 3], ["web", None, "a.b"][i % 3], len(t or ""), "row", i, "doc") for i, t in enumerate(odd_texts())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, keep_id int, doc string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    shared = prose("passage", 60).split()
    items = [(1, " ".join(shared[5:30])), (2, "ONE, two; three!"), (3, None), (4, ""), (5, "..."), (6, " ".join(shared[40:53])), (7, prose("other", 40)), (10, " ".join(shared[5:30])), (None, "a"), (8, "a")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    """The same tables without rows."""
    at = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="session", params=["odd", "data"])
def folder(request):
    if request.param == "odd":
        return request.getfixturevalue("odd")
    if not DATA.exists():
        pytest.skip("the test tables aren't here")
    return str(DATA)


def texts_of(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def rows_by_id(df):
    out = {}
    for r in df.collect():
        assert r["doc_id"] not in out
        out[r["doc_id"]] = r
    return out
