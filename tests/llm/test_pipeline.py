"""The pipeline, stage by stage, each against brute force on what its predecessor kept."""

import hashlib

import corpus_pipeline
from brindle.llm import bpe, quality

from .conftest import DATA
from .test_lines_and_passages import brute_hits, brute_lines, words
from .test_similar import pairs
from .test_simhash import fingerprint, roots

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, folder, tmp_path):
    import tiktoken

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = kept(docs), docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(at := f"{tmp_path}/{k}")
        docs = spark.read.parquet(at)
        stages.append(kept(docs))
        assert docs.columns == columns or k == 4

    verdicts = kept(quality.judge(spark.read.parquet(f"{folder}/documents.parquet")))
    assert stages[0] == {i: r for i, r in before.items() if verdicts[i]["kept"]}

    lines = {i: t for i, t, *_ in brute_lines([(i, r["text"]) for i, r in stages[0].items()], 40, 5)}
    assert {i: r["text"] for i, r in stages[1].items()} == lines
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == before[i]["lang"] for i, r in stages[1].items())

    marks = {i: fingerprint(r["text"]) for i, r in stages[1].items()}
    near = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
    group = roots(sorted(marks), near + pairs([(i, r["text"]) for i, r in stages[1].items()]))
    assert stages[2] == {i: r for i, r in stages[1].items() if group[i] == i}

    rows = [(i, r["text"]) for i, r in stages[2].items()]
    whole = [(k, t) for k, t in items if len(words(t)) >= 13]
    bad = {i for i, *_, contaminated in brute_hits(rows, items, 13) if contaminated} | {i for i, _, n_hit, *_ in brute_hits(rows, whole, 13) if n_hit}
    assert stages[3] == {i: r for i, r in stages[2].items() if i not in bad}

    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    assert stages[4].keys() == stages[3].keys()
    for i, r in stages[4].items():
        text = stages[3][i]["text"]
        assert r["ids"] == reference.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    if folder == str(DATA):
        assert len(before) > len(stages[0]) > len(stages[2]) > len(stages[3]) > 0

    whole = kept(corpus_pipeline.run(spark, folder))
    assert {i: r["ids"] for i, r in whole.items()} == {i: r["ids"] for i, r in stages[4].items()}
