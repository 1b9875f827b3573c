import re
from collections import Counter

import corpus_pipeline
import pytest
from fieldloom.llm import queries, quality_rules

from .test_near import brute

sf = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{sf}/documents.parquet"), *out]


def test_each_stage_against_a_plain_version(spark, steps):
    rows = [[r.asDict() for r in s.collect()] for s in steps]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    model = quality_rules.train(steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality_rules.score(steps[0], model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in rows[1]} == good
    first = {}
    for r in sorted(rows[1], key=lambda r: r["doc_id"]):
        first.setdefault(norm(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(first.values())
    ordered = sorted(rows[2], key=lambda r: r["doc_id"])
    alone = [r["doc_id"] for (_, c), (i, r) in zip(brute([r["text"] for r in ordered], 5, 80, 100), enumerate(ordered)) if c == i]
    assert sorted(r["doc_id"] for r in rows[3]) == alone
    texts = {r["doc_id"]: (r["text"] or "").split() for r in rows[3]}
    times = Counter()
    for r in rows[4]:
        words = r["text"].split()
        times[r["doc_id"]] += len(words)
        assert not Counter(words) - Counter(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert all(times[i] <= 2 * len(w) for i, w in texts.items())
    assert len(rows[5]) == len(rows[4]) and all(r["round_trip"] for r in rows[5])


def test_run_gives_the_last_stage(spark, steps):
    key = lambda r: (r.doc_id, r.text_sha256)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, steps[-1].collect()))


def test_five_known_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
