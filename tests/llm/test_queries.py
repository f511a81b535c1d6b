"""The registered queries on the smallest tables: against SQL where there is one, else against
brute force or held-out labels; and the pipeline against its stages done by hand."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from harness import connect, difference
from pyspark.sql import functions as F

from tallywind.llm import quality
from tallywind.llm.queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import WORD, brute_classes, brute_nearest, brute_repeats  # noqa: E402

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_matches_sql(spark, key):
    assert difference(QUERIES[key](spark, SF), connect(SF), ORACLES[key]) is None


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_ann_query_recalls_nine_of_ten(spark, sf):
    import numpy as np
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op1_ann"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([v for _, v in rows], float)
    hits = wanted = 0
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            d = dict(zip((v for v, _ in rows), np.sqrt(((x - x[i]) ** 2).sum(axis=1))))
            near = sorted((d[v], v) for v, _ in rows if v != q)[:10]
            found = sorted(got[q])
            assert [r[0] for r in found] == list(range(1, 11)) and [(r[2], r[1]) for r in found] == sorted((d[r[1]], r[1]) for r in found)
            hits += len({v for _, v in near} & {r[1] for r in found})
            wanted += 10
    assert hits >= 0.9 * wanted and brute_nearest([]) == {}


def test_jaccard_query_matches_brute_force(spark):
    want = brute_classes(documents(spark))
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op6_jaccard"](spark, SF).collect()} == want


def test_repeats_query_matches_brute_force(spark):
    want = brute_repeats([(r[0], r[1]) for r in documents(spark)], 400)
    got = QUERIES["op5_repeats"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want


def words_of(text):
    return " ".join(re.findall(r"\w+", text.lower()))


def leaks(spark, docs):
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return {d[0] for d in docs if any(i in words_of(d[1]) for i in items)}


def test_decontamination_query_finds_every_copy(spark):
    assert {r["doc_id"] for r in QUERIES["op10_decontaminate"](spark, SF).collect()} >= leaks(spark, documents(spark))


def test_toxicity_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.93 * len(rows)


def test_pii_query_leaves_no_valid_card_as_it_was(spark):
    before = {r[0]: r[1] for r in documents(spark)}
    for r in QUERIES["op7_pii"](spark, SF).collect():
        old = before[r["doc_id"]]
        mails = re.findall(r"[a-z]+\.\d+@mail\d\.example\.com", old)
        assert not any(m in r["text"] for m in mails)
        assert len(r["text"]) > 0 or not old
        if not re.search(r"[0-9@=:]|AKIA|ASIA", old):
            assert r["text"] == old


def test_pipeline_does_what_its_stages_say(spark):
    import corpus_pipeline
    docs = documents(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    good = {r["doc_id"] for r in judged.filter("keep").collect()}
    rows = [d for d in docs if d[0] in good]
    classes = brute_classes(rows)
    rows = [d for d in rows if classes.get(d[0], d[0]) == d[0]]
    rows = [d for d in rows if d[0] not in leaks(spark, rows)]
    size = {d[0]: len(WORD.findall(d[1] or "")) for d in rows}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} <= set(size) and all(0 < r["taken"] <= 3 * r["size"] for r in out)
    taken, target, source = Counter(), {}, Counter()
    for d in rows:
        source[d[3]] += size[d[0]]
    for r in out:
        assert r["source_size"] == source[r["source"]]  # pseudonyms keep the number of words
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert abs(sum(target.values()) - sum(source.values())) <= 1
