"""Rows that share a key: none is lost, none is compared with itself."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallywind.llm import ann, jaccard, repeats


def test_one_id_with_many_vectors_hides_no_neighbour(spark):
    rng = random.Random(3)
    rows = [(0, [0.0, 1.0])] + [(7, [1e-3 * rng.random(), 1.0]) for _ in range(400)]
    rows += [(100 + i, [rng.uniform(0.1, 1), rng.uniform(0.1, 1)]) for i in range(200)] + [(7, [5e-4, 1.0])] * 300
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.search(vectors, F.col("vec_id") == 0, reach=1.0).orderBy("rank").collect()]
    best = {}
    for v, x in rows[1:]:
        best[v] = min(best.get(v, 9), (x[0] ** 2 + (x[1] - 1) ** 2) ** 0.5)
    assert got == sorted(best, key=lambda v: (best[v], v))[:10]


def test_few_vectors_are_all_found(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in ann.search(vectors, F.col("vec_id") == 2).orderBy("rank").collect()]
    assert got == [(2, 1), (2, 3), (2, 0), (2, 4)]


def test_query_blocks_are_not_broadcast(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = ann.search(vectors, F.col("vec_id") % 10 == 0, parts=4)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[part", plan)


A, B, C = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")


@pytest.mark.parametrize("rows, want", [
    ([(1, A), (1, A), (2, B), (2, A)], [(1, A), (2, B)]),
    ([(1, A), (2, A), (3, A + " more"), (4, B)], [(1, A), (4, B)]),
    ([(None, A), (None, A), (3, A), (3, B), (3, C), (9, "")], [(None, A), (None, A), (3, A), (3, B), (3, C), (9, "")]),
    ([(5, B), (5, B), (5, B)], [(5, B)]),
])
def test_deduplicate_by_row(spark, rows, want):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, text_hash int")
    got = [(r["doc_id"], r["text"]) for r in jaccard.deduplicate(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_equal_rows_share_their_spans_once(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(900))
    docs = spark.createDataFrame([(1, long)] * 60 + [(2, "short")], "doc_id long, text string")
    found = repeats.repeated_windows(docs).groupBy("doc_id").agg(F.count_distinct("first", "last").alias("kinds")).collect()
    assert len(found) == 1 and found[0]["kinds"] < 900
    out = repeats.digests(repeats.remove_repeats(docs)).collect()
    assert {(r["doc_id"], r["n_removed"], r["text"]) for r in out} == {(1, 900, ""), (2, 0, "short")} and len(out) == 61


# -- copies of benchmark items that are not letter by letter

ITEM = "Tom has 5 apples and Mary gives Tom 3 kg of pears so how much does Tom carry home to Berlin on Monday"
COPIES = {
    1: ITEM, 2: ITEM.lower(), 3: ITEM.upper(), 4: ITEM.replace(" Tom", "\nTom").replace(" Berlin", '\n"Berlin"'),
    5: "Bob has 7 apples and Anna gives Bob 12 kg of pears so how much does Bob carry home to Paris on Friday",
    6: "noise before it " + ITEM.replace("3 kg", "4kg") + " and noise after it",
}
CLEAN = {
    11: "Bob has 7 apples and Anna gives Max 12 kg of pears but who of them does all of this by hand",
    12: "nothing to see here at all", 13: "", 14: None,
    15: " ".join(["Tom has 5 apples", "Berlin on Monday", "pears so how"]),
}


def canonical(spark, items, texts):
    from tallywind.llm import decontaminate
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["changed"], r["n_hits"], r["n_windows"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_copies_in_other_case_with_other_lines_or_other_values(spark):
    got = canonical(spark, {1: ITEM}, {**COPIES, **CLEAN})
    assert {d for d, _ in got} == set(COPIES)
    assert all(got[d, 1][0] == 0 for d in (1, 2, 3, 4)) and got[5, 1][0] >= 5 and got[6, 1][0] == 1


def test_short_items_are_whole_lines(spark):
    texts = {1: "first\nWhat is it?\nlast", 2: "so what is it then", 3: "WHAT IS IT", 4: "what\nis it"}
    assert {d for d, _ in canonical(spark, {7: "What is it?", 8: " .. ", 9: None}, texts)} == {1, 3}


def test_items_of_names_are_found_as_they_stand(spark):
    names = "Anna Berta Carla Dora Emma Frida Greta Hanna Ida Jana"
    got = canonical(spark, {1: names}, {1: names, 2: names.lower(), 3: "Uwe Ulf Udo Uli Una Uta Ute Uri Ugo Umo", 4: names.replace(" ", ", ")})
    assert {d for d, _ in got} == {1, 2, 4}


def brute_windows(text):
    """Folded words and their templates by plain Python."""
    import re

    from tallywind.llm.decontaminate import UNITS
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text or "")
    text = re.sub(rf"(?<=[0-9])(?=(?:{units})(?![^\W_]))", " ", text, flags=re.I)
    raw = [w for w in re.split(r"[^\w]+|_+", text) if w]
    kinds = []
    for i, w in enumerate(raw):
        number = lambda x: re.fullmatch(r"[0-9][0-9]*", x) is not None
        kinds.append("#n" if number(w) else "#u" if i and number(raw[i - 1]) and w.lower() in UNITS
                     else "#a" if w[0].isupper() and w[1:2].islower() else w.lower())
    return [w.lower() for w in raw], kinds


def brute_contaminated(items, texts):
    """Pairs of document and item by sliding every item over every document."""
    read = {k: brute_windows(t) for k, t in texts.items()}
    out = set()
    for item, text in items.items():
        folded, kinds = brute_windows(text)
        size = min(8, len(folded))
        if size < 5:
            continue
        n = len(folded) - size + 1
        need = min(6, n)
        for doc, (words, types) in read.items():
            for shift in range(-len(folded), len(words)):
                def hit(p):
                    a, b = p, p + shift
                    if b < 0 or b + size > len(words):
                        return None
                    if folded[a:a + size] == words[b:b + size]:
                        return []
                    slots = sum(k[0] == "#" for k in kinds[a:a + size])
                    if kinds[a:a + size] == types[b:b + size] and 0 < 2 * slots <= size:
                        return [(kinds[a + i], folded[a + i], words[b + i]) for i in range(size) if kinds[a + i][0] == "#"]
                    return None
                hits = [hit(p) for p in range(n)]
                for p in range(n - need + 1):
                    run = hits[p:p + need]
                    if None in run:
                        continue
                    pairs = {x for h in run for x in h}
                    if len({x[:2] for x in pairs}) == len(pairs):
                        out.add((doc, item))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_contamination_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["has", "and", "gives", "so", "Tom", "Anna", "5", "7", "12", "kg", "of", "how", "3.5", "what"]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 7, 9, 14, 20]))) for i in range(6)}
    texts = {}
    for d in range(60):
        base = items[rng.randrange(6)].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        swap = {"Tom": rng.choice(["Tom", "Bob", "Eva"]), "5": rng.choice(["5", "9"]), "kg": rng.choice(["kg", "cm"])}
        base = [swap.get(w, w) if rng.random() < 0.95 else w for w in base]
        lead = [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))]
        text = rng.choice([" ", "\n", ", "]).join(lead + base)
        texts[d] = rng.choice([text, text, text.lower(), text.upper()])
    want = brute_contaminated(items, texts)
    assert len(want) > 10 and set(canonical(spark, items, texts)) == want
