"""The near-duplicate stage against brute force over sets of 5-word shingles."""

import random
from fractions import Fraction

import corpus_pipeline
from panelweave.llm import jaccard
from tests.llm.test_operators import sentence


def plain_roots(texts):
    """For each text the first text of its component; links are pairs of similarity 0.8 or more."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if sets[i] == sets[j] or Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(4, 5):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def changed(rng, text, n):
    """The text with n words replaced, far from each other."""
    words = text.split()
    for k in range(n):
        words[(2 * k + 1) * len(words) // (2 * n)] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def near_texts(rng):
    texts = []
    for n in (1, 2, 3, 4, 5, 6, 7):  # of 200 words: similarity 0.95 to 0.7
        for _ in range(4):
            t = sentence(rng, 200)
            texts += [t, changed(rng, t, n)]
    base = sentence(rng, 200)
    return [*texts, *(changed(rng, base, 2) for _ in range(40)), "a b", "A  b", "a c"]


def test_near_dedup_keeps_one_of_each_group(spark):
    texts = near_texts(random.Random(5))
    root = plain_roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(root)) and len(got) < len(texts) - 45


def test_cells_lose_no_link(spark):
    texts = near_texts(random.Random(6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = jaccard.with_sets(docs)
    for cell in ({"cell": 8}, {"cell_bytes": 4000}):
        groups = own.join(jaccard.near_groups(own, jaccard.place(docs, "text"), **cell), "sid").groupBy("root").agg({jaccard.place(docs, "doc_id"): "min"}).collect()
        assert sorted(r[1] for r in groups) == sorted(set(plain_roots(texts)))


def test_one_row_per_group(spark):
    rng = random.Random(7)
    a, b, c, d, e = (sentence(rng, 200) for _ in range(5))
    rows = [(None, a), (None, b), (1, c), (None, changed(rng, c, 2)), (2, d), (2, e), (0, changed(rng, e, 1)), (3, a + " end"), (4, d), (None, changed(rng, b, 1))]
    kept = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert {x for x in kept if x[0] is not None} == {(1, c), (2, d), rows[6], rows[7]}
    assert [x in (rows[1], rows[9]) for x in kept if x[0] is None] == [True] and len(kept) == 5
    texts = [sentence(rng, 60) for _ in range(3)]  # one id, or none, and unrelated texts
    rows = [(None, texts[0]), (None, texts[1]), (None, None), (7, texts[2]), (7, texts[0] + " " + texts[1]), (7, texts[2])]
    kept = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert len(kept) == 5 and set(kept) == set(rows)
