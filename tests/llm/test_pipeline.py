"""The pipeline's stages on rows made for them, each against what must hold."""

import random

import corpus_pipeline
from panelweave.llm.shared import materialize
from tests.llm.test_jaccard import plain_roots
from tests.llm.test_operators import plain_spans, sentence


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    good = [sentence(rng, 150) for _ in range(12)]
    texts = [*good, good[0], good[1].replace(good[1].split()[3], "other", 1), "too short", None, good[2] + " write to a.b@mail.example.com"]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    long = [k for k, t in enumerate(texts) if t and len(t.split()) >= 50]
    assert sorted(at["quality_rules"]) == sorted(at["toxicity"]) == long
    comp = plain_roots([texts[k] for k in long])  # 5-word similarity of 0.8
    least = {c: min(k for k, d in zip(long, comp) if d == c) for c in comp}
    assert sorted(at["simhash_near_dedup"]) == sorted(least.values())
    assert sorted(at["pii"]) == sorted(least.values()) and not any(plain_spans(t) for t in at["pii"].values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(least.values())


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null and empty and very long texts, columns that clash with names used inside, and an empty table."""
    rng = random.Random(12)
    a, b, c = (sentence(rng, 200) for _ in range(3))
    giant = sentence(rng, 40_000)
    rows = [(None, a, 1), (None, b, 2), (3, c, 3), (3, c, 3), (4, None, 4), (None, None, 5), (5, "", 6), (6, giant, 7), (3, a + " x y z", 8)]
    rows = [(*r, "sid", "rid", "hash", "root", "_p", "found", "base", "events", "weight", "sig", "row") for r in rows]
    schema = "doc_id long, text string, n_chars int, sid string, rid string, hash string, root string, _p string, found string, base string, events string, weight string, sig string, row string"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
    kept = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in docs.collect() if r["text"])
    assert corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path)).count() == len(rows)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=repr) == sorted([(3, a + " x y z"), (None, b), (3, c), (4, None), (6, giant)], key=repr)
    clean = corpus_pipeline.personal_data(spark, docs, "").collect()
    assert sorted(map(repr, clean)) == sorted(map(repr, docs.collect()))
    assert sum(r["length"] for r in corpus_pipeline.pack_sequences(spark, docs, "").collect()) > 40_000
