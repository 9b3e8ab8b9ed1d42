"""Decontamination against a plain search of every window, and the array against plain sorting."""

import hashlib
import random
import re

import numpy as np
import pytest

from panelweave.llm import suffixes

SCHEMA = "doc_id long, text string, row string, spans string, items string, n_words string, item string, id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, passage in items:
            p = words(passage)
            n = min(window, len(p))
            for k in range(len(p) - n + 1 if p else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == p[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add("null" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def tables(seed):
    rng = random.Random(seed)
    lexicon = ["der", "Haus", "é", "Ünd", "x9", "a", "b", "ß", "日本", "7"]
    text = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 25, 60]) if k > 3 else 30)) for k in range(12)]
    items = [(k, t if len(t.split()) > 5 else t + " rare" + str(k)) for k, t in items]
    items += [(100, items[5][1]), (5, items[6][1]), (None, items[7][1]), (101, None), (102, ""), (103, "!?"), (104, items[8][1] + "."), (20, "Only here, once")]
    docs = [text(rng.randint(0, 120)) for _ in range(40)]
    for k in range(20):
        passage = (items[rng.randrange(12)][1] or "").split()
        a = rng.randint(0, len(passage) // 2)
        docs.append(text(20) + " " + " ".join(passage[a : a + rng.randint(6, 40)]).upper().replace("SS", "ß") + ", " + text(5))
    docs += [None, "", "...", docs[-1], docs[-1], items[3][1] * 3, "only\nHERE once", "only here onceonly", "x" * 50_000, (items[2][1] + " und ") * 40, text(900)]
    return [(k if k % 13 else None, t) for k, t in enumerate(docs)], items


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("seed, block, shard", [(1, None, None), (2, 300, None), (3, None, 64)])
def test_marks(spark, seed, block, shard, monkeypatch):
    """Also with a benchmark of several blocks; a small shard is tested below, where tasks see the setting."""
    docs, items = tables(seed)
    frame = spark.createDataFrame([(*d, *"abcdef") for d in docs], SCHEMA).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    if shard:
        monkeypatch.setattr(suffixes, "SHARD_WORDS", shard)
        tests = next(suffixes.blocks(bench))
        n_words, spans, found = suffixes.marks([None if t is None else t.encode() for _, t in docs], tests)
        got = [(d, n, sum(s["stop"] - s["start"] for s in sp), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(sp)) for (d, _), n, sp, f in zip(docs, n_words, spans, found)]
    elif block:
        rows = suffixes.mark(frame, bench, size=block).collect()
        assert len(list(suffixes.blocks(bench, size=block))) > 3
        got = [(r["row"]["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in rows]
        assert all(a["stop"] < b["start"] for r in rows for a, b in zip(r["spans"], r["spans"][1:]))
    else:
        got = suffixes.report(frame, bench).collect()
    assert ordered(got) == ordered(plain(docs, items))
    assert 3 < sum(r[-1] for r in got) < len(got) - 5


def test_clean_keeps_columns(spark):
    docs, items = tables(4)
    frame = spark.createDataFrame([(*d, *"abcdef") for d in docs], SCHEMA)
    kept = suffixes.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    want = [(*d, *"abcdef") for d, p in zip(docs, plain(docs, items)) if not p[-1]]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def test_empty_tables(spark):
    docs, items = tables(5)
    frame, bench = spark.createDataFrame([(*d, *"abcdef") for d in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert suffixes.report(frame.limit(0), bench).collect() == []
    assert ordered(suffixes.report(frame, bench.limit(0)).collect()) == ordered(plain(docs, []))
    assert suffixes.matches(frame.limit(0), bench).collect() == []


def test_matches_are_maximal(spark):
    docs, items = tables(6)
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    items = [(k, t) for k, (_, t) in enumerate(items)]
    want = set()
    for d, text in docs:
        w = words(text)
        for i, passage in items:
            p = words(passage)
            for a in range(len(w)):
                for b in range(len(p)):
                    n = 0
                    while a + n < len(w) and b + n < len(p) and w[a + n] == p[b + n]:
                        n += 1
                    if n >= min(10, len(p)) and (not a or not b or w[a - 1] != p[b - 1]):
                        want.add((d, a, str(i), b, n))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = list(map(tuple, suffixes.matches(frame, bench).collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_long_items_in_pieces():
    text = " ".join(f"w{k % 97}" for k in range(1000)).encode()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"item": ["a", "b", "c"], "text": [text.decode(), "one two", None]})
    rows = [(r["item"], r["at"], r["words"]) for b in suffixes._cut(iter([batch]), 10, 64) for r in b.to_pylist()]
    whole = text.split()
    windows = {tuple(w[k : k + 10]) for n, _, t in rows if n == "a" for w in [t.split()] for k in range(len(w) - 9)}
    assert windows == {tuple(whole[k : k + 10]) for k in range(len(whole) - 9)}
    assert all(t.split() == whole[at : at + len(t.split())] for n, at, t in rows if n == "a") and ("b", 0, b"one two") in rows


def test_suffix_array():
    rng = np.random.default_rng(2)
    for size in (1, 2, 50, 400):
        ids = rng.integers(0, 3, size).astype(np.int32)
        ids[-1] = 0
        run = suffixes.runs(ids)
        for least in (1, 3):
            got = suffixes.suffix_array(ids, run, size, least, 64).tolist()
            want = sorted((k for k in range(size) if run[k] >= least), key=lambda k: (ids[k : k + run[k]].tolist(), k))
            assert sorted(got) == sorted(want)
            assert [ids[k : k + run[k]].tolist() for k in got] == [ids[k : k + run[k]].tolist() for k in want]
