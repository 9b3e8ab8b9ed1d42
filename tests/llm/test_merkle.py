"""The manifest against a plain one."""

import hashlib
import zlib

import pytest

from panelweave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos string, leaf string, parent string, path string, digest string, tie string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root, and for each node its siblings level by level as (left, right)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            lo = at // 16 * 16
            paths[k].append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 16])))
        nodes = [h(*nodes[at : at + 16]) for at in range(0, len(nodes), 16)]
        places = [p // 16 for p in places]
    return nodes[0], paths


def plain(rows):
    rows = [r[:5] for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    made, roots = {}, []
    for s in sources:
        own = sorted(((r, leaf_of(*r)) for r in rows if r[3] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        made[s] = (own, *tree([x[1] for x in own]))
        roots.append(made[s][1])
    root, tops = tree(roots)
    out = []
    for s, top in zip(sources, tops):
        own, subroot, paths = made[s]
        for (r, leaf), path in zip(own, paths):
            forged = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                forged = leaf_of(r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            folded = forged
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((r[0], leaf, subroot, root, h(*[x for p in path + top for x in p]), folded, folded == root))
    return out


def as_sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def rows_of(n):
    texts = ["Abc", "abc", None, "", "ÀÉ Straße Z", "x" * 20_000 + "Q"]
    sources = ["hot", "hot", "hot", "web", "", None, "é", "Z", "hot"] + [f"s{k}" for k in range(40)]
    rows = [(k if k % 23 else None, texts[k % 6], "en" if k % 3 else None, sources[0] if k % 3 == 0 else sources[k % len(sources)], k if k % 4 else None) for k in range(n)]
    return rows + [rows[5]] * 3 + [(7, "Other", "en", "web", 1)] * 2


@pytest.mark.parametrize("n", [900, 330])
def test_manifest(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST_ROWS", 50)
    rows = rows_of(n)
    docs = spark.createDataFrame([(*r, *"abcdefg") for r in [(d, t, la, s, c) for d, t, la, s, c in rows]], SCHEMA).repartition(6)
    got = merkle.report(docs).collect()
    assert as_sorted(got) == as_sorted(plain(rows))
    assert not all(r["verified"] for r in got) and any(r["verified"] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_one_source(spark, n):
    rows = [(k, f"Text {k}", "en", "s", k) for k in range(n)]
    got = merkle.report(spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA)).collect()
    assert as_sorted(got) == as_sorted(plain(rows) if rows else [])


def test_every_node_is_listed(spark):
    rows = [(k, "t", "en", f"s{k % 2}", 1) for k in range(60)]
    manifest = merkle.build(spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA))
    found = {(r["tree"], r["source"], r["level"], r["position"]): r["digest"] for r in manifest.nodes().collect()}
    assert len(found) == len(manifest.nodes().collect())
    for s in ("s0", "s1"):
        nodes = [leaf_of(*r) for r in rows if r[3] == s]
        assert [found["source", s, 0, k] for k in range(30)] == nodes
        assert [found["source", s, 1, k] for k in range(2)] == [h(*nodes[:16]), h(*nodes[16:])]
        assert found["source", s, 2, 0] == h(h(*nodes[:16]), h(*nodes[16:]))
    assert h(found["source", "s0", 2, 0], found["source", "s1", 2, 0]) == manifest.root
