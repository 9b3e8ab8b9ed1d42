"""Graph operators against brute force on a small table."""

import duckdb

from panelweave import registry
from panelweave.operators.graph import EDGES

SF = "/root/testdata/sf0.001"


def plain_pagerank(edges, damping=0.85):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = float(w)
        out.setdefault(b, {})[a] = float(w)
    rank = dict.fromkeys(out, 1 / len(out))
    for _ in range(400):
        new = dict.fromkeys(out, (1 - damping) / len(out))
        for a, to in out.items():
            for b, w in to.items():
                new[b] += damping * rank[a] * w / sum(to.values())
        rank = new
    return rank


def test_pagerank_converges(spark):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = plain_pagerank(con.execute(f"WITH {EDGES} SELECT src, dst, weight FROM e").fetchall())
    got = {r["node"]: r["rank"] for r in registry.queries()["graph03_pagerank"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert sum(abs(got[k] - want[k]) for k in want) < 1e-5
