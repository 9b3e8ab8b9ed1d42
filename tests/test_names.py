"""Matching of names: whole blocks, against plain comparisons of all pairs."""

import random

import duckdb
import numpy as np
import pytest

from panelweave import registry
from panelweave.operators import names
from panelweave.sqlops import apply

registry.load()


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def made(seed):
    r = random.Random(seed)
    base = [f"Customer#{r.randrange(3000):09d}" for _ in range(40)] + ["".join(r.choice("ab #") for _ in range(r.randrange(1, 9))) for _ in range(25)] + ["Ünïcode Holding Größe AG"]

    def name():
        s = r.choice(base)
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            k, c = r.randrange(len(s) + 1), r.choice("ab#0 9")
            s = r.choice((s[:k] + c + s[k:], s[:k] + c + s[k + 1 :], s[:k] + s[k + 1 :])) or "x"
        return s

    customer = [(7 * k + 1, None if r.random() < 0.04 else name(), r.choice((0, 1, 1, 1, None)), r.choice((-1.0, 0.0, 3.0, None, 9.0))) for k in range(160)]
    supplier = [(5 * k + 1, None if r.random() < 0.06 else name(), r.choice((0, 1, 1, None)), r.choice((-1.0, 5.0, None))) for k in range(60)]
    return customer, supplier


def test_tables_are_edit_distances():
    some = ["", "a", "ab", "abc", "b", "xabc", "Größe", "𝄞a", "ab"]
    (left, size, leaf), (right, other, end) = names.tree(some), names.tree(some[::-1])
    for i, each in enumerate(names.tables(left, right)):
        for k in np.flatnonzero(size == i):
            for m, b in enumerate(some[::-1]):
                assert each[other[m]][leaf[k], end[m]] == edits(some[k], b)


@pytest.mark.parametrize("name", ["join19_entity_resolution", "join20_holder_match"])
def test_no_customer_is_left_out(spark, monkeypatch, name):
    """Keys of any remainder, names that differ by several edits, missing names, in many small cells, as DuckDB finds them among all pairs of a country."""
    monkeypatch.setattr(names, "CELL", 16)
    monkeypatch.setattr(names, "PART", 5)
    customer, supplier = made(1)
    frames = {"customer": spark.createDataFrame(customer, "c_custkey long, c_name string, c_nationkey int, c_acctbal double"), "supplier": spark.createDataFrame(supplier, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")}
    con = duckdb.connect()
    for x, key, rows in (("customer", "c_custkey", customer), ("supplier", "s_suppkey", supplier)):
        con.execute(f"CREATE TABLE {x} ({key} BIGINT, {x[0]}_name VARCHAR, {x[0]}_nationkey INT, {x[0]}_acctbal DOUBLE)")
        con.executemany(f"INSERT INTO {x} VALUES (?, ?, ?, ?)", rows)
    sql = registry.oracles()[name]
    want = con.execute(sql).fetchall()
    found = apply(name, spark, **{x: f for x, f in frames.items() if x == "customer" or name.startswith("join19")})
    assert "%" not in sql and sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and len(want) > 40
