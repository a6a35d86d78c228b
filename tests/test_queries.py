"""Every query of the engine that has SQL returns what DuckDB returns for it on tables large enough to be tested."""

import glob
import os

import duckdb
import pytest

from sori.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    out = duck.execute(registry.SQL[name])
    at = [c[0] for c in out.description]
    assert sorted(at) == cols
    assert plain(df.select(*cols).collect()) == plain([tuple(r[at.index(c)] for c in cols) for r in out.fetchall()])


def test_leaked_examples_equal_the_library(spark, duck):
    """Over all texts and examples of the table."""
    from difflib import SequenceMatcher
    from hashlib import sha256

    rows = duck.execute("SELECT item_id, text FROM benchmark WHERE text IS NOT NULL ORDER BY item_id").fetchall()
    want = set()
    for t in {x[i % 40 :] for i, x in rows} - {""}:
        m, best = SequenceMatcher(None, "", ""), (-0.75 + 1e-12, None)
        for i, e in rows:
            m.set_seqs(t, e)
            if -best[0] <= m.real_quick_ratio() and -best[0] <= m.quick_ratio():
                best = min(best, (-m.ratio(), i), key=lambda b: (b[0], -1 if b[1] is None else b[1]))
        if best[1] is not None:
            want.add((sha256(t.encode()).hexdigest(), best[1], round(-best[0], 4)))
    got = {tuple(r) for r in registry.QUERIES["x04_leaked_examples"](spark, SF).collect()}
    assert got == want and len(want) > 10
