"""Compare a query with its SQL, order aside."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"


def differing(spark, duck, query, sql, data=DATA) -> list:
    df = query(spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    run = duck.execute(sql)
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in run.fetchall())
    return [(a, b) for a, b in zip(ours, theirs) if a != b] or ([] if len(ours) == len(theirs) else [len(ours), len(theirs)])
