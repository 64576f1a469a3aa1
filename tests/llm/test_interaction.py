"""The filter audit against its SQL and against a walk through each order."""

import itertools
import os
import re
from collections import defaultdict

import duckdb
import pytest

from tapewright.llm.interaction import COUNTS, audit_filters
from tapewright.llm.oracles import OP11
from tapewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def walk(docs, labels):
    good, toxic = ({d for d, *m in labels if m[k] == 1} for k in (0, 1))
    fails, parts = [], [s or "" for _, _, s in docs]
    for d, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        hit = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        hit["E"] = d is not None and any(x is not None and x < d and (u or "") == t for x, u, _ in docs)
        fails.append({k for k, v in hit.items() if v})
    out, shapley = {}, defaultdict(int)
    for part in set(parts):
        own = [(d, f) for (d, _, _), f, p in zip(docs, fails, parts, strict=True) if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [d for d, f in left if k in f]
                before = len(left)
                left = [(d, f) for d, f in left if k not in f]
                assert before - len(left) == len(gone)
                shapley[part, k] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == {k} for _, f in own), sum(d in good for d in gone), sum(d in toxic for d in gone)]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


LONG = " ".join(f"w{k}" for k in range(60))
DOCS = [(5, LONG, "a"), (3, LONG, "b"), (9, LONG, "a"), (9, LONG, "a"), (None, LONG, None), (1, "", ""), (2, None, None), (4, "A B C # d", "a"), (6, "x " * 300_000, "b"), (7, LONG + " $", "c"), (8, LONG.upper(), "c"), (8, "other " + LONG, "c"), (10, "\x1c \x0b", "b"), (11, "é " + LONG, "é")]
LABELS = [(5, 1, 0), (9, 1, 1), (4, 0, 1), (4, None, None), (8, 1, None), (6, None, 1), (99, 1, 1), (None, 1, 1)]


def test_orders_nulls_ties_and_extra_columns(spark):
    docs = spark.createDataFrame([(*d, k, True) for k, d in enumerate(DOCS)], "doc_id long, text string, source string, row int, good boolean")
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    rows = audit_filters(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(rows) == len(got) == 600 * 5 and got == walk(DOCS, LABELS)
    assert audit_filters(docs.limit(0), labels).count() == 0
    assert audit_filters(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_audit_query_and_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = duck.execute(OP11).df(), QUERIES["op11_filter_audit"](spark, SF).toPandas()
    cols, key = sorted(want.columns), ["part", "filter_order", "step"]
    assert sorted(got.columns) == cols
    assert got.sort_values(key)[cols].values.tolist() == want.sort_values(key)[cols].values.tolist()
    docs = duck.execute("SELECT doc_id, text, source FROM documents").fetchall()
    assert {tuple(r[c] for c in key): tuple(r[c] for c in COUNTS) for r in got.to_dict("records")} == walk(docs, duck.execute("SELECT doc_id, quality, toxic FROM labels").fetchall())
