"""Benchmark decontamination against brute force, its plan, and its defined cases."""

import hashlib
import random
import re

import duckdb
import pytest
from corpus_text import prose

from sulcus.llm import decontamination, queries


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= ids
        ids = sorted({str(x) for x in found if x is not None}, key=lambda v: v.encode())
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def given():
    rng = random.Random(2)
    item = [prose(rng, n, 60) for n in (30, 25, 10, 9, 6, 5, 4, 3, 2, 12, 40)]
    items = [(k, t) for k, t in enumerate(item)]
    items += [(100, item[0].upper()), (101, item[0]), (102, prose(rng, 5, 60) + " " + item[0]), (3, item[1]), (None, item[9]), (None, "zz yy xx"), (103, None), (104, " ,. "), (105, "one"), (3, item[1])]
    docs = [(k, prose(rng, rng.randrange(5, 200), 60)) for k in range(40)]
    docs += [(50 + k, prose(rng, 20, 60) + " ... " + re.sub(" ", ",\n", t) + "! " + prose(rng, 20, 60)) for k, t in enumerate(item)]
    docs += [(70, item[0] + " " + item[0]), (71, " ".join(item[0].split()[3:13] + item[0].split()[5:20])), (72, item[10].replace("w", "W")), (73, "ZZ-yy/xx"), (74, "one É one\x00ONE éone"), (75, " ".join(item[0].split()[:9]))]
    docs += [(76, None), (77, ""), (78, " \x00.,"), (79, "Ä Ö İ ſ ß"), (80, prose(rng, 40000, 60) + " " + item[2]), (81, "x" * 50000)]
    docs += [(None, item[0]), (None, item[0]), (None, None), (70, item[0]), (70, item[0] + " " + item[0]), (70, item[0] + " " + item[0])]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark, given):
    docs, items = given
    d = spark.createDataFrame([(i, t, "a", 1, "w") for i, t in docs], "doc_id long, text string, window string, n long, words string").repartition(3)
    return d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, h int").repartition(2)


@pytest.mark.parametrize(("window", "block"), [(10, 200_000), (10, 40), (4, 200_000), (1, 30)])
def test_against_brute_force(tables, given, window, block):
    got = decontamination.contamination(*tables, window=window, block=block)
    assert rows_of(got.drop("spans")) == sorted(brute(*given, window), key=str)
    assert all(len({p for s in r.spans for p in range(s.start, s.stop)}) == r.n_hit for r in got.select("spans", "n_hit").collect())


def test_filter_keeps_clean_documents(tables, given):
    kept = decontamination.filter_documents(*tables)
    want = [d for d, r in zip(given[0], brute(*given, 10)) if not r[-1]]
    assert kept.columns == tables[0].columns and rows_of(kept.select("doc_id", "text")) == sorted(want, key=str)


def test_empty_tables(tables):
    docs, items = tables
    none = decontamination.contamination(docs.limit(0), items)
    assert none.count() == 0
    free = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(free) == docs.count() and not any(r.contaminated or r.n_items or r.spans for r in free)
    assert decontamination.filter_documents(docs, items.limit(0)).count() == docs.count()
    assert decontamination.contamination(docs.limit(0), items.limit(0)).columns == none.columns


def test_plan_is_native(tables):
    plan = decontamination.contamination(*tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op12_decontamination"])
    got = queries.op12_decontamination(spark, sf)
    rows = rows_of(got)
    assert got.columns == want.columns and rows == sorted(want.fetchall(), key=str) and any(r[-1] for r in rows)
