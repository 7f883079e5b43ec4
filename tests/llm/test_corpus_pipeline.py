"""The pipeline's stages on small rows, and the rule that nothing else needs this subpackage."""

import ast
import hashlib
import subprocess
import sys
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from test_corpus_operators import base_counts, brute_classes, words

ROOT = Path(__file__).parents[2]


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "encode":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def brute_rules(rules, rows):
    """Rows that pass the base rule and that no rule of the list rejects, by counts in plain Python."""
    out = []
    for r in rows:
        t = r["text"] or ""
        n, chars, symbols, dup, again = base_counts(t)
        if n < 50 or 100 * again > 50 * n:
            continue
        lines = sum(bool(words(x)) for x in t.split("\n"))
        f = {"n_words": n, "word_length": chars / n, "symbol_rate": symbols / n, "dup_line_rate": dup / lines, "repeat_rate": again / n, "upper_rate": sum(unicodedata.category(c) == "Lu" for c in t) / len(t)}
        if not any(all((f[c.feature] > c.cut) == c.above for c in rule) for rule in rules.rules):
            out.append(r)
    return out


def brute_mix(rows, mixing):
    """How often each row is taken: by source, documents in order of their keys up to the key nearest to the target."""
    size = {i: len(words(r["text"])) for i, r in enumerate(rows)}
    key = {i: int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:6], 16) for i, r in enumerate(rows)}
    sources = defaultdict(list)
    for i, r in enumerate(rows):
        sources[r["source"]].append(i)
    total = {s: sum(size[i] for i in ids) for s, ids in sources.items()}
    times = Counter()
    for s, target in mixing.targets(total).items():
        whole = min(2, int(target // total[s])) if total[s] else 0
        rest, upto, cut = target - whole * total[s], 0, -1
        by = defaultdict(int)
        for i in sources[s]:
            by[key[i]] += size[i]
        for k in sorted(by):
            if by[k] and upto < rest <= upto + by[k]:
                cut = k if upto + by[k] - rest < rest - upto else k - 1
            upto += by[k]
        for i in sources[s]:
            times[i] = whole + (key[i] <= cut)
    return [r for i, r in enumerate(rows) for _ in range(times[i])]


def test_run_against_plain_python(spark, tmp_path):
    """Every stage again in plain Python, on 200 documents and near copies of some of them."""
    import random

    import sentencepiece

    pipeline = pytest.importorskip("corpus_pipeline")
    from sulcus.llm import mixing, quality_rules, sentencepieces

    sf, rng = "/root/testdata/sf0.001", random.Random(4)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in given.collect()]
    for k, r in enumerate([r for r in rows if r["text"] and 80 < len(r["text"].split()) < 600][:40]):
        w = r["text"].split(" ")
        for _ in range(1 + k % 4):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append(r | {"doc_id": 10_000 + k, "text": " ".join(w) if k % 5 else r["text"] + " \n"})
    spark.createDataFrame(rows, given.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rules = quality_rules.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    rows = brute_rules(rules, rows)
    group = defaultdict(list)
    for r in rows:
        group["".join(words(r["text"]))].append(r)
    rows = [min(g, key=lambda r: (-len(r["text"]), r["doc_id"])) for g in group.values()]
    root = brute_classes([(r["doc_id"], r["text"]) for r in rows])
    assert any(root[i] != i for i in root)
    rows = brute_mix([r for r in rows if root[r["doc_id"]] == r["doc_id"]], mixing)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r["doc_id"], len(ids := sp.encode(r["text"])), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for r in rows]
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_stages_take_odd_rows(spark, docs, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass each stage alone; an empty table stays empty."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    every = docs.count()
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        none = stage(spark, empty, str(tmp_path))
        assert none.count() == 0 and 0 < got.count() <= 2 * every
        if name != "encode":
            assert got.columns == docs.columns == none.columns
        else:
            assert got.count() == every


def test_nothing_else_imports_it():
    for p in [*(ROOT / "sulcus").rglob("*.py"), *(ROOT / "jobs").rglob("*.py")]:
        if "llm" not in p.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                names += [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(part in ("llm", "corpus_pipeline") for n in names for part in n.split(".")), p


def test_entry_without_it(tmp_path):
    code = "import sys; sys.modules['sulcus.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
