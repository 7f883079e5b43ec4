"""Each operator against a brute-force version on a small fixture, and its defined edge cases."""

import hashlib
import math
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from corpus_text import prose

from sulcus.llm import exact_dedup, language, mixing, near_dedup, quality_rules, sentencepieces, substring_dedup, token_counts, token_files, toxicity
from sulcus.llm.common import hash_words, normal_words


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


# -- quality rules


def base_counts(t):
    w = words(t)
    n = Counter(zip(w, w[1:], w[2:]))
    cover = [False] * len(w)
    for i in range(len(w) - 2):
        if n[w[i], w[i + 1], w[i + 2]] > 1:
            cover[i] = cover[i + 1] = cover[i + 2] = True
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(cover)


def test_quality_counts(docs, fixture_rows):
    got = sorted(tuple(r) for r in quality_rules.score(docs, quality_rules.DecisionList()).select(*["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]).collect())
    want = []
    for r in fixture_rows:
        c = base_counts(r[1])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((*c, failed, not failed))
    assert got == sorted(want)


def test_quality_learns_and_keeps_clean(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(rng, 80, 5000)
        if bad and i % 8 == 0:
            t = " ".join(w + "###" for w in t.split())
        elif bad:
            t = "\n".join([t.upper()])
        rows.append((i, t))
        labels.append((i, 0 if bad else 1))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality_rules.learn(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r.doc_id for r in quality_rules.filter_documents(d, rules).collect()}
    assert 1 <= len(rules.rules) <= quality_rules.MAX_RULES and "reject" in str(rules)
    assert kept == {i for i, q in labels if q}


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn(docs, none).rules == []
    assert quality_rules.learn(empty, none).rules == []
    assert quality_rules.score(empty, quality_rules.DecisionList()).count() == 0


def test_quality_plan_is_native(docs):
    plan = quality_rules.score(docs, quality_rules.DecisionList())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- exact dedup


def test_exact_dedup(docs, fixture_rows, empty):
    group = defaultdict(list)
    for r in fixture_rows:
        group["".join(words(r[1]))].append(r)
    want = []
    for content, rows in group.items():
        best = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        left = True
        for r in sorted(rows, key=lambda r: -len(r[1] or "")):
            stays = left and r[0] == best[0] and len(r[1] or "") == len(best[1] or "")
            left = left and not stays
            want.append((r[0], best[0], len(rows), stays, hashlib.sha256(content.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.assign(docs).collect()]
    key = lambda r: (str(r[0]), r[4], r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = exact_dedup.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(group)
    assert exact_dedup.assign(empty).count() == 0


# -- substring dedup


def brute_substrings(rows):
    seen = Counter()
    for r in rows:
        w = words(r[1])
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(docs, fixture_rows, empty):
    got = [tuple(r) for r in substring_dedup.removals(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_substrings(fixture_rows), key=str)
    assert substring_dedup.removals(empty).count() == 0


def test_difference_cover():
    p, c = substring_dedup.PERIOD, set(substring_dedup.COVER)
    for i in range(p):
        for j in range(p):
            assert any((i + d) % p in c and (j + d) % p in c for d in range(p))


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_shared_passages(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randrange(33, 80), 30000).split() for _ in range(12)]
    rows = []
    for i in range(150):
        w = prose(rng, rng.randrange(0, 90), 30000).split()
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a:] if rng.random() < 0.5 else p
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring_dedup.removals(d).collect())) == sorted(brute_substrings(rows))


# -- toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(d, toxicity.fit(d, lab)).join(lab, "doc_id").where("held_out and toxic is not null").toPandas()
    rank = got.score.rank()
    p, n = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    auc = (rank[got.toxic == 1].sum() - p * (p + 1) / 2) / (p * n)
    assert auc > 0.95 and (got.predicted == got.toxic).mean() > 0.95
    assert got.predicted[got.toxic == 0].mean() < 0.02


def brute_events(tags):
    """By definition: an insult, or the later of a threat and a target that are REACH words apart or less and not yet used up."""
    out, reach = [], toxicity.REACH
    near = lambda k, tag, back=True: any(tags[j][0] == tag for j in (range(max(0, k - reach), k) if back else range(k + 1, min(len(tags), k + 1 + reach))))
    held, age = None, 0  # the last threat or target, and words since
    for k, (tag, w) in enumerate(tags):
        context = near(k, toxicity.NEGATION) + 4 * any(tags[j][0] == toxicity.REPORT for j in range(k))
        if tag == toxicity.INSULT:
            out.append((context + 2 * (near(k, toxicity.TARGET) or near(k, toxicity.TARGET, False)), w))
        age += 1
        if held is not None and age > reach:
            held = None
        if {held, tag} == {toxicity.THREAT, toxicity.TARGET}:
            out.append((8 + context + 2, 1.0))
            held, age = (toxicity.TARGET, 0) if tag == toxicity.TARGET else (None, 0)
        elif tag in (toxicity.THREAT, toxicity.TARGET):
            held, age = tag, 0
    return out


def test_toxicity_machine_against_definitions():
    rng, m = random.Random(3), toxicity.Machine()
    for _ in range(3000):
        tags = [(t, float(rng.randrange(1, 4)) if t == toxicity.INSULT else 0.0) for t in (rng.choice((0, 1, 2, 3, 4, 5, 5, 5, 5)) for _ in range(rng.randrange(14)))]
        assert m.events(tags) == brute_events(tags), tags


CLAUSES = {"insult": "an idiot here", "threat": "they kill", "negated": "not an idiot", "targeted": "an idiot you", "reported": "she wrote that idiot"}


@pytest.mark.parametrize("name", list(CLAUSES))
def test_toxicity_each_transducer_counts(name):
    """Without a transducer the score of its clause is another one."""
    x = {}
    for without in ((), (name,)):
        g = toxicity.Grammar({"idiot$": 2.0}, without)
        x[without] = toxicity.features(np.array([g.sums(CLAUSES[name])]), toxicity.PRIOR)[0, 0]
    assert x[()] != x[name,]
    assert (x[()] < x[name,]) == (name in ("negated", "reported"))


def test_toxicity_clauses():
    g = toxicity.Grammar({"idiot$": 2.0, "bocoo": 1.0})
    score = lambda t: float(toxicity.features(np.array([g.sums(t)]), toxicity.PRIOR)[0, 0])
    assert score("you are an idiot") == score("an idiot you are") > score("an idiot here") > score("not an idiot") > 0
    assert score("idiotic talk") == 0 == score("to kill time") < score("they kill time")
    assert score("xbocoos") == 0 < score("bocoos")
    assert score("not here. an idiot") == score("an idiot")  # what holds ends with its clause
    assert g.sums("idiot. idiot.")[-2] == 2 and g.sums("idiot idiot")[-2] == 1


def test_toxicity_learns_what_contexts_mean(spark):
    """Labels by which negated and reported insults are fine, and targeted ones are not, move the factors that way."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(1200):
        kind = i % 4
        said = {0: "you idiot", 1: "not idiot", 2: "wrote idiot", 3: "you wrote not"}[kind]
        rows.append((i, ". ".join([prose(rng, 6, 300), said, prose(rng, 6, 300)])))
        labels.append((i, int(kind == 0)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit(d, lab)
    assert m.weights["negated"] < toxicity.PRIOR["negated"] and m.weights["targeted"] >= toxicity.PRIOR["targeted"]
    got = toxicity.score(d, m).join(lab, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).all()
    plain = toxicity.score(d, toxicity.fit(d, lab, without=("negated", "targeted", "reported"))).join(lab, "doc_id").where("held_out").toPandas()
    assert (plain.predicted == plain.toxic).mean() < 0.9


def test_toxicity_reads_long_texts_in_linear_time():
    g = toxicity.Grammar({"idiot$": 2.0})
    text = "the kill. " * 150_000
    begin = time.perf_counter()
    assert g.sums(text)[-1] == 300_001 and g.sums("you idiot. " * 1000)[2] == 2000
    assert time.perf_counter() - begin < 15


def test_toxicity_edges(spark, docs, empty, fixture_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(docs, none)
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(fixture_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert toxicity.score(empty, m).count() == 0


# -- sentencepiece


def test_sentencepieces_equal_the_library(docs, fixture_rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    want = []
    for r in fixture_rows:
        ids = sp.encode(r[1] or "")
        want.append((r[0], len(ids), ",".join(map(str, ids)), sp.decode(ids)))
    assert sorted(map(tuple, sentencepieces.encode(docs).collect()), key=str) == sorted(want, key=str)
    assert sentencepieces.encode(empty).count() == 0


def test_sentencepieces_random_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    t = sentencepieces.ChunkTable(sentencepieces.default_model())

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tab.é日\x00"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def same(text):
        parts = t.parts(text)
        ids = t.sp.encode(text)
        assert ",".join(p[0] for p in parts) == ",".join(map(str, ids)) and sum(p[1] for p in parts) == len(ids)
        assert "".join(p[2] for p in parts)[1:] == t.sp.decode(ids)

    same()


# -- token files


def test_token_files_round_trip(spark, docs, fixture_rows, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    ids = {}
    for r in fixture_rows:
        ids.setdefault(r[0], []).append(tok.encode(r[1] or "", add_special_tokens=False).ids + [2])
    files = token_files.write(docs, f"file://{tmp_path}/t")
    got = token_files.read(spark, f"file://{tmp_path}/t", files).collect()
    assert len(got) == len(fixture_rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for x in ids[r.doc_id]]
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    assert token_files.round_trip(empty).count() == 0


def test_token_files_random_access_and_damage(tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    p = tmp_path / "x.zst"
    with open(p, "wb") as f:
        w = token_files.FrameWriter(f)
        for i, n in ((4, 10), (None, 0), (9, 5000)):
            w.add(i, np.arange(n, dtype="<u4").tobytes())
        w.close()
    fs = pafs.LocalFileSystem()
    with fs.open_input_file(str(p)) as f:
        r = token_files.FrameReader(f)
        assert r.doc_ids == [4, None, 9] and r.find(9) == [np.arange(5000, dtype="<u4").tobytes()]
    with open(p, "rb") as f:  # any reader of zstandard streams sees the ids in order
        assert len(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()) == 4 * 5010
    raw = bytearray(p.read_bytes())
    raw[int(r.offsets[2]) + 12] ^= 255
    p.write_bytes(raw)
    with fs.open_input_file(str(p)) as f, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(f).frame(2)


def test_word_table_equals_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    t = token_files.WordTable(token_files.default_tokenizer())

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabÀ́'. Σ \x1c"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def same(text):
        want = t.tok.encode(text, add_special_tokens=False).ids
        assert [x.tolist() for x in t.encode(pa.array([text, "a b.", None, text]))] == [want, t.tok.encode("a b.").ids, [], want]

    same()


def test_word_table_merges_as_the_library_does(monkeypatch):
    """Long plain words, digits, signs and accents; and a table that is full again and again."""
    t = token_files.WordTable(token_files.default_tokenizer())
    rng = random.Random(12)
    parts = ["tion", "the", "Ä", "é", "ß", "ÿ", "12", "7", "...", "#", "<", "'s", "'", "n't", "ab", "q", "zz", "ing", "À", "%&", "<|endoftext|>", "x" * 60]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(60)]
    want = [t.tok.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in t.encode(pa.array(texts))] == want
    monkeypatch.setattr(token_files, "MOST_WORDS", 50)
    assert [t.ids(x) for x in texts] == want and len(t.row) <= 100


# -- language


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(d, language.fit(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95


def brute_grams(t):
    """Character n-grams of the letters of a text, other characters as one space, in buckets."""
    x = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(x) - n + 1):
            h = 0
            for c in x[k : k + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            v = (h + (n << 56)) % 2**64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                v = (v ^ v >> shift) * factor % 2**64
            out[v >> 50] += 1
    return out if x.strip() else Counter()


def test_language_against_plain_bayes(spark):
    """Three languages of unequal size, predicted by a naive Bayes of a few lines."""
    rng = random.Random(7)
    sound = {"a": "bdgou äé", "b": "ptkai éñ", "c": "ptkou ñä"}
    rows = []
    for i in range(240):
        lang = "aabc"[i % 4]
        rows.append((i, "".join(rng.choice(sound[lang]) for _ in range(rng.randrange(0, 40))) + "12! " * (i % 3), None if i % 11 == 0 else lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[2]]
    sums, size = {x: Counter() for x in "abc"}, Counter(r[2] for r in train)
    for _, t, lang in train:
        sums[lang].update(brute_grams(t))
    weight = {x: math.log(size[x] / len(train)) for x in "abc"}
    total = {x: sum(sums[x].values()) + language.ALPHA * language.BUCKETS for x in "abc"}
    got = {r.doc_id: r for r in language.predict(d, language.fit(d)).collect()}
    for i, t, _ in rows:
        g = brute_grams(t)
        if not g:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        z = {x: weight[x] + sum(n * math.log((sums[x][k] + language.ALPHA) / total[x]) for k, n in g.items()) for x in "abc"}
        best = max(z, key=z.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(z[x] - z[best]) for x in z), rel=0.02)


def test_language_slices_do_not_matter(monkeypatch):
    text = "  Überall  12 Straße, naïve… " * 30 + "x"
    want = language.counts(text)
    assert {k: n for k, n in enumerate(want) if n} == brute_grams(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "SLICE_CHARS", size)
        assert (language.counts(text) == want).all() and language.counts(" 1 2 3 ") is None
        assert {k: n for k, n in enumerate(language.counts(" a")) if n} == brute_grams("a")


def test_language_refuses_too_many(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    d = spark.createDataFrame([(i, "some words", f"l{i % 4}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        language.fit(d)


def test_language_rare_languages_are_learned(spark):
    """A language of few documents among very many of another is learned from all of them."""
    rows = [(i, "bdg ou bdg", "a") for i in range(3000)] + [(5000 + i, "ptk ai ptk", "b") for i in range(6)]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    assert m.langs == ["a", "b"] and language.score_batch(["ptk ai", "ou bdg"], m)[0] == ["b", "a"]


def test_language_edges(docs, empty):
    m = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, m).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[3].lang_pred in m.langs
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    none = language.fit(empty)
    assert none.langs == [] and {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(empty, m).count() == 0


# -- mixing


def test_mixing_targets():
    t = mixing.targets({"a": 10, "b": 100, None: 1000})
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(1665) and all(x <= 2 * n for x, n in zip(t.values(), (10, 100, 1000)))
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_mixing(spark, docs, fixture_rows, empty):
    rows = [tuple(r) for r in mixing.plan(docs).collect()]
    assert sorted(rows, key=str) == sorted((tuple(r) for r in mixing.plan(docs.repartition(5)).collect()), key=str) and len(rows) == len(fixture_rows)
    assert all(0 <= r[4] <= 2 * r[1] for r in rows)
    d = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 3}" if i % 7 else None) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.plan(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 4 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 80 for r in got)
    took = mixing.take_documents(d)
    assert took.columns == d.columns
    assert sum(len(r.text.split()) for r in took.collect()) == sum(r["sum(taken)"] for r in got)
    assert mixing.plan(empty).count() == 0 and mixing.take_documents(empty).count() == 0
    assert mixing.take_documents(docs).columns == docs.columns


def test_mixing_plan_is_native(docs):
    for df in (mixing.plan(docs), mixing.take_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


# -- near dedup


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = words(t)
        if w:
            out[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return out


def probability_jaccard(x, y):
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in {*x, *y}) for d in x.keys() & y.keys())


def brute_classes(rows):
    sets = shingle_sets(rows)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x.keys() & y.keys() and probability_jaccard(x, y) >= 0.8:
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return {i: find(i) for i in root}


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        w = prose(rng, rng.randrange(30, 160), 4000).split()
        for _ in range(rng.randrange(1, 7)):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(9999)}"
            rows.append((n, " ".join(v)))
            n += 1
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(d).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_joins_what_extremes_do_not(spark):
    """Many variants of two texts, most of them too far from one another: links run through a few of them only."""
    rng = random.Random(11)
    rows = []
    for _ in range(2):
        w = prose(rng, 90, 4000).split()
        for _ in range(70):
            v = list(w)
            for _ in range(rng.choice((0, 1, 2, 2, 3, 3, 4))):
                v[rng.randrange(len(v))] = f"n{rng.randrange(99999)}"
            rows.append((len(rows), " ".join(v)))
    rng.shuffle(rows)
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(set(want.values())) > 2 and got == want


def test_near_dedup_open_members(spark):
    rows = [(b, c, 1) for b, c in ((1, 1), (2, 1), (3, 3), (4, 4))] + [(2, 1, 2), (3, 3, 2), (5, 5, 3), (6, 5, 3)]
    m = near_dedup.open_members(spark.createDataFrame(rows, "b long, class long, key long"))
    assert {tuple(r) for r in m.collect()} == {r for r in rows if r[2] < 3}


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_filter_loses_no_pair(spark, seed):
    """Every pair of members of different classes that is similar enough is left by the filter; those of one class are not made."""
    rng = random.Random(seed)
    rows, of = [], {}
    for k in range(60):
        base = ["line a b c d"] * rng.choice((0, 0, 40)) + [f"w{i}" for i in range(rng.randrange(20, 60))]
        for _ in range(5):
            v = list(base)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(6)}"
            of[len(rows)] = rng.randrange(40)
            rows.append((len(rows), " ".join(v)))
    sets = shingle_sets(rows)
    want = {(a, b) for b in sets for a in range(b) if of[a] != of[b] and sets[a].keys() & sets[b].keys() and probability_jaccard(sets[a], sets[b]) >= 0.8}
    squeeze = zstandard.ZstdCompressor()
    texts = spark.createDataFrame([(i, bytearray(squeeze.compress(t.encode()))) for i, t in rows], "node long, z binary")
    m = spark.createDataFrame([(i, c, k) for i, c in of.items() for k in (1, 2)], "b long, class long, key long")
    found = near_dedup.prefixes(m, near_dedup.weights(m, texts))
    got = {tuple(r) for r in near_dedup.filtered_pairs(found).collect()}
    assert want and want <= got and all(of[a] != of[b] for a, b in got)
    assert {tuple(r) for r in near_dedup.least_pairs(found).collect()} <= got


def test_near_dedup_filter_is_linear_on_private_changes(spark):
    """Members with a tenth and more of their words changed, each in its own way, are too far from one another: no pair is made."""
    rng = random.Random(6)
    base = prose(rng, 120, 90000).split()
    rows = []
    for k in range(200):
        v = list(base)
        for j in range(4):
            v[10 + 25 * j + rng.randrange(20)] = f"own{k}x{j}"
        rows.append((k, " ".join(v)))
    squeeze = zstandard.ZstdCompressor()
    texts = spark.createDataFrame([(i, bytearray(squeeze.compress(t.encode()))) for i, t in rows], "node long, z binary")
    m = spark.createDataFrame([(i, i, 1) for i, _ in rows], "b long, class long, key long")
    assert near_dedup.filtered_pairs(near_dedup.prefixes(m, near_dedup.weights(m, texts))).count() == 0


def test_near_dedup_filter_on_a_template_with_shared_blocks(spark):
    """Texts of one template and six of forty blocks look alike and are mostly too far apart: pairs that are left don't grow with their square."""
    squeeze, left = zstandard.ZstdCompressor(), {}
    for n in (150, 300):
        rng = random.Random(9)
        template = [f"t{i}" for i in range(150)]
        blocks = [[f"b{k}x{i}" for i in range(10)] for k in range(40)]
        rows = [(k, " ".join(template + [w for b in rng.sample(blocks, 6) for w in b])) for k in range(n)]
        texts = spark.createDataFrame([(i, bytearray(squeeze.compress(t.encode()))) for i, t in rows], "node long, z binary")
        m = spark.createDataFrame([(i, i, 1) for i, _ in rows], "b long, class long, key long")
        got = {tuple(r) for r in near_dedup.filtered_pairs(near_dedup.prefixes(m, near_dedup.weights(m, texts))).collect()}
        sets = shingle_sets(rows)
        # Similar texts have 8/9 of either's shingles in common at least, so the others need no sum.
        close = [(a, b) for b in sets for a in range(b) if len(sets[a].keys() & sets[b].keys()) >= 0.88 * max(len(sets[a]), len(sets[b]))]
        want = {(a, b) for a, b in close if probability_jaccard(sets[a], sets[b]) >= 0.8}
        assert want <= got
        left[n] = len(got)
    assert left[300] <= 300, left


def test_near_dedup_doc_id_of_several_texts(spark):
    """A doc_id's several texts each bring their near copies into its class."""
    rng = random.Random(8)
    one, two = (prose(rng, 100, 5000) for _ in range(2))
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, prose(rng, 100, 5000)), (1, one)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_dedup_similarity():
    rng = random.Random(2)
    for _ in range(20):
        w = [f"w{rng.randrange(12)}" for _ in range(60)]
        v = [f"w{rng.randrange(12)}" if rng.random() < 0.05 else x for x in w]
        a, b = (" ".join(x) for x in (w, v))
        sets = shingle_sets([(0, a), (1, b)])
        hs, first = hash_words(normal_words([a, b]))
        own, h, n = near_dedup.shingles(hs, first)
        mine = near_dedup.similarity((h[own == 0], n[own == 0]), (h[own == 1], n[own == 1]))
        assert mine == pytest.approx(probability_jaccard(sets[0], sets[1]))


def test_near_dedup_takes_exactly_least(spark):
    """216 of 270 shingles in common: the sum of shares is a little less than 0.8 in floating point."""
    own = [[f"{d}{i}" for i in range(n)] for d, n in (("a", 28), ("b", 26))]
    rows = [(k, " ".join([f"w{i}" for i in range(220)] + w)) for k, w in enumerate(own)]
    sets = shingle_sets(rows)
    assert len(sets[0].keys() & sets[1].keys()) == 216 and len(sets[0].keys() | sets[1].keys()) == 270
    got = {r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_prob_min_hash_estimates():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.integers(1, 4, 200).astype(float), rng.integers(1, 4, 200).astype(float)
    own = np.repeat([0, 1], 200)
    hs, ws = np.concatenate([h[:200], h[100:]]), np.concatenate([wa, wb])
    sign = near_dedup.prob_min_hash(own, hs, ws, 2, 4000)
    order = lambda a, b: (np.sort(a), b[np.argsort(a)])
    assert (sign[0] == sign[1]).mean() == pytest.approx(near_dedup.similarity(order(h[:200], wa), order(h[100:], wb)), abs=0.03)


def test_near_dedup_edges(docs, empty, fixture_rows):
    got = near_dedup.classes(docs).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(by) == len({r[0] for r in fixture_rows if r[0] is not None}) and sum(r.doc_id is None for r in got) == 2
    assert by[8].class_id == by[9].class_id == by[10].class_id == 8 and by[11].class_id == by[12].class_id == by[13].class_id == 11
    assert all(by[i].class_id == i and by[i].kept for i in (0, 1, 2, 3, 4))
    kept = near_dedup.filter_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 8, 11}
    assert near_dedup.classes(empty).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}


# -- token counts


def test_token_counts(docs, fixture_rows, empty):
    scores, byte = token_counts.vocabulary(token_counts.default_model())
    longest = max(map(len, scores))

    def count(w):
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            top = (-1e300, 0)
            for k in range(1, min(longest, i) + 1):
                s = scores.get(w[i - k : i])
                if s is not None and best[i - k][0] + s >= top[0]:
                    top = (best[i - k][0] + s, best[i - k][1] + 1)
            if w[i - 1] not in scores:
                n = len(w[i - 1].encode())
                if best[i - 1][0] + byte * n > top[0]:
                    top = (best[i - 1][0] + byte * n, best[i - 1][1] + n)
            best.append(top)
        return best[-1][1]

    want = []
    for r in fixture_rows:
        w = Counter(words(r[1]))
        want.append((r[0], sum(w.values()), sum(n * count("▁" + x) for x, n in w.items())))
    assert sorted(map(tuple, token_counts.token_counts(docs).collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty).count() == 0


def test_toxicity_nested_entries():
    """One entry for each evidence along a word; entries of other evidence stay."""
    found = {"tras": (9, 1, 2.0), "trash": (9, 1, 2.0), "trash$": (9, 1, 2.0), "path": (5, 0, 3.0), "pathetic$": (5, 0, 3.0), "patho": (4, 0, 3.0), "tra": (9, 1, 2.0), "oath": (9, 1, 2.0), "moron$": (6, 0, 1.5)}
    assert toxicity.without_nested(found) == {"trash": 2.0, "path": 3.0, "patho": 3.0, "oath": 2.0, "moron$": 1.5}


def test_exact_dedup_hot_null_id(spark):
    """Rows of null doc_id and one text are counted, not gathered; one of them stays."""
    rows = [(None, "a b")] * 300 + [(None, "ab")] * 20 + [(1, " ab"), (1, "a b"), (2, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(d).collect())
    assert got == {(None, 1, 322, False): 320, (1, 1, 322, True): 1, (1, 1, 322, False): 1, (2, 2, 1, True): 1}
    only = Counter((r.doc_id, r.kept) for r in exact_dedup.assign(d.where("doc_id is null")).collect())
    assert only == {(None, False): 319, (None, True): 1}


def test_near_dedup_links_have_one_plan_at_every_size(spark):
    """Few pairs were broadcast, so that shuffles grew faster than the documents once they were not."""
    from sulcus.llm import near_dedup

    texts = spark.range(1, 3).selectExpr("id as node", "cast('x' as binary) as z")
    pairs = spark.range(1, 2).selectExpr("id as a", "id + 1 as b")
    plan = near_dedup.links(texts, pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan
