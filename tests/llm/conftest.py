import random

import pytest
from corpus_text import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, n_words string"


@pytest.fixture(scope="session")
def fixture_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    passage = prose(rng, 60, 5000)
    base = [prose(rng, 120, 5000) for _ in range(12)]
    texts = [None, "", "   \n\t ", "one", "one two three", passage, passage + " " + base[0], base[1] + "\n" + passage, base[2], base[2], "  " + base[2].replace(" ", "\n"), base[3]]
    words = base[3].split()
    for at in (40, 90):
        near = list(words)
        near[at] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(base[4].split()[:34]), " ".join(base[4].split()[:35]), " ".join(base[4].split()[:36])]
    texts += [prose(rng, 30000, 900), "x" * 70000, "▁a▁ b  <|endoftext|> É́ ß 'S don't x y \x00z", "the the the the the the the the " * 20]
    texts += ["loop a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 0 " * 3, base[5] * 2]
    rows = [(i, t, "en" if i % 3 else None, "src0" if i % 2 else ("é" if i % 4 else None), len(t or ""), "no", "9", None) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, base[6], "de", "src1", 1, None, None, None), (None, None, None, None, None, None, None, None), (-7, base[6], "de", "src1", 1, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, COLUMNS).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
