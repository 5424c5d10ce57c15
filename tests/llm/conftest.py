from __future__ import annotations

import random

import pytest

#: Rows that every operator must take: nulls, blanks, ties, repeats, long words and texts, letters beyond ASCII.
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five"), (5, "one two three four five"), (None, "no id here at all"), (None, None), (7, "x" * 5000), (8, "Ünï çødé ñandú 日本語 😀 end."), (9, "word " * 3000), (10, "A\x00B ~!@# 12 34")]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "k", 1.0, "b") for i, t in ODD], "doc_id long, text string, key string, score double, blob string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def corpus(spark):
    """Random texts with copies, near copies and passages that repeat, in few words so that chance repeats occur too."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows, passage = [], r.choices(words, k=60)
    for i in range(120):
        w = r.choices(words, k=r.choice((5, 40, 90, 200)))
        if i % 5 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[r.randrange(10):50 + r.randrange(10)]
        if i % 7 == 0 and rows:
            w = rows[r.randrange(len(rows))][1].split()
            if i % 2:
                w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w) + r.choice(("", ".", "\n"))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), rows
