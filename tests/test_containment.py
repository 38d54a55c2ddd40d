"""Codes in texts against brute force, with keys cut on both sides."""

import random

import pytest

from lintmill.operators import containment, matching
from tests.conftest import rows


@pytest.mark.parametrize("n_codes", [3, 40])
def test_hits(spark, monkeypatch, n_codes):
    monkeypatch.setattr(containment, "TEXTS", 7)
    monkeypatch.setattr(containment, "CODES", 5)
    rng = random.Random(n_codes)
    word = lambda n: "".join(rng.choices("ab é", k=rng.randint(0, n)))
    texts = sorted({(rng.choice(["hot", "hot", "f", "g"]), rng.randint(0, 2), word(9)) for _ in range(120)})
    codes = sorted({(rng.choice(["hot", "hot", "f", "h"]), rng.randint(0, 2), word(3)) for _ in range(n_codes)})
    left = spark.createDataFrame([(p, c, t, i) for i, (p, c, t) in enumerate(texts)], "path string, cell int, text string, no int")
    right = spark.createDataFrame(codes, "path string, cell int, code string")
    held = [(p, c, t, code, i) for i, (p, c, t) in enumerate(texts) for q, d, code in codes if (p, c) == (q, d) and code in t]
    assert rows(containment.hits(left.drop("no"), right, ["path", "cell"])) == sorted(h[:4] for h in held)
    first = {}
    for p, c, _, code, i in held:
        first[p, c, code] = min(i, first.get((p, c, code), i))
    got = containment.first_hits(left, right, ["path", "cell"], "no")
    assert rows(got, "path", "cell", "code", "no") == sorted((*k, i) for k, i in first.items())
    assert containment.hits(left.drop("no"), right.limit(0), ["path", "cell"]).count() == 0


def test_names_beyond_one_automaton(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abc./", k=rng.randint(1, n)))
    paths = spark.createDataFrame([(word(20),) for _ in range(150)] + [(None,)], "file_path string")
    names = spark.createDataFrame([(word(4),) for _ in range(60)] + [(None,)], "filename string")
    small = rows(matching.match_contains(paths, names))
    assert small == rows(matching.match_contains(paths, names, most=0)) and len(small) > 100
