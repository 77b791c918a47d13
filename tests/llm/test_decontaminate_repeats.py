"""Windows that repeat, in items and documents."""

import random
import time

import pytest

from chronofacts.llm.decontaminate import Scanner


@pytest.mark.parametrize("phrase", [[b"word"], [b"a", b"b"], [b"x", b"x", b"y"]])
def test_repeated_words_take_linear_time(phrase):
    """100,000 words in the item and in the document."""
    w = (phrase * 100_000)[:100_000]
    began = time.perf_counter()
    spans, items = Scanner([(1, b" ".join(w)), (2, b" ".join(w[:50])), (3, b"other words")], 10).scan(w)
    assert spans == [(0, len(w))] and items == {"1", "2"}
    assert time.perf_counter() - began < 10


def test_windows_shared_by_items_against_all_places():
    rnd = random.Random(1)
    for _ in range(200):
        items = [(k, b" ".join(rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(0, 14)))) for k in range(4)]
        doc = [rnd.choice([b"a", b"b", b"c"]) for _ in range(60)]
        hit, found = set(), set()
        for k, text in items:
            w = text.split()
            n = min(5, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                for j in range(len(doc) - n + 1):
                    if doc[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(k))
        spans, names = Scanner(items, 5).scan(doc)
        assert names == found and {x for a, b in spans for x in range(a, b)} == hit


def test_all_arrays_stay_small():
    rnd = random.Random(2)
    items = [(k, " ".join(rnd.choices([f"w{j}" for j in range(3000)], k=150)).encode()) for k in range(600)]
    size = sum(len(t) for _, t in items)
    tables = Scanner(items, 10).tables
    assert sum(x.nbytes for t in tables for x in vars(t).values() if hasattr(x, "nbytes")) + sum(len(t.shift) for t in tables) < 22 * size
