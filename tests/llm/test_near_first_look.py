"""The pipeline's near-duplicate stage: pairs that its first look gives on are a few of each text, and none is lost by that."""

import random

import numpy as np
import pytest
from test_llm_operators import docs, words
from test_near_labels import brute_keep, edited, left


def group(rng, n):
    hub = words(rng, 300, 4000)
    return [(k, edited(rng, hub, 3 + k % 8)) for k in range(n)] + [(1000 + k, words(rng, 100, 4000)) for k in range(50)]


def test_pairs_of_the_first_look_grow_with_the_texts(spark, monkeypatch):
    from spoolwave.llm import simhash

    made, cut = [], simhash.checkpoint

    def counted(df):
        out = cut(df)
        if out.columns == ["kind", "a", "b"]:
            made.append(out.where("kind = 0").distinct().count())
        return out

    monkeypatch.setattr(simhash, "checkpoint", counted)
    rows = group(random.Random(51), 240)
    got, want = left(simhash.drop_near_duplicates(docs(spark, rows))), brute_keep(rows)
    assert set(want) <= set(got) and len(got) - len(want) <= 3
    assert 0 < made[0] <= 8 * len(rows)


@pytest.mark.parametrize("close", [(1, 1), (8, 1), (1, 16)])
def test_pairs_beyond_the_closest_are_not_lost(spark, monkeypatch, close):
    from spoolwave.llm import simhash

    monkeypatch.setattr(simhash, "CLOSE", close[0])
    monkeypatch.setattr(simhash, "CLOSE_IN_ALL", close[1])
    monkeypatch.setattr(simhash, "ENTRIES", 4000)
    rng = random.Random(52)
    rows = group(rng, 60) + [(2000 + 20 * k + i, edited(rng, text, 2 + i)) for k, text in enumerate(words(rng, 200, 4000) for _ in range(6)) for i in range(7)]
    got, want = left(simhash.drop_near_duplicates(docs(spark, rows))), brute_keep(rows)
    assert set(want) <= set(got) and len(got) - len(want) <= 2


def test_closest_pairs_and_crowded_texts():
    from spoolwave.llm import simhash as s

    rng = np.random.default_rng(8)
    texts = rng.integers(-(1 << 62), 1 << 62, 40)
    pairs = sorted({(min(x, y), max(x, y)) for x, y in texts[rng.integers(0, 40, (300, 2))].tolist() if x != y})
    a, b = (np.array(v, np.int64) for v in zip(*pairs))
    for most in (1, 4, 1000):
        near, crowded = s._closest(a, b, most)
        apart = np.bitwise_count((a ^ b) & s._HEAD)
        for t in texts.tolist():
            own = (a == t) | (b == t)
            assert (own.sum() > most) == (t in crowded.tolist())
            assert near[own & (apart < np.sort(apart[own])[:most][-1])].all() and near[own].sum() >= min(most, own.sum())
        assert np.isin(a[~near], crowded).all() and np.isin(b[~near], crowded).all() and near.sum() <= most * len(texts)
    none = s._closest(a[:0], b[:0], 3)
    assert len(none[0]) == len(none[1]) == 0
