"""The pipeline's near-duplicate stage against brute force: groups of near copies with large table entries."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_llm_operators import docs, words


def brute_keep(rows, similarity=0.8):
    """Rows left: of each component of texts the row of the least (id, null last, digest)."""
    import hashlib

    from spoolwave.llm.simhash import shingle_set

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).hexdigest()))
    sets = [set(shingle_set(rows[k][1] or "").tolist()) for k in order]
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(order)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((str(rows[order[i]][0]), rows[order[i]][1] or "") for i in range(len(order)) if find(i) == i)


def left(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return " ".join(w)


def test_a_group_of_near_copies_is_not_spread_out_by_entries(spark, monkeypatch):
    """Members of large entries are compared where they meet: no table has a row for each text and entry."""
    from spoolwave.llm import simhash

    rng = random.Random(41)
    hub = words(rng, 300, 4000)
    rows = [(k, edited(rng, hub, 5 + k % 6)) for k in range(150)] + [(500 + k, words(rng, 100, 4000)) for k in range(50)]
    sizes, cut = {}, simhash.checkpoint

    def counted(df):
        out = cut(df)
        if "entry" in out.columns or "place" in out.columns:
            sizes[tuple(out.columns)] = out.count()
        return out

    monkeypatch.setattr(simhash, "checkpoint", counted)
    got, want = left(simhash.drop_near_duplicates(docs(spark, rows))), brute_keep(rows)
    assert set(want) <= set(got) and len(got) - len(want) <= 3
    assert sizes and max(sizes.values()) <= len(rows)


def test_pairs_between_labels_come_out_once():
    """Every pair of two labels that meets within the radius, once; texts of one label give nothing; large entries are dealt."""
    import pyarrow as pa

    from spoolwave.llm import simhash as s

    rng, bits, segments, radius = np.random.default_rng(6), 12, 3, 9
    words = rng.integers(0, 1 << 62, (4, 2), dtype=np.uint64)[rng.integers(0, 4, 200)]
    for _ in range(4):
        words[:, 1] ^= np.uint64(1) << rng.integers(0, bits * segments, 200).astype(np.uint64)
    words = np.unique(words, axis=0)
    fps = rng.permutation(np.arange(-50, len(words) - 50)).astype(np.int64)
    value = s._segments(words, bits, segments)

    def found(labels, side, tables=3):
        rows = pa.Table.from_batches([s._labelled_entries(fps[a : a + 70], labels[a : a + 70], words[a : a + 70], bits, segments, tables) for a in range(0, len(fps), 70)])
        out = [s._between_labels(rows.filter(pa.compute.equal(rows.column("table"), k)), radius, bits, segments, tables, side).to_pylist() for k in range(tables)]
        return [r for part in out for r in part]

    labels = rng.integers(0, 3, len(fps))
    want = set()
    for i in range(len(fps)):
        for j in range(i):
            meet = (np.bitwise_count(value[i] ^ value[j]) <= 2).any()
            if meet and labels[i] != labels[j] and np.bitwise_count(words[i] ^ words[j]).sum() <= radius:
                want.add((min(fps[i], fps[j]), max(fps[i], fps[j]), int(np.bitwise_count(words[i] ^ words[j]).sum())))
    got = [(r["a"], r["b"], r["apart"]) for r in found(labels, 4096)]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
    assert found(np.zeros_like(labels), 4096) == []
    dealt = found(labels, 4)
    assert any(r["kind"] == 1 and r["apart"] > 1 for r in dealt) and {(r["a"], r["b"], r["apart"]) for r in dealt if r["kind"] == 0} < want
