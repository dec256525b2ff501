"""Operators 11 to 13 against brute force and in edge cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def docs(spark, rows, parts=3):
    """rows of (doc_id, text[, lang]) as documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC).repartition(parts) if full else spark.createDataFrame([], DOC)


def words(rng, n, pool=60):
    return " ".join(rng.choice([f"w{i}x" for i in range(pool)]) for _ in range(n))


# 11: resampling


def brute_resample(rows, target, order=1, buckets=10_000, percent=10, least=20):
    def features(text):
        w = WORD.findall((text or "").translate(str.maketrans(UP, LOW)))
        return w, [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([r[1] for r in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for doc_id, text, *_ in rows:
        w, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least])
    open_rows = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(open_rows[: percent * len(open_rows) // 100], 1):
        r.append(k)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in out), key=repr)


def rows_for_resampling(rng):
    rows = [(i, words(rng, rng.randint(0, 60), 40)) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "ÉCLAIR Écoute été 漢字 ABC" * 5), (104, words(rng, 30_000, 400)), (105, "A\x00b_c" * 40), (None, words(rng, 40)), (106, rows[3][1]), (3, rows[3][1])]
    return rows + [rows[5]] * 7


@pytest.mark.parametrize("order", [1, 3])
def test_op11_brute_force(spark, monkeypatch, order):
    from spoolwave.llm import position_resample as p

    rng = random.Random(11)
    rows, target = rows_for_resampling(rng), [words(rng, 50, 20), None, "", "ÉCLAIR abc"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id int, text string")
    got = p.resample(docs(spark, rows), t, order=order, percent=40)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, target, order, percent=40)


def test_op11_blocks_of_positions(spark):
    """Runs over the ends of blocks are found once."""
    from spoolwave.llm.position_resample import position_table

    text = " ".join(f"a{i}" for i in range(50))
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "only")], "k int, text string")
    for block in (3, 7, 50, 64):
        got = Counter((r.k, r.feature) for r in position_table(rows, ["k"], 4, block).collect())
        w = text.split()
        want = Counter((1, " ".join(w[i : i + n])) for n in range(1, 5) for i in range(51 - n)) + Counter([(2, None), (3, "only")])
        assert got == want


def test_op11_empty_and_repeated(spark):
    from spoolwave.llm.position_resample import resample

    t = spark.createDataFrame([], "item_id int, text string")
    assert resample(docs(spark, []), t).count() == 0
    got = resample(docs(spark, [(7, "word " * 30)] * 500 + [(None, "word " * 30)] * 500), t, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 501)) and len({r.score for r in got}) == 2


# 12: planes


@pytest.mark.parametrize("bits", [False, True])
def test_op12_planes_and_back(bits):
    from spoolwave.llm.plane_store import Codec

    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        for kind in ("<u4", "<u8"):
            values = rng.integers(0, 60_000, n).astype(kind)
            data, lengths = Codec(bits).pack(values)
            assert len(lengths) == np.dtype(kind).itemsize * (8 if bits else 1) and 0 in lengths
            assert (Codec(bits).unpack(data, lengths, n, np.dtype(kind)) == values).all()


def brute_ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def odd_texts():
    rng = random.Random(3)
    odd = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0      　a1'sé漢.,<|endoftext|>x"
    return ["".join(rng.choice(odd) for _ in range(60)) for _ in range(200)] + ["a  <|endoftext|>  b", "<|endoftext|>", "  ", "don't  \n\n  x", "\xa0 x", "\xa0  x", "\U0001f600\U0001f600", "\x00"]


def test_op12_pieces_equal_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from spoolwave.llm.plane_store import PieceEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, enc = Tokenizer.from_file(path), PieceEncoder(path)
    singles = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}c" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for t in odd_texts() + singles:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("planes,chunk", [("byte", 1 << 18), ("bit", 64)])
def test_op12_brute_force(spark, monkeypatch, tmp_path, planes, chunk):
    import public_tokenizers

    from spoolwave.llm import plane_store as p

    rng = random.Random(12)
    rows = [(i * 3 - 20, t) for i, t in enumerate(odd_texts()[:60])] + [(1000, words(rng, 5000)), (1001, None), (1002, ""), (None, "no id")]
    path = f"file://{tmp_path}/store"
    p.store(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), path, planes, chunk)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in p.read_planes(spark, path).orderBy("start").collect()]
    assert got == brute_ids(rows)
    whole = b"".join(bytes(r.ids) for r in p.read_planes(spark, path).orderBy("start").collect())
    for first, n in ((0, 10), (50, 400), (len(whole) // 4 - 5, 100), (7, 0)):
        assert p.read_window(path, first, n).tobytes() == whole[4 * first : 4 * (first + n)]
    # files hold ascending, disjoint ranges of documents
    files = json.loads((tmp_path / "store" / "manifest.json").read_text())["files"]
    assert [f[1] for f in files] == list(np.cumsum([0] + [f[3] for f in files])[:-1])


def test_op12_repeated_rows_and_empty(spark):
    import public_tokenizers

    from spoolwave.llm.plane_store import round_trip

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(5, "same text")] * 300 + [(4, "x"), (6, "y"), (None, "z"), (None, "z")]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in round_trip(docs(spark, rows), path).collect())
    assert got == [(s, i, n, c) for i, s, n, c in brute_ids(rows)]
    assert round_trip(docs(spark, []), path).count() == 0


def test_op12_failed_write_leaves_no_store(spark, tmp_path):
    from spoolwave.llm import plane_store as p

    path = f"file://{tmp_path}/broken"
    bad = spark.range(100).repartition(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 50, F.raise_error(F.lit("no")).cast("binary")).otherwise(F.lit(b"\x01\x00\x00\x00")).alias("ids"))
    with pytest.raises(Exception):
        p.write_planes(bad, path)
    assert not (tmp_path / "broken" / "manifest.json").exists()


# 13: audit


def brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    told = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": t in least and (i is None or least[t] < i)}
        told[part or ""].append((i, fails))
    out = []
    for part, own in told.items():
        shapley = Counter()
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[c]]
                left = [(i, f) for i, f in left if not f[c]]
                shapley[c] += len(gone)
                failing = sum(f[c] for _, f in own)
                unique = sum(f[c] and sum(f.values()) == 1 for _, f in own)
                lines.append((part, order, step, len(left), len(gone), failing - len(gone), unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_op13_brute_force(spark):
    from spoolwave.llm.filter_audit import audit

    rng = random.Random(13)
    rows = []
    for i in range(150):
        t = words(rng, rng.choice([0, 5, 90, 99, 100, 101, 150]), rng.choice([10, 80, 81, 5000]))
        t = t.upper() if rng.random() < 0.2 else t
        rows.append((i, t + (" #" if rng.random() < 0.2 else ""), rng.choice(["de", "en", None, ""])))
    rows += [(200 + k, rows[k % 9][1], "en") for k in range(60)] + [(3, rows[3][1], "fr"), (3, rows[3][1], "fr"), (None, rows[4][1], "de"), (None, "only without id", "de"), (None, "only without id", "de")]
    rows += [(300, None, "xx"), (301, "", "xx"), (302, "ÀÉ" * 200, "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit(docs(spark, rows), frame).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(rows, labels)
    assert audit(docs(spark, []), frame).count() == 0 and len(got) == 600 * len({r[2] or "" for r in rows})


def test_op13_matrices():
    from spoolwave.llm.filter_audit import Outcomes

    m = Outcomes()
    assert m.kept.shape == (32, 600) and m.kept.dtype == np.int64
    assert ((m.kept + m.removed + m.redundant) <= 1).all() and (m.unique.sum(axis=0) == 1).all()
    assert (m.removed.reshape(32, 120, 5).sum(axis=2) == (np.arange(32) > 0)[:, None]).all()  # what fails anything is removed once


def test_op11_to_13_extra_columns_change_nothing(spark):
    import public_tokenizers

    from spoolwave.llm import filter_audit, plane_store, position_resample

    rows = [(i, f"Some words {i} " * 12, "en") for i in range(12)]
    d = docs(spark, rows)
    names = ["text", "rank", "gain", "_row", "feature", "_tie", "digest", "mask", "n", "S", "t", "Doc_ID", "part", "_range", "ids"]
    wide = d.select("*", *[F.lit(1).alias(c) for c in names])
    t = spark.createDataFrame([("Some words", 1)], "text string, TEXT int").toDF("text", "item")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    wide_labels = labels.select("*", F.lit(5).alias("quality"), F.lit(1).alias("n"), F.lit(1).alias("_id"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    runs = [lambda x, _: position_resample.resample(x, t), lambda x, _: plane_store.round_trip(x, path), filter_audit.audit]
    for f in runs:
        assert sorted(map(tuple, f(wide, wide_labels).collect()), key=repr) == sorted(map(tuple, f(d, labels).collect()), key=repr)
