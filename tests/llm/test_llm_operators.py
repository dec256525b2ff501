"""Training-data operators against brute force and in edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, parts=3):
    """rows of (doc_id, text[, source]) as documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC).repartition(parts) if full else spark.createDataFrame([], DOC)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def words(rng, n, pool=60):
    known = [f"w{i}x" for i in range(pool)]
    return " ".join(rng.choice(known) for _ in range(n))


# 1: exact substrings


def brute_repeats(rows, width=50):
    first, out = {}, {}
    for i, text in sorted(((i if i is not None else 1 << 62, t) for i, t in rows), key=lambda r: r[0]):
        b = (text or "").encode()
        covered, own = np.zeros(len(b), bool), []
        for p in range(len(b) - width + 1):
            own.append(b[p : p + width])
            if first.get(b[p : p + width], 1 << 63) < i:
                covered[p : p + width] = True
        for x in own:
            first.setdefault(x, i)
        a = np.frombuffer(b, np.uint8)
        spans = int((covered & ~np.append(False, covered[:-1])).sum())
        out.setdefault(None if i == 1 << 62 else i, []).append((len(b), int(covered.sum()), spans, hashlib.sha256(a[~covered].tobytes()).hexdigest()))
    return out


def test_op1_brute_force(spark):
    from spoolwave.llm.suffix_dedup import dedup

    rng = random.Random(1)
    shared = words(rng, 30)
    rows = [(i, words(rng, rng.randint(0, 60), 400) + (" " + shared[rng.randint(0, 40) :] if i % 3 else "") + words(rng, 20, 400)) for i in range(60)]
    rows += [(100, "a" * 4000), (101, "a" * 3000 + "b" + "a" * 100), (102, "é" * 200 + "\x00" * 80), (103, "x" + "é" * 100), (104, ""), (105, None), (106, "short"), (107, rows[5][1]), (108, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (None, shared)]
    got = by_id(dedup(docs(spark, rows)))
    want = brute_repeats(rows)
    assert {k: sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert dedup(docs(spark, [])).count() == 0


def test_op1_hot_hashes_and_small_blocks(spark, monkeypatch):
    """Hot hashes are dealt by window, and merges over many shards give the same."""
    import pyarrow as pa

    from spoolwave.llm import suffix_dedup as s

    monkeypatch.setattr(s, "HOT", 3)
    monkeypatch.setattr(s, "SHARD", 300)
    monkeypatch.setattr(s, "MERGE", 2000)
    monkeypatch.setattr(s, "SECTION", 256)
    rng = random.Random(2)
    passage = words(rng, 25)
    rows = [(i, words(rng, rng.randint(1, 30), 500) + passage[rng.randint(0, 9) :] + words(rng, 9, 500)) for i in range(24)]
    tables = [pa.table({"g": pa.array([g] * 8, pa.int64()), "id": pa.array([r[0] for r in rows[g::3]], pa.int64()), "text": [r[1] for r in rows[g::3]]}) for g in range(3)]
    # the same steps as the plan, by hand
    offers = pa.concat_tables([s._offer(t, 2) for t in tables])
    groups = lambda t, k: [t.filter(pa.compute.equal(t.column(k), v)) for v in sorted(set(t.column(k).to_pylist()))]
    states = pa.concat_tables([s._settle(t) for t in groups(offers, "bucket")])
    assert any((s._unpack(v)["state"] == 2).any() for v in states.column("value").to_pylist())
    pick = lambda t, g: t.filter(pa.compute.equal(t.column("g"), g))
    sent = pa.concat_tables([s._send(t, pick(states, g), 2, 2) for g, t in enumerate(tables)])
    answers = pa.concat_tables([s._merge(t) for t in groups(sent, "bucket")])
    out = pa.concat_tables([s._finish(t, pick(answers, g), 2) for g, t in enumerate(tables)]).to_pylist()
    want = brute_repeats(rows)
    assert {r["doc_id"]: [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])] for r in out} == want


def test_op1_merge_equals_sorting():
    from spoolwave.llm.suffix_dedup import END, merge_transforms, shard_transform

    rng = random.Random(3)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(50, 110))) for _ in range(40)]
    shards, counts, where = [], [], []
    for k in range(0, 40, 10):
        own = strings[k : k + 10]
        text = np.frombuffer(b"".join(x + bytes([END]) for x in own), np.uint8)
        left = np.concatenate([np.arange(len(x), -1, -1) for x in own])
        order, before = shard_transform(text, left)
        flat = [(k + j, p) for j, x in enumerate(own) for p in range(len(x) + 1)]
        shards.append(before)
        counts.append(10)
        where.append([flat[i] for i in order])
    z, begins = merge_transforms(shards, counts)
    at = [0] * 4
    rows = []
    for s in z.tolist():
        rows.append(where[s][at[s]])
        at[s] += 1
    prefix = lambda r: strings[r[0]][r[1] :][:50]
    keyed = [(prefix(r) + (b"\xff" if len(prefix(r)) < 50 else b"")) for r in rows]
    assert keyed == sorted(keyed)
    for i in range(1, len(rows)):
        same = len(keyed[i]) == 50 and keyed[i] == keyed[i - 1] and not keyed[i].endswith(b"\xff")
        assert begins[i] == (not same)


def test_op1_kept_bytes(spark):
    from spoolwave.llm.suffix_dedup import deduplicated

    base = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    got = by_id(deduplicated(docs(spark, [(1, base), (2, "start " + base + " end")])))
    assert bytes(got[1][0].kept) == base.encode() and bytes(got[2][0].kept) == b"start  end"


# 2: secrets


def test_op2_spans(spark):
    from spoolwave.llm.secret_scan import redact, scan

    text = 'Password: "hunter22" x AKIA' + "A" * 16 + " y " + "0f" * 12 + " token=abc secret = key1"
    pair = "é user=alice42 then pwd=s3cretvalue at https://db.example.com:5432/x"
    rows = [(1, text), (2, None), (3, ""), (4, pair), (5, "pwd=s3cretvalue alone"), (6, "user=alice42 " + "z" * 600 + " pwd=s3cretvalue"), (7, text), (7, text), (None, "token=abcdef1")]
    got = by_id(scan(docs(spark, rows)))
    r = got[1][0]
    kinds = {}
    for s in r.spans.split(","):
        k, a, b = s.split(":")
        kinds.setdefault(k, []).append(text[int(a) : int(b)])
    assert kinds["assign"] == ['Password: "hunter22'] and kinds["access"] == ["AKIA" + "A" * 16] and kinds["hex"] == ["0f" * 12]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(",".join(s for s in r.spans.split(",") if not s.startswith("pair")).encode()).hexdigest()
    linked = [pair[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[4][0].spans.split(",")]
    assert linked == ["user=alice42", "pwd=s3cretvalue", "https://db.example.com:5432"]
    assert got[5][0].spans == "" and got[6][0].spans == "" and got[5][0].n_linked == 0
    assert got[2][0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3][0].spans == ""
    assert len(got[7]) == 2 and got[7][0].spans == got[7][1].spans and got[None][0].n_assign == 1
    assert scan(docs(spark, [])).count() == 0
    clean = by_id(redact(docs(spark, rows)))
    assert clean[4][0].text == "é [SECRET] then [SECRET] at [SECRET]/x" and clean[4][0].n_chars == len(clean[4][0].text)
    assert clean[1][0].text.startswith('[SECRET]" x [SECRET] y [SECRET] token=abc') and len(clean[7]) == 2 and clean[2][0].text is None
    assert clean[5][0].text == "pwd=s3cretvalue alone" and redact(docs(spark, rows)).columns == docs(spark, rows).columns


def test_op2_multipart_keys(spark):
    from spoolwave.llm.secret_scan import redact, scan

    key, token = "AKIA" + "Q7" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    texts = {
        1: f"aws_access_key_id = {key}\naws_secret_access_key = {token}\n",
        2: f"secret_key: {token} for user_id: u-1234",
        3: f"{key} {token} at https://s3.example.com/bucket",
        4: f"lonely {token} here",
        5: f"secret_access_key = {token}",
        6: "user: bob-the-builder " + "x" * 450 + f" signing_key={token}",
    }
    got = {i: [texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in v[0].spans.split(",") if s] for i, v in by_id(scan(docs(spark, list(texts.items())))).items()}
    assert got[1] == [key, f"secret_access_key = {token}"]
    assert got[2] == [f"secret_key: {token}", "user_id: u-1234"] and got[3] == [key, token, "https://s3.example.com"]
    assert got[4] == [] and got[5] == [] and got[6] == ["user: bob-the-builder", f"signing_key={token}"]
    clean = by_id(redact(docs(spark, list(texts.items()))))
    assert not any(token in clean[i][0].text for i in (1, 2, 3, 6))


def test_op2_dense_text_in_linear_time(spark):
    import time

    from spoolwave.llm.secret_scan import scan

    took = []
    for n in (2000, 10000, 50000):
        start = time.time()
        r = scan(docs(spark, [(1, "token=abcdef1 user=bob77 " * n)])).first()
        took.append(time.time() - start)
        assert r.n_assign == n and r.n_linked == n
    assert took[2] < 8 * took[1] + 5


def test_op2_brute_force(spark):
    from spoolwave.llm.secret_scan import scan

    rng = random.Random(4)
    bits = ["token=", "Secret : ", "api_key='", "APIKEY=", "passwd = \"", "AKIA", "ABCDEF0123456789XYZ", "0123456789abcdef", "deadbeefdeadbeef", " ", "\n", "é", "=x", "user=bob77 ", "pass: longvalue9 ", "key", "."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    got = by_id(scan(docs(spark, rows)))
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in rows:
        s = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i][0].base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(s)).encode()).hexdigest(), (i, t)


# 3: classifier


def test_op3(spark):
    from spoolwave.llm.line_crf import classify, held_out, keep_good

    rng = random.Random(5)
    good = lambda: "\n".join(words(rng, rng.randint(6, 20), 900).capitalize() + "." for _ in range(rng.randint(1, 9)))
    bad = lambda: "\n".join(" ".join(w + "###" for w in words(rng, rng.randint(3, 20), 20).split()) for _ in range(rng.randint(1, 9)))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (1002, " \n \n"), (1003, "x\n" * 5000), (None, "One line here.")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(5, 1, 0), (None, 1, 0), (7, None, 0), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    d = docs(spark, rows)
    got = by_id(classify(d, labels))
    assert sum(len(v) for v in got.values()) == len(rows)
    out = [i for i in range(400) if held_out(i)]
    assert np.mean([got[i][0].predicted == int(i % 4 > 0) for i in out]) > 0.95
    assert all(got[i][0].held_out == held_out(i) for i in range(400)) and got[1001][0].score == 0 == got[1000][0].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for v in got.values() for r in v)
    again = by_id(classify(d, labels))
    assert all(abs(again[k][0].score - got[k][0].score) < 1e-9 for k in got)
    kept = keep_good(d, labels)
    assert kept.columns == d.columns and set(r.doc_id for r in kept.collect()) == {k for k, v in got.items() if v[0].predicted}
    assert classify(docs(spark, []), labels).count() == 0
    none = classify(docs(spark, [(1, "a b c")]), labels.where("false")).collect()
    assert len(none) == 1 and 0 <= none[0].score <= 1


def test_op3_trains_on_whole_documents(spark):
    from spoolwave.llm.line_crf import classify

    rng = random.Random(21)
    clean = lambda n: [" ".join(rng.choice(("river", "stone", "walks", "under", "green")) for _ in range(8)) + "." for _ in range(n)]
    junk = lambda n: ["### $$$ BUY | NOW !!! %% " + rng.choice("ABC") * 3 for _ in range(n)]
    rows = [(i, "\n".join(clean(70) + (junk(50) if i % 2 else clean(50))), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, quality int")
    got = {r.doc_id: r.predicted for r in classify(docs(spark, rows), labels).collect()}
    assert got == {i: 1 - i % 2 for i in range(60)}


def test_op3_marginals_against_enumeration():
    from itertools import product

    from spoolwave.llm.line_crf import marginals

    rng = np.random.default_rng(0)
    lengths, trans = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    scores = rng.normal(size=(8, 2))
    p, pair, logz = marginals(scores, trans, lengths)
    want, total_pair, total = np.zeros((8, 2)), np.zeros((2, 2)), 0.0
    at = 0
    for n in lengths:
        weights = {y: math.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))) for y in product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        total += math.log(z)
        for y, v in weights.items():
            for i in range(n):
                want[at + i, y[i]] += v / z
            for i in range(n - 1):
                total_pair[y[i], y[i + 1]] += v / z
        at += n
    assert np.allclose(p, want) and np.allclose(pair, total_pair) and abs(logz - total) < 1e-9


# 4: mixing


def test_op4(spark):
    from spoolwave.llm.source_mix import mix, mixed_documents

    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 40)), None if i % 11 == 0 else ["big", "big", "b", "C", "d"][i % 5]) for i in range(300)]
    rows += [(300, None, "b"), (301, "", "only-empty"), (302, "é x", "b"), (302, "é x", "b"), (None, "a b", "d"), (303, "t " * 5000, "d")]
    got = mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    source = {}
    for i, t, s in rows:
        source[i] = s
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall(dict((i, t) for i, t, _ in rows)[r.doc_id] or "")) and r.source_size == sizes[s]
        assert abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(mix(docs(spark, rows, 5)).collect()) == key(got)
    out = mixed_documents(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(taken.values())
    assert mix(docs(spark, [])).count() == 0


def test_op4_quality_draws_first(spark):
    from spoolwave.llm.source_mix import mix

    rows = [(i, "a b c d", "s" if i % 2 else "t") for i in range(4000)] + [(9000 + i, "x " * 30000, f"u{i}") for i in range(2)]
    quality = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(4000)], "doc_id bigint, quality int")
    got = mix(docs(spark, rows), quality).where("doc_id < 4000 and taken % (2 * size) > 0").collect()
    assert got is not None  # sources may be full; the order itself is tested below
    from spoolwave.llm.source_mix import sampling_key

    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 < 2, 2.0).otherwise(0.5).alias("w"))
    first = d.orderBy(sampling_key(F.col("doc_id"), F.col("w"))).limit(1000).where("w = 2.0").count()
    assert 700 < first < 900  # 0.8 expected for weights 4 to 1 at the start


# 5: pages


PAGE = "page_id bigint, url string, html string"


def test_op5(spark):
    from spoolwave.llm.wrapper import extract

    def page(i, body):
        return (
            f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><header><a href='/'>Site</a></header><nav><ul><li><a href='/{i}'>Menu {i}</a></li></ul></nav>"
            f"<!-- c --><div class='ad'>Buy {i}</div><div id=wrap><p>Always the same notice here.</p><article><h1>Title {i}</h1>{body}</article></div><aside>Side {i}</aside>"
            f"<form><input name=q><p>Search {i}</p></form><div class=comments><p>Comment {i}</p></div><footer>&copy; {i}</footer><script>var x='</p>{i}';</script></body></html>"
        )

    rows = [(i, f"http://h.example/{i}", page(i, f"<p>First  &amp; <b>bold</b>\n{i}<br>line<p>Second &lt;{i}&gt; &eacute;</p>")) for i in range(12)]
    rows += [(20, None, None), (21, "not a url", ""), (22, "http://x.example/", "plain text &amp; more"), (23, "http://y.example/", "<div><p>Unclosed <p>Blocks<div class=sidebar>side</div>"), (3, rows[3][1], rows[3][2]), (24, "http://z.example/", "<article>" + "<p>same words</p>" * 3000 + "</article>")]
    rows += [(30 + i, f"http://copy.example/{i}", "<main><p>Copied page text.</p></main>") for i in range(6)]
    df = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("clash"))
    got = by_id(extract(df), "page_id")
    for i in range(12):
        assert got[i][0].text == f"Title {i}\n\nFirst & bold {i} line\n\nSecond <{i}> é", i
    assert got[20][0].text == "" and got[20][0].n_chars == 0 and got[21][0].text == "" and got[22][0].text == "plain text & more"
    assert got[23][0].text == "Unclosed\n\nBlocks" and len(got[3]) == 2 and got[24][0].text.count("same words") == 3000
    assert all(got[30 + i][0].text == "Copied page text." for i in range(6))
    assert all(r.n_chars == len(r.text) for v in got.values() for r in v)
    assert extract(spark.createDataFrame([], PAGE)).count() == 0


def test_op5_template_without_main_element(spark):
    from spoolwave.llm.wrapper import Wrapper

    pages = [f"<body><div><p>Welcome to our site</p><div><p>Story number {i} begins.</p><p>And {i} ends.</p></div><p>All rights with us</p></div></body>" for i in range(8)]
    w = Wrapper(pages)
    assert [w.extract(p) for p in pages] == [f"Story number {i} begins.\n\nAnd {i} ends." for i in range(8)]


def test_op5_matching_is_best():
    from spoolwave.llm import wrapper

    rng = random.Random(8)

    def tree(depth):
        n = wrapper.Node(rng.choice("pd") if depth else "#", "t")
        if depth:
            n.children = [tree(depth - 1 if rng.random() < 0.6 else 0) for _ in range(rng.randint(0, 4))]
        return n

    def brute(x, y):
        if x.tag != y.tag:
            return 0
        table = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, a in enumerate(x.children):
            for j, b in enumerate(y.children):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + brute(a, b))
        return 1 + table[-1][-1]

    better = 0
    for _ in range(200):
        a, b = tree(3), tree(3)
        a.tag = b.tag = "d"
        wrapper.signature(a), wrapper.signature(b)
        assert wrapper._score(a, b, {}) <= brute(a, b)
        better += wrapper._score(a, b, {}) == brute(a, b)
        out = {}
        wrapper.align(a, b, out)
        assert out[id(a)] is b and len({id(v) for v in out.values()}) == len(out)
    assert better >= 180  # taking equal ends first costs little


def test_op5_matching_is_exact_at_every_size(monkeypatch):
    from spoolwave.llm import wrapper

    def block(shape):
        n = wrapper.Node("d")
        n.children = [wrapper.Node("#", "t") if c == "#" else block(c) for c in shape]
        return n

    menu = ["#" * 2] * 5
    other = block([menu, "#" * 7])
    own = block([menu, "#"])
    for n in (own, other):
        wrapper.signature(n)
    assert wrapper._score(own, own, {}) == own.size == 18 and wrapper._score(own, other, {}) == 17
    # 500 unlike blocks against the same with one more in front and one more in the middle
    shapes = [["#" * (1 + i % 9), "#" * (1 + i // 9 % 9), "#" * (1 + i // 81)] for i in range(500)]
    a, b = block(shapes), block([["#"], *shapes[:250], ["#"], *shapes[250:], "#"])
    wrapper.signature(a), wrapper.signature(b)
    for table in (wrapper.TABLE, 10**9):
        monkeypatch.setattr(wrapper, "TABLE", table)
        out = {}
        wrapper.align(a, b, out)
        assert [out[id(x)] for x in a.children] == [*b.children[1:251], *b.children[252:502]]


def test_op5_deep_nesting():
    from spoolwave.llm import wrapper

    for depth in (160, 3000):
        page = f"<div><article>{'<div>' * depth}<nav>Menu</nav>Deep.{'</div>' * depth}<p>After.</p></article></div>"
        assert wrapper.Wrapper([page]).extract(page) == "Deep.\n\nAfter."
        pages = [page.replace("Deep.", f"Deep {i}.").replace("<p>", "<p>x</p>" * i + "<p>") for i in range(5)]
        assert all(f"Deep {i}." in t for i, t in enumerate(map(wrapper.Wrapper(pages).extract, pages)))


def test_op5_odd_markup():
    from spoolwave.llm.wrapper import Wrapper

    one = lambda page: Wrapper([page]).extract(page)
    assert one('<p title="5" tall">two</p><p>three</p>') == "two\n\nthree" and one('a<img alt=5" src=x>b') == "a b"
    assert one('<p title="a > b">x</p>') == "x" and one("<p " + "a='b' " * 3000 + "c") .startswith("<p ")
    assert one('<p>Read <span class="ad">BUY</span>on <b hidden>no</b><a class="share" href=x>Tweet <i>it</i></a>and on.</p>') == "Read on and on."
    assert one('<div><span class="ad"><div>BUY</div></span><p>Text.</p></div>') == "Text."
    for name in ("text-ad-free", "story-related-facts", "shadow", "header-free-content", "adventure"):
        assert one(f'<section class="{name}"><p>Kept.</p></section>') == "Kept."
    for name in ("sidebar", "left-sidebar", "ad-slot", "site_footer wide", "post-comments"):
        assert one(f'<div><div class="{name.replace("_", "-")}"><p>Gone.</p></div><p>Kept.</p></div>') == "Kept."


def bare_page(i, rng):
    """A page without a telling name; menu, advert and notice vary or not, as does the number of paragraphs."""
    menu = "".join(f'<div><a href="/{rng.random()}">{words(rng, 2)}</a></div>' for _ in range(rng.randint(3, 6)))
    body = [f"Story {i} " + words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 7))]
    inner = "".join(f"<p>{b}</p>" for b in body)
    return f"<body><div>{menu}</div><div>{words(rng, 3)}</div><div><h1>Title {i}</h1>{inner}</div><div>All rights with us</div></body>", "\n\n".join([f"Title {i}", *body])


@pytest.mark.parametrize("group", [400, 3])
def test_op5_without_any_name(spark, monkeypatch, group):
    from spoolwave.llm import wrapper

    monkeypatch.setattr(wrapper, "GROUP", group)
    rng = random.Random(21)
    made = [bare_page(i, rng) for i in range(30)]
    rows = [(i, f"http://h{i % 2}.example/{i}", html) for i, (html, _) in enumerate(made)]
    got = by_id(wrapper.extract(spark.createDataFrame(rows + rows[:2], PAGE)), "page_id")
    assert [got[i][0].text for i in range(30)] == [text for _, text in made] and len(got[0]) == len(got[1]) == 2
    # without a host's other pages nothing tells the menu's end from the story
    assert all(wrapper.Wrapper([html]).extract(html) != text for html, text in made)


def test_op5_parts_of_a_host_agree(spark, monkeypatch):
    from spoolwave.llm import wrapper

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", F.lit("http://one.example/").alias("url"), "html")
    whole = {r.page_id: r.text for r in wrapper.extract(pages).collect()}
    monkeypatch.setattr(wrapper, "GROUP", 4)
    assert {r.page_id: r.text for r in wrapper.extract(pages).collect()} == whole


def test_op5_template_against_brute_force():
    from spoolwave.llm.wrapper import LEAST_PAGES, SHARE, Template, numbered, runs, survey, totals

    rng = random.Random(22)
    html = [bare_page(i, rng)[0] for i in range(12)]
    root, order = numbered(html[3])
    pages = [runs(h, root) for h in html]
    rows = totals(survey(pages))
    template = Template(order, rows)
    stand = [(r.spot.number, r.text) for page in pages for r in page if r.spot is not None]
    for page in pages:
        for r in page:
            times, here = stand.count((r.spot.number, r.text)) if r.spot else 0, sum(n == r.spot.number for n, _ in stand) if r.spot else 0
            # of two equally frequent texts at most one is template, so the share must be above a half to be sure
            if times * 2 != here:
                assert template.constant(r, LEAST_PAGES, SHARE) == (times >= LEAST_PAGES and times >= SHARE * here)


# 6: rules


def brute_measure(text):
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_op6(spark):
    from spoolwave.llm.weak_rules import judge

    rng = random.Random(9)
    stop = "the of and in to is it that with was".split()
    line = lambda: " ".join(w + " " + rng.choice(stop) for w in words(rng, 12, 700).split()).capitalize() + "."
    rows = [(i, "\n".join(line() for _ in range(rng.randint(5, 9)))) for i in range(120)]
    rows += [(200 + i, " ".join(w + "$$$" for w in words(rng, 90, 500).split())) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "a b c " * 60), (303, "é x y z\x0bq"), (304, "x\nx\nx\n \n \ny"), (None, rows[0][1]), (0, rows[0][1]), (305, words(rng, 60000, 5000))]
    got = by_id(judge(docs(spark, rows)))
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        want = brute_measure(t or "")
        assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want for r in got[i]), i
        assert all(r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed) for r in got[i])
    assert all(got[i][0].kept for i in range(120)) and not any(got[200 + i][0].kept for i in range(12))
    assert judge(docs(spark, [])).count() == 0


def slow_em(votes, rounds=500):
    """Dawid-Skene document by document, straight from its definition."""
    from spoolwave.llm.weak_rules import PRIOR, PRIOR_DOCS, START

    post = [START[min(sum(v == 1 for v in row), len(START) - 1)] for row in votes]
    for _ in range(rounds):
        share = (sum(post) + PRIOR_DOCS * PRIOR) / (len(post) + PRIOR_DOCS)
        tables = []
        for k in range(len(votes[0])):
            good, bad, times = [0.0] * 3, [0.0] * 3, [0.0] * 3
            for p, row in zip(post, votes):
                good[row[k]] += p
                bad[row[k]] += 1 - p
                times[row[k]] += 1 / len(votes)
            tables.append(([(x + t) / (sum(good) + 1) for x, t in zip(good, times)], [(x + t) / (sum(bad) + 1) for x, t in zip(bad, times)]))
        new = []
        for row in votes:
            good = math.log(share) + sum(math.log(t[0][v]) for t, v in zip(tables, row))
            bad = math.log(1 - share) + sum(math.log(t[1][v]) for t, v in zip(tables, row))
            new.append(1 / (1 + math.exp(min(max(bad - good, -40), 40))))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    return post


def test_op6_posterior_against_slow_em(spark):
    from spoolwave.llm.weak_rules import features, judge, rules

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = rules()
    rows = features(table).select("doc_id", *[F.when(bad, 1).when(good, 2).otherwise(0).alias(name) for name, bad, good in found]).orderBy("doc_id").collect()
    want = slow_em([[r[name] for name, *_ in found] for r in rows])
    got = {r.doc_id: r for r in judge(table).collect()}
    assert len(got) == len(rows)
    for r, p in zip(rows, want):
        assert abs(got[r.doc_id].posterior - p) < 1e-4
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and got[r.doc_id].posterior >= 0.5)


def test_op6_recovers_planted_accuracies():
    from spoolwave.llm.weak_rules import em

    rng = np.random.default_rng(17)
    n, share = 60000, 0.8
    good = np.array([[0.3, 0.1, 0.6], [0.9, 0.1, 0.0], [0.5, 0.05, 0.45], [0.2, 0.3, 0.5], [0.85, 0.15, 0.0], [0.6, 0.1, 0.3]])
    bad = np.array([[0.3, 0.5, 0.2], [0.3, 0.7, 0.0], [0.5, 0.4, 0.1], [0.2, 0.45, 0.35], [0.84, 0.16, 0.0], [0.4, 0.5, 0.1]])
    is_good = rng.random(n) < share
    votes = np.stack([np.where(is_good, rng.choice(3, n, p=good[k]), rng.choice(3, n, p=bad[k])) for k in range(6)], axis=1)
    patterns, counts = np.unique((votes * 3 ** np.arange(6)).sum(1), return_counts=True)
    weights, bias = em(patterns, counts.astype(float), 6)
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.log(good) - np.log(bad)
    seen = np.isfinite(want)
    assert np.abs(weights - want)[seen].max() < 0.25 and abs(1 / (1 + math.exp(-bias)) - share) < 0.02
    assert abs(weights[4, 1]) < 0.25 < abs(weights[1, 1])  # a rule that knows nothing counts for nothing


def test_op6_is_not_all_must_pass(spark):
    from spoolwave.llm.weak_rules import features, judge, rules

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    n_bad = sum((F.when(bad, 1).otherwise(0) for _, bad, _ in rules()), F.lit(0))
    seen = judge(table).join(features(table).select("doc_id", n_bad.alias("n_bad")), "doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").where("not base_failed")
    r = seen.agg(
        F.count_if(F.expr("kept and n_bad > 0")).alias("despite"), F.count_if(F.expr("not kept")).alias("gone"),
        F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 1 and kept")).alias("good_kept"), F.count_if(F.expr("quality = 0 and kept")).alias("bad_kept"),
    ).first()
    assert r.despite > 50 and r.gone > 20 and r.good_kept >= 0.99 * r.good and r.bad_kept <= 0.05 * r.good_kept


# 7: SimHash


def brute_fp(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    return [min((ids[k] for k in groups[find(i)] if ids[k] is not None), default=None) for i in range(len(ids))]


def test_op7(spark):
    from spoolwave.llm.simhash import near_duplicates

    rng = random.Random(10)
    base = [words(rng, 400, 3000) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)]
    for k in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w).upper() if k % 7 == 0 else "\t".join(w)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "one two"), (305, "ONE two"), (306, "a b c"), (0, base[0]), (None, base[1]), (307, "é É ñ x"), (308, words(rng, 30000))]
    got = near_duplicates(docs(spark, rows)).collect()
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((rows[k][0], f"{fps[k]:016x}", comp[k]) for k in range(len(rows))), key=key)
    assert near_duplicates(docs(spark, [])).count() == 0


def test_op7_index_finds_all_pairs(spark):
    from spoolwave.llm.simhash import near_pairs

    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for _ in range(rng.randint(1, 3)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps |= {0, 1, 3, (1 << 64) - 1, 1 << 63, (1 << 31) | (1 << 32)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [(r.a, r.b) for r in near_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    from spoolwave.llm.components import connected_components

    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(500, 501 + k) for k in range(80)] + [(7, 7), (3, 2), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    link = {frozenset(e) for e in edges if None not in e}
    assert got == dict(zip(nodes, brute_components(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in link)))
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 8: WARC


def test_op8(spark, tmp_path):
    from spoolwave.llm.warc import read_warc, round_trip, write_warc, as_records

    big = "<p>é" + "x" * 300
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (5, None, big), (3, "http://a/3\r\nEvil: 1", "short"), (4, "http://a/4", "short"), (6, "u", None), (7, "u", ""), (None, "http://n", big), (8, "v", "y" * 99), (9, "v", "y" * 99), (10, "w", "z" * 100), (11, "w", "z" * 100), (2, "http://a/2", big), (12, "l", "long" * 700_000)]
    pages = spark.createDataFrame(rows, PAGE).repartition(3)
    got = [tuple(r) for r in round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "").encode() == b and j is not None), default=None)
        again = len(b) >= 100 and first is not None and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert round_trip(spark.createDataFrame([], PAGE)).count() == 0
    path = f"file://{tmp_path}/w"
    write_warc(as_records(pages), path)
    rows = read_warc(spark, path).where("record_type = 'response' and page_id in (3, 12)").collect()
    assert {r.page_id: len(r.payload) for r in rows} == {3: 5, 12: 2_800_000}
    plan = read_warc(spark, path).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_op8_reads_other_archives_and_skips(spark, tmp_path):
    import gzip

    from spoolwave.llm.warc import Stretch, WarcReader, member, read_warc, record

    plain = record(1, "http://a", "response", None, "0" * 64, b"hello") + record(2, "http://b", "revisit", 1, "0" * 64, b"hello")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.warc").write_bytes(plain)
    (tmp_path / "x" / "b.warc.gz").write_bytes(gzip.compress(record(3, None, "response", None, "0" * 64, b"again")) + gzip.compress(record(4, "u", "response", None, "0" * 64, b"")))
    rows = {r.page_id: r for r in read_warc(spark, f"file://{tmp_path}/x").collect()}
    assert bytes(rows[1].payload) == b"hello" and rows[2].payload is None and bytes(rows[3].payload) == b"again" and rows[3].target_uri is None and rows[4].payload == b""
    (tmp_path / "y").mkdir()
    big = np.random.default_rng(0).bytes(200_000)
    (tmp_path / "y" / "c.warc.gz").write_bytes(member(record(1, "u", "response", None, "0" * 64, big)) + member(record(2, "u", "revisit", 1, "0" * 64, big)))
    reader = WarcReader(f"file://{tmp_path}/y", payload=True)
    reader.wanted = lambda row: row["record_type"] == "revisit"
    assert [r["page_id"] for b in reader.read(Stretch("c.warc.gz", 0, None)) for r in b.to_pylist()] == [2] and reader.skipped > 190_000


# 9: BPE


def test_op9_equals_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from spoolwave.llm.bpe_trie import decode, digests, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(13)
    texts = ["", None, "<|endoftext|>", "a<|endoftext|> b<|endoftext", " \n\t x  ", "don't we'LL they've", "日本語 🙂🙂 é́", "\x00\x1c\x85 z", "a" * 5000, "ab" * 3000, "=" * 300, "1234567890" * 20]
    texts += ["".join(rng.choice("abcdefghij .,!?\n\t0123éß日🙂'") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(0, ""), (None, "null id")]
    vocabulary = [(i, t) for i, t in rows]
    got = by_id(digests(docs(spark, vocabulary), path))
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want for r in got[i]), t
    d = docs(spark, [(i, t) for i, t in enumerate(texts)])
    back = by_id(decode(encode(d, path), path))
    assert all(back[i][0].text == (t or "") for i, t in enumerate(texts))
    assert digests(docs(spark, []), path).count() == 0


def test_op9_trie_equals_definition():
    import public_tokenizers

    from spoolwave.llm.bpe_trie import Vocabulary, encode_words

    v = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(14)
    found = {bytes(rng.choice(b"aeinrst hing\xc3\xa9") for _ in range(rng.randint(1, 30))) for _ in range(3000)} | {b"a" * 1500}
    for word, ids in encode_words(v, found):
        assert ids == v.merge(word)


# 10: embeddings


VEC = "vec_id bigint, embedding array<float>, label int"


def brute_links(rows):
    ok = [i is not None and bool(v) and None not in v and all(map(math.isfinite, v)) and any(v) for i, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if o else None for (_, v), o in zip(rows, ok)]
    linked = lambda i, j: i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9
    n = [sum(linked(i, j) for j in range(len(rows))) for i in range(len(rows))]
    return n, brute_components([i for i, _ in rows], linked)


@pytest.mark.parametrize("tile", [2048, 16])
def test_op10(spark, monkeypatch, tile):
    from spoolwave.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "TILE", tile)
    monkeypatch.setattr(embed_dedup, "CELL_SIZE", 40)
    rng = np.random.default_rng(15)
    base = rng.normal(size=(40, 16))
    rows = [(i, base[i % 40] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)) for i in range(240)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += [(500 + k, rows[3][1]) for k in range(50)] + [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] + [1.0] * 15), (604, [None] + [1.0] * 15), (605, [1.0, 0.0]), (606, [2.0, 0.0]), (607, [float("inf")] * 16), (None, rows[0][1]), (608, [-x for x in rows[3][1]]), (609, [x * 1000 for x in rows[3][1]])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VEC).repartition(4)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    n, comp = brute_links(rows)
    want_links, found_links = sum(n), sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and found_links <= want_links and found_links >= 0.97 * want_links
    for k, (i, _) in enumerate(rows):
        assert got[i].n_links <= n[k] and got[i].kept == (got[i].component_id == i or i is None)
        assert got[i].component_id is None or comp[k] is None or got[i].component_id >= comp[k]
    assert got[605].n_links == 1 and got[606].component_id == 605 and got[600].n_links == 0 and got[600].component_id == 600
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_op10_finds_every_link_of_a_hot_cluster(spark):
    from spoolwave.llm.embed_dedup import near_duplicates

    rng = np.random.default_rng(17)
    centre = rng.normal(size=64)
    x = np.vstack([centre + 0.27 * rng.normal(size=(5000, 64)), rng.normal(size=(5000, 64))]).astype(np.float32)
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = np.concatenate([(u[i : i + 1000] @ u.T >= 0.9).sum(axis=1) for i in range(0, len(u), 1000)]) - 1
    assert (want[:5000] > 3000).mean() > 0.9
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], VEC).repartition(4)
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert {got[i].component_id for i in range(5000) if want[i]} == {min(i for i in range(5000) if want[i])}


def test_op10_bounds_hold():
    from spoolwave.llm.embed_dedup import linked, quantise, unit

    rng = np.random.default_rng(16)
    x = unit(rng.normal(size=(300, 24)) * 10.0 ** rng.integers(-8, 8, size=(300, 1)))
    q, s, e = quantise(x)
    exact = x @ x.T
    near = (q @ q.T).astype(np.float64) * s[:, None] * s[None, :]
    assert (np.abs(exact - near) <= e[None, :] + e[:, None] * (1 + e[None, :]) + 1e-12).all()
    for t in (0.1, 0.5, 0.9):
        i, j = linked(x, x, t)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*[a.tolist() for a in np.nonzero(exact >= t)]))


# extra columns


CLASH = ["Text", "fp", "id", "_key", "_digest", "_id", "_n", "_cut", "_cuts", "size", "source_size", "target", "g", "kind", "start", "score", "TAKEN", "bucket", "value", "cid", "component", "host", "payload", "seg", "_size"]


def clash(df):
    for n in CLASH:
        df = df.select("*", F.lit(1).alias(n))
    return df.select("*", F.lit("again").alias("text") if "text" in df.columns else F.lit("again").alias("html"))


def same(a, b):
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert key(a.collect()) == key(b.collect())


def test_extra_columns_change_nothing(spark):
    import public_tokenizers

    from spoolwave.llm import bpe_trie, embed_dedup, line_crf, secret_scan, simhash, source_mix, suffix_dedup, warc, weak_rules, wrapper

    rng = random.Random(20)
    rows = [(i, words(rng, 60) + (" token=abcdef123" if i % 3 else "###"), f"s{i % 3}") for i in range(24)] + [(None, None, None), (3, "", "s1")]
    d = docs(spark, rows).cache()
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(24)], "doc_id bigint, quality int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for op in (suffix_dedup.dedup, secret_scan.scan, simhash.near_duplicates, source_mix.mix, weak_rules.judge, lambda x: line_crf.classify(x, labels), lambda x: bpe_trie.digests(x, path)):
        same(op(clash(d)), op(d))
    for stage in (simhash.drop_near_duplicates, secret_scan.redact, source_mix.mixed_documents):
        out = stage(clash(d))
        assert out.columns == clash(d).columns
        same(out.toDF(*[f"c{i}" for i in range(len(out.columns))]).select(*[f"c{i}" for i in range(5)]), stage(d))
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>Page {i}</p>") for i in range(4)], PAGE)
    same(wrapper.extract(clash(pages)), wrapper.extract(pages))
    same(warc.round_trip(clash(pages)), warc.round_trip(pages))
    v = spark.createDataFrame([(i, [1.0, float(i % 2)], 0) for i in range(6)], VEC)
    same(embed_dedup.near_duplicates(clash(v.withColumn("text", F.lit("x")))), embed_dedup.near_duplicates(v))
