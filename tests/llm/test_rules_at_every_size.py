"""One rule at every size: pages of a host, rows of one key, sources of one text, lines of a document."""

import math
import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGE = "page_id bigint, url string, html string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC).repartition(parts)


# 5: hosts


def page(i):
    story = "".join(f"<p>Sentence {i} {k} of the story, and some more words.</p>" for k in range(1 + i % 3))
    return f"<body><div><p>Fixed site line</p></div><div><p>Tag {i}</p>{story}</div><div><p>All rights with us</p></div></body>"


def texts(spark, htmls):
    from spoolwave.llm.wrapper import extract

    rows = [(i, "http://one.example/", h) for i, h in enumerate(htmls)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, PAGE)).collect()}
    out = {}
    for i, h in enumerate(htmls):
        assert out.setdefault(h, got[i]) == got[i]
    return out


@pytest.mark.parametrize("distinct", [1, 2, 3, 9])
def test_op5_size_and_copies_change_nothing(spark, distinct):
    pages = [page(i) for i in range(distinct)]
    want = texts(spark, pages)
    for rows in (400, 401, 1203):
        copies = pages + [pages[0]] * (rows - distinct)
        assert texts(spark, copies) == want
    random.Random(1).shuffle(pages)
    assert texts(spark, pages) == want


def test_op5_parts_of_a_host_change_nothing(spark, monkeypatch):
    from spoolwave.llm import wrapper

    pages = [page(i) for i in range(40)]
    want = texts(spark, pages)
    for group in (1, 7):
        monkeypatch.setattr(wrapper, "GROUP", group)
        assert texts(spark, pages + pages[:5] * 30) == want


def test_op5_reference_is_the_middle_page(spark):
    from spoolwave.llm import wrapper

    htmls = [page(i) + "x" * (i * i % 17) for i in range(25)]
    rows = [(f"h{k}", h) for k in range(2) for h in htmls[: 25 - k] + htmls[:3] * (5 * k)]
    own = spark.createDataFrame(rows, "host string, html string").withColumn("chars", F.length("html")).withColumn("digest", F.xxhash64("html"))
    for r in wrapper.references(own).collect():
        mine = [h for k, h in rows if k == r._host]
        assert r._digest == wrapper._signed(wrapper.middle(mine)) and r._distinct == len(set(mine)) and r._parts == 1


# 4: mixing


def test_op4_one_text_in_two_sources(spark):
    from spoolwave.llm.source_mix import mix, mixed_documents

    rows = [(1, "a b c d e f g h", "s1"), (1, "a b c d e f g h", "s2")] + [(i, "w " * 30, f"s{1 + i % 2}") for i in range(2, 22)]
    taken = {}
    for r in mix(docs(spark, rows), keep=("source",)).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    got = {}
    for r in mixed_documents(docs(spark, rows)).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == taken
    again = sorted(map(tuple, mixed_documents(docs(spark, rows, 7)).collect()))
    assert again == sorted(map(tuple, mixed_documents(docs(spark, rows, 2)).collect()))


def test_op4_rows_of_one_key_are_dealt(spark):
    from spoolwave.llm.source_mix import mix

    rows = spark.range(30000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source")).unionByName(
        spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("four five").alias("text"), F.lit("t").alias("source"))
    )
    got = mix(rows.repartition(6), keep=("source",)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert {(r.source, r.n) for r in got} == {("s", 30000), ("t", 3000)} and all(r.taken == round(r.target) for r in got)
    plan = mix(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_s" not in plan.split("Window")[0] and "_share" in plan


# 3: lines


def plain_features(text):
    """The features as they are stated, a line at a time."""
    out, before, seen = [], set(), set()
    for line in text.split("\n"):
        b = line.encode()
        w = b.split()
        if not w:
            continue
        n, body = len(w), sum(map(len, w))
        triples = [tuple(w[i : i + 3]) for i in range(n - 2)]
        own = set(triples)
        share = lambda chars, by: sum(c in chars for c in b) / by
        out.append(
            (
                [
                    min(math.log(n + 1) / 5, 2), min(share(b"#*$%&|<>", n), 2), share(bytes(range(65, 91)), body), min(share(b"!", n), 1), min(share(b"|", n), 1), share(b"0123456789", body), float(b in before),
                    1 - len(set(w)) / n, 1 - len(own) / len(triples) if triples else 0.0, len(own & seen) / len(own) if own else 0.0, min(body / n / 10, 3), float(chr(w[-1][-1]) in ".!?:;\"')"), float(n < 4), min(share(b".,;:!?\"'()-", n), 2), 1.0,
                ],
                body,
            )
        )
        before.add(b)
        seen |= own
    return out


def plain_score(model, text):
    rows = plain_features(text)
    if not rows:
        return 0.0
    none = [0.0] * len(rows[0][0])
    x = [f for f, _ in rows]
    wide = [x[i] + (x[i - 1] if i else none) + (x[i + 1] if i + 1 < len(x) else none) for i in range(len(x))]
    potential = [[sum(a * model.weights[j][s] for j, a in enumerate(v)) for s in (0, 1)] for v in wide]
    good, total = [0.0] * len(x), 0.0
    for states in product((0, 1), repeat=len(x)):
        p = math.exp(sum(potential[i][s] for i, s in enumerate(states)) + sum(model.trans[a][b] for a, b in zip(states, states[1:])))
        total += p
        for i, s in enumerate(states):
            good[i] += p * s
    share = sum(g / total * size for g, (_, size) in zip(good, rows)) / sum(size for _, size in rows)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(model.slope * math.log(share / (1 - share)) + model.shift)))


def corpus(rng, n):
    clean = lambda: " ".join(rng.choice(("river", "stone", "walks", "under", "green", "Über")) for _ in range(rng.randint(3, 9))) + "."
    junk = lambda: "BUY | NOW !!! ### " + " ".join(rng.choice("ABC") * 3 for _ in range(rng.randint(1, 6)))
    out = []
    for i in range(n):
        lines = [clean() for _ in range(rng.randint(1, 6))] if i % 2 else [junk() for _ in range(rng.randint(1, 6))]
        out.append(("\n".join(lines), i % 2))
    return out


def test_op3_scores_equal_brute_force():
    from spoolwave.llm import line_crf as c

    rng = random.Random(4)
    rows = corpus(rng, 60)
    model = c.fit([c.line_features(t) for t, _ in rows], np.array([y for _, y in rows]), rounds=80)
    odd = ["", " \n\t\n", "one", "a b c a b c\na b c\na b c", "12 34!\n\n| | |\nEnd of \"it\")", "ÉÀ é\x0b x\r\ny"]
    texts = [t for t, _ in rows[:20]] + odd
    assert np.allclose(c.score_texts(model, texts), [plain_score(model, t) for t in texts], atol=1e-9)


def test_op3_lines_are_latent():
    """Documents of a good and a bad half, labelled bad: their lines get both states, and the chain decides what stands alone."""
    from spoolwave.llm import line_crf as c

    rng = random.Random(7)
    rows = corpus(rng, 120)
    halves = [(f"{rows[2 * k + 1][0]}\n{rows[2 * k + 1][0]}\n{rows[2 * k][0]}\n{rows[2 * k][0]}\n{rows[2 * k][0]}", 0) for k in range(40)]
    parts, labels = [c.line_features(t) for t, _ in rows + halves], np.array([y for _, y in rows + halves])
    model = c.fit(parts, labels)
    both = 0
    for text, _ in halves:
        p = c.line_states(model, text)
        both += bool((p > 0.5).any() and (p < 0.5).any())
    assert both >= 36
    plain = c.Model(model.weights, np.zeros((2, 2)), model.slope, model.shift)
    texts = [t for t, _ in rows + halves]
    one, two = (np.concatenate([c.line_states(m, t) for t in texts]) > 0.5 for m in (model, plain))
    assert model.trans[0, 0] > model.trans[0, 1] and (one != two).any()
    score = c.score_texts(model, texts)
    assert np.mean((score >= c.THRESHOLD) == (labels == 1)) > 0.95


def test_op3_constraints_hold():
    from spoolwave.llm import line_crf as c

    rng = np.random.default_rng(2)
    n = np.array([3, 1, 6, 2])
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    scores, trans, labels = rng.normal(size=(12, 2)), rng.normal(size=(2, 2)), np.array([1, 0, 0, 1])
    weight = rng.random(12)
    weight /= np.repeat(np.add.reduceat(weight, starts), n)
    p, _ = c.constrained(scores, trans, n, starts, weight, labels, halvings=40)
    share, free = (np.add.reduceat(q[:, 1] * weight, starts) for q in (p, c.marginals(scores, trans, n)[0]))
    for s, f, y in zip(share, free, labels):
        bound, ok = (c.GOOD_SHARE, f >= c.GOOD_SHARE) if y else (c.BAD_SHARE, f <= c.BAD_SHARE)
        assert abs(s - (f if ok else bound)) < 1e-6


def test_op3_sample_is_bounded_in_lines(spark, monkeypatch):
    from spoolwave.llm import line_crf as c

    rows = [(i, "\n".join(["good words here."] * 50 if i % 2 else ["### !!!"] * 50), "s") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(c, "fit", lambda parts, y: seen.append(len(parts)))
    c.train(docs(spark, rows), labels, lines=1000)
    c.train(docs(spark, rows), labels, sample=7)
    c.train(docs(spark, rows), labels)
    assert seen == [20, 7, sum(not c.held_out(i) for i in range(100))]


def test_quality_stage_with_clashing_names(spark):
    from spoolwave.llm.line_crf import keep_good

    rng = random.Random(9)
    rows = [(i, t, "s") for i, (t, _) in enumerate(corpus(rng, 80))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int")
    d = docs(spark, rows)
    wide = d.select("*", F.lit("x").alias("text"), F.lit(1).alias("TEXT"), F.lit(2).alias("doc_id"), F.lit(3).alias("score"))
    out = keep_good(wide, labels)
    assert out.columns == wide.columns
    assert sorted(r[0] for r in out.toDF(*[f"c{i}" for i in range(9)]).collect()) == sorted(r.doc_id for r in keep_good(d, labels).collect())


# 7: table entries


def test_op7_large_entries_are_looked_up_around_their_members(spark):
    from spoolwave.llm.simhash import near_pairs

    rng = random.Random(5)
    high = 0x1234567 << 32
    fps = {high | rng.getrandbits(32) for _ in range(1500)} | {(rng.getrandbits(31) << 32) | 77 for _ in range(1500)}
    fps |= {f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in list(fps)[:200]} | {f ^ 1 for f in list(fps)[:100]}
    own = sorted(fps)
    bits = np.array(own, np.uint64)
    want = {(own[i], own[j]) for i in range(len(own)) for j in (np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= 2) + i + 1).tolist()}
    df = spark.createDataFrame([(f,) for f in own], "fp bigint").repartition(4)
    for entry in (50, 10_000):
        got = [tuple(r) for r in near_pairs(df, entry=entry).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_op8_pages_of_one_payload_are_dealt(spark):
    from spoolwave.llm import warc

    html = "<p>" + "same page " * 30 + "</p>"
    rows = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), F.col("id")).alias("url"), F.lit(html).alias("html"))
    got = warc.as_records(rows).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r.record_type, r.refers_to, r["count"]) for r in got) == [("response", None, 1), ("revisit", 0, 19999)]
    keys = rows.select(F.pmod(F.xxhash64("page_id", "url"), F.lit(warc.SHARES)).alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]
    assert keys < 2 * 20000 / warc.SHARES


def test_op10_vectors_of_one_value(spark):
    from spoolwave.llm.embed_dedup import near_duplicates

    rows = [(i, [1.0, 0.0, 0.0], 0) for i in range(3000)] + [(i, [0.0, 1.0, float(i)], 0) for i in range(5000, 5005)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)).collect()
    one = [r for r in got if r.vec_id < 3000]
    assert {(r.n_links, r.component_id, r.kept) for r in one} == {(2999, 0, True), (2999, 0, False)} and sum(r.kept for r in one) == 1


# 2: linked parts


def test_op2_names_the_parts_it_links(spark):
    from spoolwave.llm import secret_scan as s

    rng = random.Random(8)
    pad = lambda n: " ".join("filler" for _ in range(n // 7))
    key, user, host = "auth: Zx9" + "q" * 12, "login: rosa", "https://api.example.org/v1"
    access = "AKIA" + "Q" * 16
    rows = [
        (1, f"{user} {pad(100)} {key} {host}"),  # all three
        (2, f"{user} {pad(600)} {key}"),  # too far apart
        (3, f"{key} {host}"),  # no identifier: nothing
        (4, f"{access} {pad(480)} {key}"),  # inside the scope, in the next stretch
        (5, f"{pad(505)} {user}\n{key}\n{key.replace('q', 'r')}"),  # over the end of a stretch, two secrets
        (6, None), (7, ""), (8, user),
    ]
    rows += [(20 + i, " ".join(rng.choice((user, key, host, access, pad(rng.randint(0, 400)))) for _ in range(12))) for i in range(15)]
    d = docs(spark, [(i, t, "s") for i, t in rows])
    got = {}
    for r in s.links(d).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.start, r.end, r.with_kind, r.with_start, r.with_end, r.apart))
    want = {}
    for r in s.scan(d).collect():
        parts = [(k, int(a), int(b)) for k, a, b in (p.split(":") for p in r.spans.split(",") if p)]
        role = lambda p: "identifier" if p[0] in ("access", "pair_id") else "endpoint" if p[0] == "pair_endpoint" else "secret"
        pairs = {(*p, *q, abs(p[1] - q[1])) for p in parts for q in parts if abs(p[1] - q[1]) <= s.SCOPE and ((role(p) == "identifier" and role(q) == "secret") or (role(p) == "endpoint" and role(q) != "endpoint"))}
        if pairs:
            want[r.doc_id] = pairs
    assert got == want and {1, 4, 5} <= set(got) and not {2, 3, 6, 7, 8} & set(got)
    assert len(got[1]) == 3 and len(got[5]) == 2 and s.links(docs(spark, [(1, "x", "s")])).count() == 0


# 1: shards


def test_op1_small_merges_have_shards(spark, monkeypatch):
    from spoolwave.llm import suffix_dedup as s

    seen, merge = [], s.merge_transforms
    monkeypatch.setattr(s, "merge_transforms", lambda shards, *a, **k: seen.append(len(shards)) or merge(shards, *a, **k))
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    pieces = [" ".join(f"x{rng.randrange(900)}" for _ in range(20)) + passage[rng.randrange(100) :] for _ in range(30)]
    text = [p.encode() for p in pieces]
    least, n = s.window_docs(text, np.arange(30)[::-1].copy())
    first = {}
    for k, t in enumerate(text):
        for at in range(len(t) - 49):
            first[t[at : at + 50]] = min(first.get(t[at : at + 50], 99), 29 - k)
    assert seen == [4] and n.tolist() == [len(t) - 49 for t in text]
    assert least.tolist() == [first[t[at : at + 50]] for t in text for at in range(len(t) - 49)]


def test_op1_merges_only_what_may_be_equal(monkeypatch):
    """Pieces that share a 20-byte string but no window of 50 stay out of the merge; of others only the common span goes in, once."""
    import pyarrow as pa

    from spoolwave.llm import suffix_dedup as s

    sizes, merge = [], s.merge_transforms
    monkeypatch.setattr(s, "merge_transforms", lambda shards, *a, **k: sizes.append(sum(map(len, shards))) or merge(shards, *a, **k))
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(9))
    phrase, passage = "the very same phrase of 40 bytes in all.", " ".join(word() for _ in range(9))[:70]
    text = [f"{word()} {word()} {phrase} {word()} {word()}".encode() for _ in range(60)]
    alike = [f"{word()} {passage} {word()}".encode() for _ in range(20)]
    pieces = lambda some: [t[:114] for t in some]
    value = s._pack(
        key=np.repeat(np.array([5, 9], np.uint64), [60, 20]), v=np.repeat(np.array([5, 9], np.uint64), [60, 20]), hot=np.zeros(80, np.uint8), run=np.array([len(p) - 49 for p in pieces(text + alike)], np.uint16),
        doc=np.arange(80)[::-1].copy(), text=np.frombuffer(b"".join(pieces(text + alike)), np.uint8),
    )
    out = s._unpack(s._merge(s._rows(0, [(0, value)])).column("value")[0].as_py())
    got = np.split(np.repeat(out["doc"], out["length"]), np.cumsum([len(p) - 49 for p in pieces(text + alike)])[:-1])
    first = {}
    for k, t in enumerate(pieces(text + alike)):
        for at in range(len(t) - 49):
            first[t[at : at + 50]] = min(first.get(t[at : at + 50], 99), 79 - k)
    assert [g.tolist() for g in got] == [[first[t[at : at + 50]] for at in range(len(t) - 49)] for t in pieces(text + alike)]
    assert 0 < sum(sizes) < 1600  # 20 spans of about 74 bytes at most; the pieces are over 7,000
