"""Operators on tiny inputs with exact values, and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spoolwave.functions import numeric, text
from spoolwave.operators import align, catalog, edges, integrity, pairing, sections, signal, units
from spoolwave.plans import overlay
from spoolwave.plans.tables import with_prefix_sum


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


def value(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_envelope_equals_brute_force(spark):
    rng = random.Random(1)
    data = [[rng.gauss(0, 1) if rng.random() > 0.02 else float("nan") for _ in range(3)] for _ in range(1000)]
    s = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "sample bigint, values array<double>")
    got = {(r.channel, r.column): (r.lo, r.hi) for r in signal.envelope(s, 123, 876, 33).collect()}
    want = {}
    for i in range(123, 876):
        for c, v in enumerate(data[i]):
            if not math.isnan(v):
                k = (c, (i - 123) * 33 // 753)
                lo, hi = want.get(k, (v, v))
                want[k] = (min(lo, v), max(hi, v))
    assert got == want
    assert signal.envelope(s, 5, 5, 10).count() == 0
    assert rows(signal.envelope(s.where("sample < 3"), 0, 3, 100), "channel", "column")[:3] == [(0, 0), (0, 1), (0, 2)]


def test_resample_fixture(spark):
    lanes = spark.createDataFrame([(3, c, float(c), float(c + 1)) for c in range(4)], "channel int, column bigint, lo double, hi double")
    cut = lambda start, span, n: rows(signal.resample(lanes, 4, 0, 8, 1.0, start, span, n), "column", "lo", "hi")
    assert cut(2.0, 4.0, 2) == [(0, 1.0, 2.0), (1, 2.0, 3.0)]
    assert cut(1.0, 6.0, 2) == [(0, 0.0, 2.0), (1, 2.0, 4.0)]
    assert cut(10.0, 2.0, 2) == []


def test_windows_and_peak(spark):
    assert value(spark, *signal.fetch_range(F.lit(5.3), F.lit(1.0))) == (4.0, 3.0)
    assert value(spark, *signal.fetch_range(F.lit(0.2), F.lit(1.0))) == (0.0, 3.0)
    assert value(spark, *signal.sample_range(F.lit(10.0), F.lit(-1.0), F.lit(0.01), F.lit(100))) == (0, 1)
    lanes = spark.createDataFrame([(0, -3.0, 2.0), (0, float("nan"), 9.0), (0, 1.0, float("inf"))], "c int, lo double, hi double")
    assert signal.peak(lanes).first().peak == 3.0 and signal.peak(lanes.where("false")).first().peak == 0.0


def test_storage_choice(spark):
    data = [("a", 2.0, 0.0, True, "int16"), ("a", 2.0, 0.0, True, "int16"), ("b", 2.0, 0.0, True, "int16"), ("b", 4.0, 0.0, True, "int16"), ("c", 2.0, 1.0, True, "int16"), ("d", 2.0, 0.0, False, "int16"), ("d", 4.0, 0.0, False, "int16"), ("e", 1.0, 0.0, True, "float32")]
    df = spark.createDataFrame(data, "rec string, gain double, off double, el boolean, st string")
    got = dict(rows(signal.storage_choice(df, "rec", "gain", "off", F.col("el"), F.col("st")), "rec", "storage"))
    assert got == {"a": "int16_folded", "b": "int16_per_channel", "c": "float32", "d": "float32", "e": "float32"}


def test_transitions_fixture(spark):
    def word(t):
        return ((t // 10) % 2 << 6) | (1 if t in (3, 4, 50) else 0) | 1 << 9

    df = spark.createDataFrame([("x", t, word(t)) for t in range(60)], "k string, t bigint, w int")
    got = rows(edges.transitions(df, "k", "t", "w"), "bit", "t", "rising")
    assert got == [(0, 3, True), (0, 5, False), (0, 50, True), (0, 51, False), (6, 10, True), (6, 20, False), (6, 30, True), (6, 40, False), (6, 50, True)]
    assert rows(edges.periods(edges.transitions(df, "k", "t", "w"), ["k", "bit"], "t", "rising", F.lit(60)), "bit", "onset", "offset") == [(0, 3, 5), (0, 50, 51), (6, 10, 20), (6, 30, 40), (6, 50, 60)]
    assert rows(edges.square_edges(df, "k", "t", F.expr("getbit(w, 6) = 1"), 4), "t") == [(10,), (30,), (50,)]


@pytest.mark.parametrize("seed", range(3))
def test_high_periods_state_machine(spark, seed):
    rng = random.Random(seed)
    data = [(k, i, i * 10 + rng.randint(0, 9), rng.random() < 0.5) for k in range(4) for i in range(50)]
    df = spark.createDataFrame(data, "k int, i int, t int, up boolean")
    want = []
    for k in range(4):
        high = None
        for _, _, t, up in [d for d in data if d[0] == k]:
            if up and high is None:
                high = t
            elif not up and high is not None:
                want.append((k, high, t))
                high = None
        if high is not None:
            want.append((k, high, 480))
    assert rows(edges.high_periods(df, ["k"], ["i"], "t", "up", F.lit(480)), "k", "onset", "offset") == sorted(want)
    late = rows(edges.high_periods(df, ["k"], ["i"], "t", "up", F.lit(0), clamp=True), "k", "onset", "offset")
    assert all(b >= a for _, a, b in late)
    assert len(rows(edges.high_periods(df, ["k"], ["i"], "t", "up"), "k", "onset", "offset")) == len(want)


def test_gap_sections_fixture(spark):
    df = spark.createDataFrame([("f", k, t, 512) for k, t in enumerate((1000000, 1512000, 3024000))], "f string, k int, us bigint, n int")
    s = sections.gap_sections(df, "f", "k", "us", F.col("n"), F.col("n") * 1000, 200)
    assert rows(s, "section", "first", "last", "start", "samples") == [(0, 0, 1, 1000000, 1024), (1, 2, 2, 3024000, 512)]
    assert sections.measured_rate(s, df, "f", "k", "us", F.col("n")).first().rate == 1000.0


def test_parts_and_epochs(spark):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate((0, 33, 66, 200, 233, 100))], "f string, i int, ts bigint")
    assert rows(sections.parts(df, "f", "i", "ts", 66), "part", "start", "samples") == [(0, 0, 3), (1, 200, 3)]
    p = spark.createDataFrame([("f", 0, 30000, 100), ("f", 1, 60000, 100), ("f", 2, 300, 100)], "f string, i int, s bigint, n bigint")
    assert rows(sections.part_epochs(p, "f", ["i"], F.col("s"), F.col("n"), 30000), "i", "epoch") == [(0, 0), (1, 0), (2, 1)]
    k = spark.createDataFrame([("f", 0, 90000, False), ("f", 1, 95000, False), ("f", 2, 100, False), ("f", 3, 200, False), ("f", 4, 90, True), ("f", 5, 120, False)], "f string, i bigint, t bigint, again boolean")
    assert rows(sections.clock_epochs(k, "f", "i", "t", 30000, "again"), "i", "epoch") == [(0, 0), (1, 0), (2, 1), (3, 1), (5, 2)]


def test_rates_and_order(spark):
    data = [("even", float(t)) for t in range(10)] + [("odd", float(t)) for t in (0, 1, 3)] + [("two", float(t)) for t in (0, 1)]
    df = spark.createDataFrame(data, "k string, t double")
    assert dict(rows(sections.regular_rate(df, "k", "t"), "k", "rate")) == {"even": 1.0, "odd": None, "two": None}
    d = spark.createDataFrame([("a", 0, 5), ("a", 1, 4), ("a", 2, 6), ("b", 0, 1)], "k string, i int, t int")
    assert rows(sections.out_of_order(d, "k", "i", "t"), "k", "backwards") == [("a", 1), ("b", 0)]
    assert rows(sections.continuity(d, "k", "t"), "k", "missing") == [("a", 0), ("b", 0)]
    c = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyyx")], "k string, i int, v string")
    assert [r[1] for r in rows(sections.consecutive_distinct(c, "k", ["i"], "v"), "i", "v")] == ["x", "y", "x"]


def test_prefix_sum(spark):
    rng = random.Random(2)
    data = [(rng.randrange(10**6) * 7 + i % 7, rng.randrange(5)) for i in range(300)]
    data = list({a: (a, b) for a, b in data}.values())
    df = spark.createDataFrame(data, "o bigint, v int")
    got = dict(rows(with_prefix_sum(df, "o", F.col("v"), "before", span=50000), "o", "before"))
    total, want = 0, {}
    for o, v in sorted(data):
        want[o], total = total, total + v
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_nearest_brute_force(spark, seed):
    rng = random.Random(seed)
    left = [(k, rng.randrange(300)) for k in range(3) for _ in range(25)]
    right = [(k, rng.randrange(300)) for k in range(2) for _ in range(12)] + [(0, 50), (0, 60)]
    left.append((0, 55))
    a, b = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, t int")
    want = sorted((k, t, min((r for q, r in right if q == k), key=lambda r: (abs(r - t), r))) for k, t in left if k < 2)
    assert rows(align.nearest(a, b, "k", "t"), "k", "t", "near") == want
    assert rows(align.nearest(a, b, "k", "t", 5), "k", "t", "near") == [w for w in want if abs(w[1] - w[2]) <= 5]


def test_clock_fit_fixture(spark):
    pairs = [("a", t / 2, 1.00001 * (t / 2) - 0.002) for t in range(1, 21)] + [("b", 1.0, 1.0), ("c", 2.0, 1.0), ("c", 2.0, 3.0)]
    f = align.clock_fit(spark.createDataFrame(pairs, "k string, x double, y double"), "k", "x", "y").collect()
    assert [r.k for r in f] == ["a"] and abs(f[0].scale - 1.00001) < 1e-9 and abs(f[0].offset + 0.002) < 1e-9 and f[0].edges == 20 and f[0].residual < 1e-9


def test_ranges_and_segments(spark):
    rng = random.Random(3)
    pts = [(k, i, rng.randrange(100)) for k in range(3) for i in range(20)]
    rngs = [(k, 100 * k + j, s) for k in range(2) for j, s in enumerate(sorted(rng.sample(range(100), 5)))]
    p, r = spark.createDataFrame(pts, "k int, i int, t int"), spark.createDataFrame(rngs, "k int, rid int, s int")
    want = sorted((k, i, max((s, rid) for q, rid, s in rngs if q == k and s <= t)[1]) for k, i, t in pts if any(q == k and s <= t for q, _, s in rngs))
    assert rows(align.range_lookup(p, r, "k", "t", "s", ["rid"]), "k", "i", "rid") == want
    segs = [(k, s, s + rng.randrange(15)) for k in range(2) for s in rng.sample(range(100), 6)]
    g = spark.createDataFrame(segs, "k int, a int, b int")
    got = rows(align.inside_segments(p, g, "k", "t", "a", "b"), "k", "i", "inside")
    assert got == sorted((k, i, any(q == k and a <= t <= b for q, a, b in segs)) for k, i, t in pts)


def test_units(spark):
    s = [("eNe1", 0, 0.1, 1, 0, [0.0, 1.0, 2.0, 3.0]), ("eNe1", 1, 0.2, 2, 1, [4.0, 5.0, 6.0, 7.0]), ("eNe1", 2, 0.3, 1, 1, [8.0, 9.0, 10.0, 11.0]), ("eNe1", 3, 0.4, 3, 2, [12.0, 13.0, 14.0, 15.0])]
    df = spark.createDataFrame(s, "store string, idx bigint, t double, channel int, sort_code int, waveform array<float>")
    assert rows(units.units(df), "channel", "sort_code", "unit") == [(1, 1, 0), (2, 1, 1), (3, 2, 2)]
    m = {(r.channel, r.sort_code): r.mean for r in units.waveform_means(df.where("sort_code <> 0"), ["channel", "sort_code"], "waveform").collect()}
    assert m[1, 1] == [8.0, 9.0, 10.0, 11.0]
    assert {r.channel: r.codes for r in units.channel_summary(df, ["channel"], F.col("sort_code")).collect()} == {1: [1], 2: [1], 3: [2]}
    assert rows(units.uniform_length(df, ["store"], "waveform"), "uniform") == [(True,)]


def test_pairing_fixture(spark):
    on = spark.createDataFrame([("a", 0.5), ("a", 1.2), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("c", 1.0)], "k string, t double")
    off = spark.createDataFrame([("a", 1.5 - 0.9), ("b", 1.5), ("c", 2.0)], "k string, t double")
    got = rows(pairing.pair_offsets(on, off, "k", "t", F.lit(10.0)), "k", "pos", "offset")
    assert got == [("a", 1, 0.6), ("a", 2, 10.0), ("b", 1, None), ("b", 2, None), ("b", 3, None), ("c", 1, 2.0)]
    r = spark.createDataFrame([("s", 0, 1.0, 1, 10.0), ("s", 1, 1.0, 2, 20.0), ("s", 2, 2.0, 2, 5.0), ("s", 3, 1.0, 9, 7.0), ("s", 4, 1.0, 2, 8.0)], "k string, i int, t double, c int, v double")
    got = [(x.row, x.at, [None if math.isnan(v) else v for v in x["values"]]) for x in pairing.scalar_rows(r, "k", ["i"], "t", "c", "v", 2).orderBy("row").collect()]
    assert got == [(1, 1.0, [10.0, 20.0]), (2, 2.0, [None, 5.0]), (3, 1.0, [None, 8.0])]


def test_overlay_and_checks(spark):
    spec = spark.createDataFrame([("*", True, "series", None), ("Skip", False, None, None), ("EMG1", None, "table", "EMG"), ("Gone", None, None, None)], "key string, include boolean, type string, out_name string")
    rec = spark.createDataFrame([("EMG1",), ("Temp",), ("Skip",), ("EMG",)], "name string")
    plan, issues = overlay.resolve(rec, spec)
    assert rows(plan, "name", "type", "out_name") == [("EMG", "series", "EMG"), ("EMG1", "table", "EMG"), ("Temp", "series", "Temp")]
    assert rows(issues, "level", "target_name") == [("error", "EMG"), ("warning", "Gone")]
    t = spark.createDataFrame([("59", "0.96", "ok"), ("63", "-1.00", "n/a")], "time string, r string, note string")
    assert dict(rows(catalog.numeric_columns(t, ["time", "r", "note"]), "name", "numeric")) == {"time": True, "r": True, "note": False}
    assert set(r.numeric for r in catalog.numeric_columns(t.where("false"), ["time"]).collect()) == {False}


def test_digests_find_each_change(spark):
    df = spark.createDataFrame([(i // 10, i, i * 7) for i in range(50)], "b int, i int, v int")
    said = F.concat_ws(":", "i", "v")
    d = lambda x: integrity.block_digests(x, ["b"], ["i"], said)
    base = d(df)
    swapped = df.withColumn("v", F.when(F.col("i") == 12, 91).when(F.col("i") == 13, 84).otherwise(F.col("v")))
    flipped = df.withColumn("v", F.when(F.col("i") == 33, F.col("v").bitwiseXOR(F.lit(1))).otherwise(F.col("v")))
    state = lambda x: [r.b for r in integrity.compare(base, d(x), ["b"]).where("state <> 'ok'").collect()]
    assert state(df) == [] and state(swapped) == [1] and state(flipped) == [3] and state(df.where("b <> 4")) == [4]
    assert integrity.overall_digest(base, [], "b").first().digest != integrity.overall_digest(d(flipped), [], "b").first().digest
    nan = F.lit(float("nan"))
    assert value(spark, integrity.close(nan, nan), integrity.close(F.lit(1.0), F.lit(1.000001)), integrity.close(F.lit(1.0), nan)) == (True, True, False)


def test_numeric_functions(spark):
    assert value(spark, numeric.unpack_high(F.lit(-65537)), numeric.unpack_low(F.lit(-65537)), numeric.unpack_low(F.lit(0x18000)), numeric.offset_binary(F.lit(0))) == (-2, -1, -32768, -32768)
    assert value(spark, numeric.stim_word(F.lit(0x105)), numeric.stim_word(F.lit(7)), numeric.bit(F.lit(8), 3)) == (-5, 7, 1)
    assert value(spark, numeric.nice_step(F.lit(10.0), 5), numeric.nice_step(F.lit(7.0), 5), numeric.nice_step(F.lit(0.0), 5)) == (2.0, 1.0, 1.0)
    assert value(spark, *numeric.si_scale(F.lit(0.0025))) == (2.5, "m") and value(spark, *numeric.si_scale(F.lit(0.0))) == (0.0, "")
    assert value(spark, *numeric.linear_scale(F.lit(5), F.lit(-5), F.lit(7), F.lit(7))) == (None, None)
    assert value(spark, numeric.impedance_factor(F.lit("R1 (kOhm)")), numeric.impedance_factor(F.lit("R1"))) == (1000.0, 1.0)


def test_text_functions(spark):
    assert value(spark, text.safe_name(F.lit("MET/")), text.safe_name(F.lit("a/b\\c")), text.safe_name(F.lit("//"))) == ("MET", "a_b_c", "unnamed")
    assert value(spark, text.subset(F.lit("0:2,7")), text.subset(F.lit("all"))) == ([0, 1, 2, 7], None)
    assert value(spark, *text.store_file(F.lit("b_x_Wav1_Ch12-3h.sev"))) == ("Wav1", 12, 3) and value(spark, *text.store_file(F.lit("x.sev")))[0] is None
    assert value(spark, text.model(F.lit("RZ2(1)")), text.bank(F.lit(3)), text.bank(F.lit(27)), text.note_label(F.lit(""), F.lit("x"))) == ("RZ2", "C", None, "x")
    assert value(spark, text.clock_seconds(F.lit("12:00:01am")), text.clock_seconds(F.lit("1:02:03pm")), text.clock_seconds(F.lit("13:02:03")), text.clock_seconds(F.lit("x"))) == (1, 46923, 46923, None)
    assert value(spark, text.micros_from_iso(F.lit("1970-01-01T00:00:01.5+05:00")), text.iso_from_micros(F.lit(1500000))) == (1500000, "1970-01-01T00:00:01.500000")
    assert value(spark, text.start_time(F.lit(None).cast("string"), F.lit("Z"), F.lit("2020-01-01T00:00:00")), text.has_zone(F.lit("2020-01-01T00:00:00-05:00"))) == ("2020-01-01T00:00:00Z", True)
    assert value(spark, *text.age(F.lit("P90D"))) == (90, "D") and value(spark, text.hex16(F.lit(255).cast("bigint"))) == "00000000000000ff"
    assert value(spark, text.entries(F.lit("(h)(a:1)(b)")), text.counts(F.lit("1,0,x")), text.number_text(F.lit(2.0))) == (["a:1", "b"], [1, 0, None], "2")


def test_nearest_takes_linear_time_on_one_key(spark):
    import time

    from spoolwave.operators.align import nearest

    took = []
    for n in (50_000, 500_000):
        left = spark.range(n).selectExpr("1 as k", "cast(id * 3 as double) as t")
        right = spark.range(n).selectExpr("1 as k", "cast(id * 3 + 1 as double) as t")
        start = time.time()
        row = nearest(left, right, "k", "t").selectExpr("count(*) as n", "max(abs(near - t)) as far", "sum(near - t) as total").first()
        took.append(time.time() - start)
        assert (row.n, row.far, row.total) == (n, 1.0, float(n))
    assert took[1] < 20 * took[0] + 10
