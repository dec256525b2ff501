"""SimHash near-duplicate groups with multi-index hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolwave.llm.common import checkpoint, map_batches, plain, spread, text_col
from spoolwave.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 13


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle in order, repeats included; fewer words than the width: one shingle of all; none: empty."""
    words = text.encode("utf-8").translate(_LOWER).split()  # bytes split at the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows of a [n, words] table have each bit set, as 64 * words counts.

    Bits become bytes, and eight bytes are added as one number, 255 rows at a time, so none overflows. Works in chunks, so a long
    text needs no more memory.
    """
    total = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i : i + _CHUNK], "<u8")
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        total += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it; 0 without hashes."""
    ones = bit_counts(hashes[:, None])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp bigint): one row per input row. Null text counts as empty; a null id is kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], names=["id", "fp"])

    docs = plain(docs, id_col, text)
    return map_batches(spread(docs.select(F.col(id_col).cast("bigint").alias("id"), text_col(text).alias("text"))), run, "id bigint, fp bigint")


#: Fingerprints of one table entry beyond which its members look up whole balls instead of the entry: as many as such a ball has.
ENTRY = 1 + 64 + 64 * 63 // 2


def near_pairs(fps: DataFrame, radius: int = RADIUS, entry: int = ENTRY) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints at Hamming distance <= radius (at most 2), each once.

    Multi-index hashing over two 32-bit segments: if two fingerprints differ in at most 2 bits, their low segments differ in
    at most one bit, or their high segments are equal. So every fingerprint looks up the Hamming ball of radius 1 around its
    low segment (33 values) and its exact high segment; the whole distance is then verified. An entry that more than `entry`
    fingerprints share would hand each of them all others: its members look up the ball of radius 2 around themselves instead
    (2,081 values), which are their links and nothing else. So candidates grow with the fingerprints, whatever they share.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two segments cover radius 0 to 2")
    low, high = F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32)")
    ball = F.expr("concat(array(0L), transform(sequence(0, 31), i -> shiftleft(1L, i)))")
    tables = fps.select(F.col("fp").alias("b"), F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("v")), F.struct(F.lit(1).alias("seg"), high.alias("v")))).alias("k")).select("b", "k.*")
    large = checkpoint(tables.groupBy("seg", "v").agg(F.count("*").alias("n")).where(F.col("n") > entry).select("seg", "v"))
    near = fps.select("fp", F.explode(ball).alias("mask")).select(F.col("fp").alias("a"), F.lit(0).alias("seg"), F.expr("(fp & 4294967295L) ^ mask").alias("v"))
    same = fps.select(F.col("fp").alias("a"), F.lit(1).alias("seg"), high.alias("v"))
    small = tables.join(large, ["seg", "v"], "left_anti")
    apart = F.expr("bit_count((a ^ b) & 4294967295L)")
    found = near.unionByName(same).join(small, ["seg", "v"]).where((F.expr("bit_count(a ^ b)") <= radius) & ((F.col("seg") == 0) | (apart > 1))).select("a", "b")
    if not large.isEmpty():  # what the large entries held back: whatever lies around their members
        members = tables.join(large, ["seg", "v"], "left_semi").select(F.col("b").alias("fp")).distinct()
        one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
        two = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
        around = members.select(F.col("fp").alias("a"), F.explode(F.expr({0: "array(0L)", 1: one}.get(radius, f"concat({one}, {two})"))).alias("mask"))
        met = around.select("a", F.expr("a ^ mask").alias("b")).join(fps.select(F.col("fp").alias("b")), "b", "left_semi")
        found = found.unionByName(met.select("a", "b"))
        return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.where("a < b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Rows that share a fingerprint are one node, however many they are. A repeated row appears as often as in the input. A
    null doc_id is kept and never names a component unless the component has no other id (then component_id is null).
    Texts without words have fingerprint zero and link like any other. An empty table gives an empty result.
    """
    own = checkpoint(fingerprints(docs))
    nodes = own.groupBy("fp").agg(F.min("id").alias("first"))
    parts = connected_components(near_pairs(nodes.select("fp")))
    labelled = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage on shingles of five words: least Jaccard similarity, and the least share of pairs at that very similarity which the
#: tables are laid out to find (more similar pairs are found more surely).
WIDE = 5
SIMILARITY = 0.8
RECALL = 0.97
#: Bits of a segment beyond the logarithm of the number of texts, so that chance meetings stay a fixed number a text.
SPARE_BITS = 6
#: Words of a long fingerprint at least: what the segments leave over sharpens the distance.
LEAST_WORDS = 24
#: Words that are compared first; only pairs that pass are compared in all.
COARSE_WORDS = 8
#: Bits of the first word that a text's key begins with, for a first look at distances; the rest of the key is a hash of all words,
#: so that texts of one key have, but for a chance of hashes, one long fingerprint.
HEAD_BITS = 48
_HEAD = np.int64((1 << HEAD_BITS) - 1)
#: Pairs of a text that are looked at first, the closest ones.
FIRST = 3
#: Pairs of a text that leave a task of the first look, and pairs of all tasks that go on, the closest ones by their keys. Texts that
#: have more meet a second time.
CLOSE, CLOSE_IN_ALL = 8, 16
#: Texts that meet in one table entry up to which all their pairs are made; a larger entry is first joined as a star.
SMALL = 8
#: A place is the number of the segment's bit that was turned on the way to an entry (0: none), with FREE added where the entry has a
#: 0 there. ANY stands for a text that comes to one entry by several places.
FREE, ANY = 128, 255
#: Entries of the tables behind one task.
ENTRIES = 2_000_000
#: The same where texts come along with their words.
LABELLED_ENTRIES = 1 << 18
_TEXTS = 2048
_SIDE = 4096
_PAIRS = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def layout(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int, int, int, int]:
    """(bits of a segment, segments, radius of a key's head, of the coarse words, of all words) for n texts.

    Two sets of Jaccard similarity s have a cosine of 2s / (1 + s) at least, so a bit of their fingerprints differs with
    probability p = arccos(cosine) / pi. Balls of radius 1 on both sides meet when a segment differs in at most 2 bits; there are
    as many segments as it takes for one of them to meet with the recall asked for. The radii are 3, 2.5 and 2.5 deviations above the mean.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(12, math.ceil(math.log2(max(n, 2))) + SPARE_BITS)
    meets = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    segments = math.ceil(math.log(1 - recall) / math.log(1 - meets))
    radius = lambda size, times: math.ceil(size * p + times * math.sqrt(size * p * (1 - p)))
    return bits, segments, radius(HEAD_BITS, 3), radius(64 * COARSE_WORDS, 2.5), radius(64 * _words(bits, segments), 2.5)


def _words(bits: int, segments: int) -> int:
    return max(LEAST_WORDS, 1 + -(-bits * segments // 64))


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes of the five-word shingles, ascending."""
    return np.unique(shingle_hashes(text, WIDE))


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of 64 * words bits: each word has its own hash function, derived from the given hashes."""
    own = _mix(hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * _STEP)
    return np.packbits(2 * bit_counts(own) > len(own), bitorder="little").view("<u8").astype(np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    """(id, digest, text) with null text empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.md5(text_col()).alias("digest"), text_col().alias("text"))


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """(id, digest, fp, words): the key and all words of each text's long fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [long_fingerprint(shingle_set(t), words) for t in batch.column(2).to_pylist()]
        head = np.array([f[0] for f in found], np.uint64) & np.uint64(_HEAD)
        rest = np.array([xxhash.xxh64_intdigest(f.tobytes()) for f in found], np.uint64) << np.uint64(HEAD_BITS)
        fp = (head | rest).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["id", "digest", "fp", "words"])

    return map_batches(spread(_texts(docs)), run, "id bigint, digest string, fp bigint, words array<bigint>")


def _segments(words: np.ndarray, bits: int, segments: int) -> np.ndarray:
    """Values of the segments of each row of words; the first word is none of them."""
    flat = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, 64 : 64 + bits * segments]
    return flat.reshape(len(words), segments, bits).astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))


def _key(value: np.ndarray, segment: np.ndarray, bits: int) -> np.ndarray:
    """The hashed table key of a segment's value."""
    return _mix((value + (segment.astype(np.uint64) << np.uint64(bits))) * _STEP)


def _entry(table: np.ndarray | np.int64, low: np.ndarray) -> np.ndarray:
    return (table << 32) | low.astype(np.int64)


def _first_entry(x: np.ndarray, y: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Of the entries in which pairs of texts meet the first, given their segments' values: least segment, least common value."""
    apart = x ^ y
    segment = (np.bitwise_count(apart) <= 2).argmax(axis=1)
    own = np.arange(len(x))
    x, apart = x[own, segment], apart[own, segment]
    low = apart & (~apart + np.uint64(1))  # the lowest bit in which they differ; without any both values are x
    two = np.bitwise_count(apart) == 2
    one, other = np.where(two, x ^ low, x), np.where(two, x ^ apart ^ low, x ^ apart)
    key = _key(np.minimum(one, other), segment, bits)
    return _entry((key % np.uint64(tables)).astype(np.int64), key >> np.uint64(32))


def _entries(fps: np.ndarray, words: np.ndarray, bits: int, segments: int, tables: int) -> pa.RecordBatch:
    """Table entries of a block of texts: the ball of radius 1 around each segment, packed by the task that they go to."""
    value = _segments(words, bits, segments)
    mask = np.concatenate(([0], np.uint64(1) << np.arange(bits, dtype=np.uint64))).astype(np.uint64)
    key = _key(value[:, :, None] ^ mask, np.arange(segments)[None, :, None], bits).reshape(-1)
    table = (key % np.uint64(tables)).astype(np.int64)
    order = np.argsort(table, kind="stable")
    low = (key >> np.uint64(32)).astype("<u4")[order]
    owner = np.repeat(fps, segments * (bits + 1))[order]
    turned = (value[:, :, None] & mask) != 0  # a bit that is turned off is 0 in the entry
    place = (np.arange(bits + 1, dtype=np.uint8) + FREE * turned.astype(np.uint8)).reshape(-1)[order]
    used, at = np.unique(table[order], return_index=True)
    stop = [*at[1:].tolist(), len(order)]
    return pa.RecordBatch.from_arrays(
        [pa.array(used), *(pa.array([v[a:b].tobytes() for a, b in zip(at.tolist(), stop)], pa.binary()) for v in (low, owner, place))],
        names=["table", "keys", "fps", "places"],
    )


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, place) of a table's entries in this order, each text once an entry, and the first row and size of every entry;
    without entries of one text, and without those whose texts all turned the same bit (see `_meet`)."""
    key = np.frombuffer(b"".join(t.column("keys").to_pylist()), "<u4")
    fp = np.frombuffer(b"".join(t.column("fps").to_pylist()), "<i8")
    place = np.frombuffer(b"".join(t.column("places").to_pylist()), np.uint8)
    order = np.lexsort((fp, key))
    key, fp, place = key[order], fp[order], place[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
    at = np.flatnonzero(fresh)
    once = np.diff(np.append(at, len(key))) == 1
    key, fp, place = key[fresh], fp[fresh], np.where(once, place[fresh], np.uint8(ANY))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    low, high = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first)
    own = (size > 1) & ((low != high) | (low == 0) | (low == ANY))
    of_use, size = np.repeat(own, size), size[own]
    return key[of_use], fp[of_use], place[of_use], np.cumsum(size) - size, size


def _meet(t: pa.Table, radius: int) -> pa.Table:
    """(kind, a, b): kind 0 a pair within the radius, kind 1 a text b in the entry a, which more than SMALL texts share.

    All pairs of a small entry are made. A larger one gives its stars and its neighbours in order of fingerprint, and itself. Texts
    that come to an entry by the same turned bit have one value and meet at that value too, so an entry of such texts alone is left
    out: most entries of a large group of copies are. Of a larger entry only those texts are given that have a partner for
    which this is the first entry (see `_partners`).
    """
    key, fp, place, first, size = _unpacked(t)
    if not len(key):
        return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    left, right = [], []
    for gap in range(1, SMALL):  # pairs at this distance inside small entries
        own = first[(size > gap) & (size <= SMALL)]
        n = size[(size > gap) & (size <= SMALL)] - gap
        at = np.repeat(own - np.cumsum(n) + n, n) + np.arange(n.sum())
        left.append(at)
        right.append(at + gap)
    big = size > SMALL
    start, n = first[big], size[big] - 1
    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()) + 1
    left += [np.repeat(start, n), at - 1]
    right += [at, at]
    i, j = np.concatenate(left), np.concatenate(right)
    near = np.bitwise_count((fp[i] ^ fp[j]) & _HEAD) <= radius
    pairs = np.unique(np.stack([fp[i[near]], fp[j[near]]], axis=1), axis=0) if near.any() else np.empty((0, 2), np.int64)
    inside = np.repeat(big, size) & _partners(place, first, size)
    entry = _entry(np.int64(t.column("table")[0].as_py()), key[inside])
    kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(entry), np.int32)])
    return pa.table({"kind": kind, "a": np.concatenate([pairs[:, 0], entry]), "b": np.concatenate([pairs[:, 1], fp[inside]])})


def _partners(place: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which texts have a partner in their entry whose first entry with them (see `_first_entry`) it can be.

    Two texts that come by different bits meet in two entries, and in the lesser one the higher of the bits is 0; two of one value
    meet first at that value.
    """
    bit, free = place % FREE, place >= FREE
    highest = np.repeat(np.maximum.reduceat(np.where(free, bit, 0), first), size)  # of the bits that are 0 in the entry
    lowest = np.repeat(np.minimum.reduceat(bit, first), size)
    bare = np.repeat(np.add.reduceat((bit == 0).astype(np.int64), first), size)
    return (highest > bit) | (free & (lowest < bit)) | ((bit == 0) & (bare > 1)) | (place == ANY)


def _can_meet(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The rule of `_partners` for two places of one entry."""
    a, b = (p % FREE).astype(np.int16), (q % FREE).astype(np.int16)
    free = np.maximum(np.where(p >= FREE, a, -1), np.where(q >= FREE, b, -1))
    return np.where(a == b, (a == 0) | (p == ANY), np.maximum(a, b) == free)


def _closest(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs are among the `most` closest of one of their two texts, by their keys, and the texts that have more pairs.

    A pair that is not among them leaves two texts with more pairs, so both of its texts are given.
    """
    apart, tie = np.bitwise_count((a ^ b) & _HEAD), _mix((a ^ b).view(np.uint64))
    text = np.concatenate([a, b])
    order = np.lexsort((np.tile(tie, 2), np.tile(apart, 2), text))
    fresh = np.append(True, np.diff(text[order]) != 0)[: len(text)]
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(text)))
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text)) - np.repeat(first, size)
    return (rank < most).reshape(2, -1).any(axis=0), text[order][first[size > most]]


def _texts_met(t: pa.Table, radius: int, most: int) -> pa.Table:
    """What `_meet` gives, but only the closest pairs of each text, and as kind 1, once a table instead of once an entry, the texts of
    large entries and those that have more pairs."""
    met = _meet(t, radius)
    kind, a, b = (met.column(c).to_numpy() for c in ("kind", "a", "b"))
    pair = kind == 0
    near, crowded = _closest(a[pair], b[pair], most)
    texts = np.unique(np.concatenate([b[~pair], crowded]))
    return pa.table({"kind": np.repeat(np.array([0, 1], np.int32), [near.sum(), len(texts)]), "a": np.concatenate([a[pair][near], np.zeros_like(texts)]), "b": np.concatenate([b[pair][near], texts])})


def _labelled_entries(fps: np.ndarray, labels: np.ndarray, words: np.ndarray, bits: int, segments: int, tables: int) -> pa.RecordBatch:
    """`_entries` with the label and words of each text beside them, once a table."""
    out = _entries(fps, words, bits, segments, tables)
    order = np.argsort(fps)
    mine = [order[np.searchsorted(fps, np.unique(np.frombuffer(x, "<i8")), sorter=order)] for x in out.column("fps").to_pylist()]
    more = [pa.array([v[k].tobytes() for k in mine], pa.binary()) for v in (fps, labels, words)]
    return pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, "texts", "labels", "words"])


def _between_labels(t: pa.Table, radius: int, bits: int, segments: int, tables: int, side: int) -> pa.Table:
    """(kind, a, b, apart): kind 0 a pair within the radius of texts of different labels, out of its first entry (see `_across`);
    kind 1 a text b of the entry a, and in apart the parts that its texts are dealt to.

    Only pairs of two labels are looked at, a block at a time. An entry of more than side * side / 2 of them is dealt over tasks.
    """
    key, fp, place, first, size = _unpacked(t)
    texts, labels = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<i8") for c in ("texts", "labels"))
    words = np.frombuffer(b"".join(t.column("words").to_pylist()), "<u8").reshape(len(texts), -1)
    order = np.argsort(texts)
    if len(key):
        kept = _partners(place, first, size)
        key, fp, place = key[kept], fp[kept], place[kept]
    own = order[np.searchsorted(texts, fp, sorter=order)]
    label = labels[own]
    by_label = np.lexsort((fp, label, key))
    key, fp, place, own, label = key[by_label], fp[by_label], place[by_label], own[by_label], label[by_label]
    # partners of a text are those of its entry behind the last one of its own label
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    run = new | np.append(True, label[1:] != label[:-1])[: len(key)]
    ends = lambda fresh: np.append(np.flatnonzero(fresh)[1:], len(key))[np.cumsum(fresh) - 1]
    after, end = (ends(run), ends(new)) if len(key) else (own, own)
    n = end - after
    entry = np.cumsum(new) - 1
    large = (np.bincount(entry, n) > side * side / 2)[entry] if len(key) else new
    here = _entry(np.int64(t.column("table")[0].as_py()), key)
    members = np.bincount(entry)[entry] if len(key) else n
    left, right, far = [fp[:0]], [fp[:0]], [np.empty(0, np.int32)]
    at = np.flatnonzero((n > 0) & ~large)
    block = (np.cumsum(n[at]) - 1) // _PAIRS
    for rows in np.split(at, np.flatnonzero(np.diff(block)) + 1):
        i = np.repeat(rows, n[rows])
        j = np.arange(len(i)) + np.repeat(after[rows] - np.cumsum(n[rows]) + n[rows], n[rows])
        meet = _can_meet(place[i], place[j])
        i, j = i[meet], j[meet]
        for k in range(0, len(i), _PAIRS):
            p, q = i[k : k + _PAIRS], j[k : k + _PAIRS]
            apart = np.bitwise_count(words[own[p]] ^ words[own[q]]).sum(axis=1, dtype=np.int32)
            near = apart <= radius
            p, q, apart = p[near], q[near], apart[near]
            if len(p):
                x, y = (_segments(words[own[r]], bits, segments) for r in (p, q))
                out = _first_entry(x, y, bits, tables) == here[p]
                left.append(fp[p[out]])
                right.append(fp[q[out]])
                far.append(apart[out])
    a, b = np.concatenate(left), np.concatenate(right)
    kind = np.repeat(np.array([0, 1], np.int32), [len(a), large.sum()])
    tiles = -(-members[large] // side)
    return pa.table({"kind": kind, "a": np.concatenate([np.minimum(a, b), here[large]]), "b": np.concatenate([np.maximum(a, b), fp[large]]), "apart": np.concatenate([*far, tiles]).astype(np.int32)})


def _across(t: pa.Table, radius: int, bits: int, segments: int, tables: int) -> pa.Table:
    """Pairs within the radius between the two sides of a tile whose texts are in different groups so far.

    A pair that meets in several entries comes out of the first of them alone.
    """
    side, fp, label = (t.column(c).to_numpy() for c in ("side", "fp", "label"))
    words = t.column("words").combine_chunks().flatten().to_numpy().reshape(len(fp), -1)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    here, value = t.column("entry")[0].as_py(), _segments(words, bits, segments)
    left, right, far = [], [], []
    for i in x.tolist():
        near = y[(label[y] != label[i]) & (fp[y] != fp[i])]
        apart = np.bitwise_count((words[near] ^ words[i]).view(np.uint64)).sum(axis=1, dtype=np.int32)
        near, apart = near[apart <= radius], apart[apart <= radius]
        first = _first_entry(np.broadcast_to(value[i], (len(near), segments)), value[near], bits, tables) == here
        near, apart = near[first], apart[first]
        left.append(np.full(len(near), fp[i]))
        right.append(fp[near])
        far.append(apart)
    a, b = np.concatenate(left or [fp[:0]]), np.concatenate(right or [fp[:0]])
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": np.concatenate(far or [np.empty(0, np.int32)])})


def _ends(pairs: DataFrame) -> DataFrame:
    """(a, b, apart): each pair from both of its texts."""
    return pairs.select("a", "b", "apart").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))


def _closest_pairs(pairs: DataFrame, most: int, *ties) -> DataFrame:
    """Those pairs (a < b, apart) that are among the `most` closest of one of their texts, as (a, b)."""
    ranked = _ends(pairs).withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("apart", *ties)))
    return ranked.where(F.col("_n") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have the Jaccard similarity."""
    joined = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("_x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("_y")), "b")
    both = F.size(F.array_intersect("_x", "_y"))
    return joined.where(both >= similarity * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, digest, group) of every row: groups of texts linked by five-word shingle sets of Jaccard similarity >= similarity.

    Multi-index hashing over long fingerprints: balls of radius 1 around each segment of both texts meet in a table, the distance
    of the first word is verified, then that of eight and of all words, then the similarity itself. Texts of one long fingerprint are one node.
    Pairs are made of entries that few texts share; entries of large groups of copies are joined as stars at first. Of a text's
    pairs the closest few go on; then only what the groups found so far leave apart is compared, where texts of large entries and
    of more pairs meet again and in tiles, until no entry holds an unseen pair of two groups. So no group is expanded into all its pairs. Texts without words are one node. Empty tables give empty results.
    """
    docs = plain(docs, "doc_id", "text")
    n = docs.count()
    bits, segments, radius, coarse, whole = layout(n, similarity)
    own = checkpoint(_marked(docs, _words(bits, segments)))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "words")
    nodes = checkpoint(own.groupBy("fp").agg(F.min(order).alias("first")))
    tables, close, in_all = max(1, -(-n * segments * (bits + 1) // ENTRIES)), CLOSE, CLOSE_IN_ALL

    def enter(batch: pa.RecordBatch) -> pa.Table:
        fps = batch.column(0).to_numpy()
        words = batch.column(1).flatten().to_numpy().reshape(len(fps), -1)
        return pa.Table.from_batches([_entries(fps[at : at + _TEXTS], words[at : at + _TEXTS], bits, segments, tables) for at in range(0, len(fps), _TEXTS)])

    entries = map_batches(spread(nodes.select("fp", "first.words")), enter, "table bigint, keys binary, fps binary, places binary")
    met = checkpoint(entries.groupBy("table").applyInArrow(lambda t: _texts_met(t, radius, close), "kind int, a bigint, b bigint"))
    some = lambda c: nodes.select(F.col("fp").alias(c), F.slice("first.words", 1, COARSE_WORDS).alias(f"_{c}"))
    long = lambda c: nodes.select(F.col("fp").alias(c), F.col("first.words").alias(f"_{c}"))
    apart = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    # a text's pairs are as many as its entries, or the texts of a large one: only its closest go on, those beyond meet a second time
    head = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(int(_HEAD))))
    seen = checkpoint(met.where("kind = 0").select("a", "b").distinct().withColumn("apart", head))
    crowded = _ends(seen).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > in_all).select(F.col("a").alias("fp"))
    near = _closest_pairs(seen, in_all, F.xxhash64(F.col("a").bitwiseXOR(F.col("b"))))
    pairs = near.join(some("a"), "a").join(some("b"), "b").where(apart <= coarse).select("a", "b")
    pairs = checkpoint(pairs.join(long("a"), "a").join(long("b"), "b").withColumn("apart", apart).where(F.col("apart") <= whole).select("a", "b", "apart"))
    shared = met.where("kind = 1").select(F.col("b").alias("fp")).unionByName(crowded).distinct()
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(shared).distinct()
    wanted = nodes.join(wanted, "fp", "left_semi").select("fp", F.coalesce(F.col("first.id").cast("string"), F.lit("null")).alias("key"), F.col("first.digest").alias("digest"))

    def collect_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["fp", "shingles"])

    texts = _texts(docs).withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("null"))).join(wanted, ["key", "digest"])
    sets = checkpoint(map_batches(texts.select("fp", "text"), collect_shingles, "fp bigint, shingles array<bigint>").dropDuplicates(["fp"]))
    # the closest pairs of each text come first and join most of every group; then the closest pair of each two groups; then all
    # pairs that still lead from group to group
    first = checkpoint(_closest_pairs(pairs, FIRST, "b"))
    links = checkpoint(_similar(first, sets, similarity))
    so_far = connected_components(links)
    label = lambda parts, c: parts.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    of = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    between = lambda found, parts: found.join(label(parts, "a"), "a", "left").join(label(parts, "b"), "b", "left").where(of("a") != of("b"))
    # the texts of large entries and those with more pairs meet a second time, with the labels of the groups found so far
    large = checkpoint(shared.join(nodes.select("fp", "first.words"), "fp").join(label(so_far, "fp"), "fp", "left").select("fp", of("fp").alias("label"), "words"))
    parts_of, side = max(1, -(-large.count() * segments * (bits + 1) // LABELLED_ENTRIES)), _SIDE

    def enter_again(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        return _labelled_entries(fps, labels, batch.column(2).flatten().to_numpy().reshape(len(fps), -1), bits, segments, parts_of)

    entries = map_batches(spread(large), enter_again, "table bigint, keys binary, fps binary, places binary, texts binary, labels binary, words binary")
    again = checkpoint(entries.groupBy("table").applyInArrow(lambda t: _between_labels(t, whole, bits, segments, parts_of, side), "kind int, a bigint, b bigint, apart int"))
    # what is left are entries of more pairs than one task looks at
    dealt = again.where("kind = 1").select(F.col("a").alias("entry"), F.col("b").alias("fp"), F.col("apart").alias("tiles")).join(large, "fp")
    large = checkpoint(dealt.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")))
    # a tile for each two parts of an entry, the first no later than the second
    sides = large.select("entry", "fp", "label", "words", F.col("i"), F.explode(F.expr("sequence(i, tiles - 1)")).alias("j"), F.lit(0).alias("side")).unionByName(
        large.select("entry", "fp", "label", "words", F.explode(F.expr("sequence(0, i)")).alias("i"), F.col("i").alias("j"), F.lit(1).alias("side"))
    )
    more = sides.groupBy("entry", "i", "j").applyInArrow(lambda t: _across(t, whole, bits, segments, parts_of), "a bigint, b bigint, apart int")
    more = more.unionByName(again.where("kind = 0").select("a", "b", "apart"))
    rest = checkpoint(between(pairs.unionByName(more).distinct().join(first, ["a", "b"], "left_anti"), so_far).select("a", "b", "apart", F.least(of("a"), of("b")).alias("x"), F.greatest(of("a"), of("b")).alias("y")))
    second = checkpoint(rest.groupBy("x", "y").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b"))
    links = checkpoint(links.unionByName(_similar(second, sets, similarity)))
    so_far = connected_components(links)
    third = between(rest.select("a", "b").join(second, ["a", "b"], "left_anti"), so_far).select("a", "b")
    parts = connected_components(links.unionByName(_similar(third, sets, similarity)))
    return own.join(parts, own.fp == parts.node, "left").select("id", "digest", F.coalesce("component", "fp").alias("group"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with exactly one row of each group of near-duplicate texts left (see `similar_groups`); columns unchanged.

    The row of the smallest doc_id stays (null last, then by the text's digest); of rows equal in id and text any one. Ids only
    choose: unrelated texts that share an id or have none all stay, and a copy under the id of another text goes. Null text is
    empty. An empty table stays empty.
    """
    names, docs = docs.columns, plain(docs, "doc_id", "text")
    groups = similar_groups(docs, similarity)
    least = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first"))
    # one key without nulls serves the join and the removal of repeated rows, so texts are shuffled once
    key = lambda c: F.coalesce(c.cast("bigint").cast("string"), F.lit("null"))
    kept = least.select(key(F.col("first.id")).alias("_key"), F.col("first.digest").alias("_digest"))
    marked = docs.withColumn("_key", key(docs["doc_id"])).withColumn("_digest", F.md5(text_col()))
    return marked.join(kept, ["_key", "_digest"], "left_semi").dropDuplicates(["_key", "_digest"]).select(*docs.columns).toDF(*names)
