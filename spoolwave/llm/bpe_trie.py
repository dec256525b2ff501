"""Byte-level BPE encoding by a prefix-sharing trie, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolwave.llm.common import map_batches, plain, spread, text_col

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHORT = (2, 1)
#: Words of the young table of a worker. A full one becomes the old table, whose words return when met again; the old one
#: before it is dropped. That bounds memory and keeps the frequent words.
CACHED_WORDS = 250_000
#: Words of one trie; a larger batch is walked as several tries of neighbouring words.
TRIE_WORDS = 16_384
PAIRS = 300_000


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters are themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE model from a tokenizer file: token bytes, merge ranks and added tokens.

    A sequence of tokens is the encoding of its bytes exactly if each neighbouring pair is (and each token is on its own),
    so the last token of the encoding of a prefix is all that has to be known to go on by a byte: it is the one suffix token
    that forms a valid pair with the last token before it.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair = (self.ids[left], self.ids[right])
            self.rank.setdefault(pair, n)
            self.made.setdefault(pair, self.ids[left + right])
        self.parts = {token: (*pair, self.rank[pair]) for pair, token in self.made.items()}
        self.one_way = len(self.parts) == len(self.made)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes.setdefault(i, content.encode("utf-8"))
        self._valid: dict[tuple[int, int], bool] = {}
        for unreachable in [t for t, i in self.ids.items() if len(t) > 1 and self.merge(t) != [i]]:
            del self.ids[unreachable]
        # lengths of the tokens that end with three given bytes, longest first, then the short ones
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                lengths.setdefault(t[-3:], set()).add(len(t))
        self.ends = {end: (*sorted(n, reverse=True), *_SHORT) for end, n in lengths.items()}

    def merge(self, word: bytes) -> list[int]:
        """Encoding by its definition: merge the pair of least rank, leftmost first, until none is left."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (pair := (parts[best], parts[best + 1])) not in self.rank:
                break
            parts[best : best + 2] = [self.made[pair]]
        return parts

    def valid(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined bytes are encoded."""
        known = self._valid.get((left, right))
        if known is None:
            if len(self._valid) > PAIRS:
                self._valid.clear()
            apart = self._apart(left, right) if self.one_way else self.merge(self.bytes[left] + self.bytes[right]) == [left, right]
            known = self._valid[left, right] = apart
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Take both tokens' merges back, the latest first: no pair at the seam may have merged before the one taken back.

        Merges of one rank go from left to right, so the seam goes before an equal merge on its right, after one on its left.
        """
        rank, parts, until, whole = self.rank.get, self.parts.get, 1 << 60, (0, 0, -1)
        while rank((left, right), 1 << 60) >= until:
            a, b = parts(left, whole), parts(right, whole)
            if a[2] < 0 and b[2] < 0:
                return True
            if a[2] > b[2]:
                until, left = a[2], a[1]
            else:
                until, right = b[2] + 1, b[0]
        return False


def encode_words(vocab: Vocabulary, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Encodings of distinct words: all go into one trie, and one depth-first walk hands each node its last token.

    What two words share at their start is a path of the trie, so it is encoded once. A word that shares nothing further is a
    leaf, whose rest is walked without nodes. The walk keeps one token per depth.
    """
    root: dict[bytes, dict | bytes] = {}
    for word in words:
        node, i = root, 0
        while True:
            b = word[i : i + 1]  # empty where the word ends
            have = node.get(b)
            if have is None:
                node[b] = word
                break
            if type(have) is bytes:  # a leaf makes room for a node
                have = node[b] = {have[i + 1 : i + 2]: have}
            node, i = have, i + 1
    ids, ends, valid, known = vocab.ids.get, vocab.ends.get, vocab.valid, vocab._valid.get
    last: list[int] = [0]
    size: list[int] = [0]
    stack: list[tuple[int, bytes, dict | bytes]] = [(1, b, child) for b, child in root.items()]
    while stack:
        depth, prefix, child = stack.pop()
        del last[depth:], size[depth:]
        leaf = type(child) is bytes
        if leaf:
            prefix = child
        for d in range(depth, len(prefix) + 1):
            for n in ends(prefix[d - 3 if d > 3 else 0 : d], _SHORT):
                if n < d:
                    token = ids(prefix[d - n : d])
                    if token is not None and (known((before := last[d - n], token)) or valid(before, token)):
                        break
                elif n == d:
                    token = ids(prefix[:d])
                    if token is not None:
                        break
            else:
                raise ValueError("no token ends here")
            last.append(token)
            size.append(n)
        if leaf:
            found, at = [], len(prefix)
            while at:
                found.append(last[at])
                at -= size[at]
            found.reverse()
            yield child, found
        else:
            stack += [(depth + 1, prefix + b, below) for b, below in child.items()]


class Encoder:
    """Encodes and decodes whole texts; word encodings are shared between texts."""

    def __init__(self, path: str) -> None:
        self.vocab = Vocabulary(path)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.said = {str(i): t for i, t in self.vocab.bytes.items()}  # token bytes by the id as it is written
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.vocab.added, key=len, reverse=True)) + ")") if self.vocab.added else None

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(t in text for t in self.vocab.added):
            return self.split(text)
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self.split(part))]

    def learn(self, words: set[str]) -> None:
        """Put these words into the young table: ids joined by commas."""
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        new = []
        for w in words.difference(self.young):
            known = self.old.get(w)
            if known is None:
                new.append(w.encode("utf-8"))
            else:
                self.young[w] = known
        new.sort()  # neighbours share their beginnings
        added = self.vocab.added
        for at in range(0, len(new), TRIE_WORDS):
            for raw, found in encode_words(self.vocab, [w for w in new[at : at + TRIE_WORDS] if w.decode("utf-8") not in added]):
                self.young[raw.decode("utf-8")] = ",".join(map(str, found))
        for content in words.intersection(added):
            self.young[content] = str(added[content])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """Per text: token count, ids joined by commas."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        get = self.young.__getitem__
        for parts in split:
            ids = ",".join(map(get, parts))
            yield (ids.count(",") + 1 if ids else 0), ids

    def decode(self, ids: str) -> str:
        """The text of a sequence of ids joined by commas: the tokens' bytes end to end; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.said.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Characters that are split and encoded together, so that one walk serves many texts and memory stays bounded.
GROUP_CHARS = 2_000_000


def groups(texts: list[str]) -> Iterator[list[str]]:
    own, chars = [], 0
    for t in texts:
        own.append(t)
        chars += len(t)
        if chars > GROUP_CHARS:
            yield own
            own, chars = [], 0
    if own:
        yield own


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    Whole texts are encoded as the vocabulary's own library does, added tokens included where their strings occur; then the
    ids are decoded. Null text is empty: no tokens, digests of nothing. A null doc_id is kept; repeated rows repeat. Very
    long texts are never cut. An empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = encoder(vocabulary), []
        for own in groups(batch.column(1).to_pylist()):
            for n, ids in enc.encode(own):
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest()))
        n, ids, dec = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = plain(docs, "doc_id", "text")
    return map_batches(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>): the token ids themselves, for a training set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(vocabulary)
        ids = [[int(x) for x in joined.split(",")] if joined else [] for own in groups(batch.column(1).to_pylist()) for _, joined in enc.encode(own)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    docs = plain(docs, "doc_id", "text")
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text")), run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): invalid UTF-8 becomes U+FFFD; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(vocabulary)
        texts = [enc.decode(",".join(map(str, ids or ()))) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids"), run, "doc_id bigint, text string")
