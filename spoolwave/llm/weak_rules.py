"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolwave.llm.common import checkpoint, map_batches, plain, spread, text_col

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_ENDS = frozenset(b".!?:;\"')")
#: Frequent short words of the four languages.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for on with as was at by be this are from or an"
        " der die und das ist von den mit ein eine nicht sich auch als auf dem zu es"
        " le la les de des et est un une que qui dans pour sur pas du au par en"
        " el los las que y del se por con su para una no como al lo"
    ).split()
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_ended", "n_distinct", "n_stop", "n_upper", "n_letters", "n_bang", "n_bytes")
#: Share of good documents that PRIOR_DOCS imagined documents bring into the estimate; they matter in tiny tables only.
PRIOR = 0.85
PRIOR_DOCS = 20
#: Probability of being good that the estimate starts from, by number of bad votes (the last for more).
START = (0.95, 0.6, 0.2, 0.05)


def measure(text: str) -> tuple[int, ...]:
    """BASE then MORE of one whole text; words are runs of characters other than the six ASCII white spaces."""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    size = len(raw)
    count = lambda chars: size - len(raw.translate(None, chars))
    dup = lines = ended = 0
    seen: set[bytes] = set()
    for line in raw.split(b"\n"):
        bare = line.rstrip(SPACES)
        if bare:
            lines += 1
            ended += bare[-1] in _ENDS
            dup += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    codes = [ids.setdefault(w, len(ids)) for w in words]
    repeated = 0
    if n > 3:
        c = np.array(codes, np.int64)
        pairs = c[:-1] * len(ids) + c[1:]
        _, pair = np.unique(pairs, return_inverse=True)  # keeps the key of three words within 64 bits
        _, inverse, times = np.unique(pair[:-1].astype(np.int64) * len(ids) + c[2:], return_inverse=True, return_counts=True)
        twice = times[inverse] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= twice
        repeated = int(covered.sum())
    stop = sum(w in ids for w in STOP_WORDS)
    return (n, len(text) - count(SPACES), count(SYMBOLS), dup, repeated, lines, ended, len(ids), stop, count(UPPER), count(LETTERS), raw.count(b"!"), size - count(SPACES))


def features(docs: DataFrame) -> DataFrame:
    names = [*BASE, *MORE]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([measure(t) for t in batch.column(1).to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, rows.T.copy())], names=["doc_id", *names])

    docs = plain(docs, "doc_id", "text")
    return map_batches(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))), run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> list[tuple[str, Column, Column]]:
    """(name, votes bad, votes good); a rule abstains where neither holds.

    Rules are heuristics that may be wrong on a good document: thresholds lie near what good prose shows, and how much a vote
    counts is left to the estimate. A rule for one kind of junk has no opinion on other texts. Missing stop words are no bad
    vote, since the text may be in a language whose words are not listed.
    """
    enough, never = F.col("n_words") >= 20, F.lit(False)
    symbols, upper, bang = _ratio("n_symbols", "n_words"), _ratio("n_upper", "n_bytes"), _ratio("n_bang", "n_words")
    repeat, dup, ended = _ratio("n_repeat_words", "n_words"), _ratio("n_dup_lines", "n_lines"), _ratio("n_ended", "n_lines")
    distinct, length, letters = _ratio("n_distinct", "n_words"), _ratio("word_chars", "n_words"), _ratio("n_letters", "n_bytes")
    lines = F.col("n_lines") >= 3
    return [
        ("length", enough & (F.col("n_words") < 80), F.col("n_words") >= 80),
        ("symbols", symbols > 0.1, never),
        ("capitals", enough & (upper > 0.05), never),
        ("exclamation", enough & (bang > 0.05), never),
        ("repeated_words", enough & (repeat > 0.05), never),
        ("repeated_lines", dup > 0.1, never),
        ("line_ends", lines & (ended < 0.5), lines & (ended > 0.8)),
        ("vocabulary", enough & (distinct < 0.5), enough & (distinct > 0.6)),
        ("word_length", enough & ((length < 4.4) | (length > 6)), never),
        ("stop_words", never, F.col("n_stop") >= 6),
        ("letters", enough & (letters < 0.9), letters > 0.95),
    ]


def pattern(n_rules: list[tuple[str, Column, Column]]) -> Column:
    """All votes of a row as one number: a digit to the base 3 for each rule, 0 abstains, 1 bad, 2 good."""
    digits = [F.when(bad, 1).when(good, 2).otherwise(0) * 3**k for k, (_, bad, good) in enumerate(n_rules)]
    total = digits[0]
    for d in digits[1:]:
        total = total + d
    return total.cast("bigint")


def em(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights [rule, vote] and bias of the log odds of being good.

    Dawid-Skene: each rule has, for each class, a chance to abstain, to vote bad and to vote good; expectation-maximisation
    over the counts of vote patterns estimates them together with the share of good documents. It starts from the number of bad
    votes, which only says which of the two classes is the good one. One imagined document a class, which votes like all
    documents do, keeps chances off zero; nothing else bounds what a vote may weigh, and silence weighs what it is worth.
    """
    votes = (patterns[:, None] // 3 ** np.arange(n_rules)) % 3
    post = np.array(START)[np.minimum((votes == 1).sum(1), len(START) - 1)]
    weights, bias = np.zeros((n_rules, 3)), 0.0
    for _ in range(rounds):
        good, bad = counts * post, counts * (1 - post)
        prior = (good.sum() + PRIOR_DOCS * PRIOR) / (counts.sum() + PRIOR_DOCS)
        bias = np.log(prior / (1 - prior))
        for k in range(n_rules):
            g = np.bincount(votes[:, k], good, 3)
            b = np.bincount(votes[:, k], bad, 3)
            base = (g + b + 1e-9) / (g + b + 1e-9).sum()
            weights[k] = np.log((g + base) / (g.sum() + 1)) - np.log((b + base) / (b.sum() + 1))
        new = 1 / (1 + np.exp(-np.clip(bias + weights[np.arange(n_rules), votes].sum(1), -40, 40)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return weights, float(bias)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior), a row per input row.

    All documents take part in the estimate: their vote patterns are counted on the executors, and at most 3 to the power of
    the number of rules counts reach the driver. Null text is empty; an empty text fails the base rule. A null doc_id is
    kept; repeated rows are judged alike. An empty table gives an empty result.
    """
    found = rules()
    own = checkpoint(features(docs).withColumn("_votes", pattern(found)))
    rows = sorted(own.groupBy("_votes").count().collect())
    weights, bias = em(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), len(found))
    odds = F.lit(bias)
    for k in range(len(found)):
        digit = F.pmod(F.floor(F.col("_votes") / 3**k), F.lit(3)).cast("int")
        odds = odds + F.element_at(F.array(*[F.lit(float(w)) for w in weights[k]]), digit + 1)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return own.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (posterior >= 0.5)).alias("kept"), posterior.alias("posterior"))
