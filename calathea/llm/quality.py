"""Quality by weak supervision: rules vote good, bad or abstain; their accuracies come from expectation-maximisation.

Method. Features of every whole text; each rule votes good within a range of its value, bad outside a wider one, and
abstains between the two or where the value is undefined. Votes of the documents that pass the base test are counted by
pattern (at most 3**rules rows, whatever the input), and EM over those counts fits a prior and each rule's accuracy on
good and on bad documents, abstentions left out. Nothing bounds the accuracies but a few prior votes, so a rule that
speaks of good and bad documents alike gets no say, and one bad vote can be outvoted. A document is kept when the base
test holds and its posterior of being good reaches THRESHOLD.

Defined results: a null text has no words and fails the base test; an empty table fits the starting values;
equal rows count each; a null id is kept as it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd
from .shared import column, cut, fresh

THRESHOLD, ROUNDS = 0.5, 200
#: Accuracies on good and on bad documents and the prior before any votes, and how many votes they count.
START_GOOD, START_BAD, START_PRIOR, START_VOTES = 0.9, 0.6, 0.8, 4.0
_U = np.uint64
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_distinct_words", "n_letters", "n_capitals", "n_symbol_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True

#: A rule: name, value by SQL over the features (null: abstain), least and most value beyond which it votes bad, least and
#: most value within which it votes good (None: unbounded).
RULES = (
    ("word_length", "word_chars / n_words", (3, 7), (4, 6)),
    ("symbols", "n_symbols / n_words", (None, 0.1), (None, 0.01)),
    ("alphabetic", "n_alpha_words / n_words", (0.8, None), (0.95, None)),
    ("lines", "n_dup_lines / n_lines", (None, 0.1), (None, 0.02)),
    ("repeats", "n_repeat_words / n_words", (None, 0.1), (None, 0.02)),
    ("capitals", "n_capitals / n_letters", (None, 0.2), (None, 0.1)),
    ("distinct", "n_distinct_words / n_words", (0.3, None), (0.45, None)),
)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def _features(g: wd.Words) -> list[np.ndarray]:
    n, docs = np.diff(g.first), g.docs
    begin, stop = g.doc_at[:-1], g.doc_at[1:]
    per_doc = lambda x: _sums(x, g.first[:-1], g.first[1:])
    lead = (g.data & 0xC0) != 0x80
    chars = per_doc(_sums(lead, g.starts, g.ends))
    letters = _LETTER[g.data]
    doc = g.doc_of_word()
    own = wd.mix(g.hashes ^ wd.mix(doc.astype(_U)))
    _, first = np.unique(own, return_index=True)
    distinct = np.bincount(doc[first], minlength=docs)
    h = wd.rolling(g.hashes, 3)
    repeat = np.zeros(docs, np.int64)
    if len(h):
        at = np.flatnonzero(doc[: len(h)] == doc[2:])
        _, back, count = np.unique(wd.mix(h[at] ^ wd.mix(doc[at].astype(_U))), return_inverse=True, return_counts=True)
        cover = np.zeros(len(doc) + 1, np.int64)
        hit = at[count[back] > 1]
        cover[hit] += 1
        covered = cover[:-1] > 0
        covered[1:] |= cover[:-2] > 0
        covered[2:] |= cover[:-3] > 0
        repeat = per_doc(covered)
    lines, dups = _lines(g)
    return [n, chars, _sums(_SYMBOL[g.data], begin, stop), lines, dups, repeat, per_doc(_sums(letters, g.starts, g.ends) > 0), distinct, _sums(letters, begin, stop), _sums(_CAPITAL[g.data], begin, stop), per_doc(_sums(_SYMBOL[g.data], g.starts, g.ends) > 0)]


def _lines(g: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier line) of each document."""
    if not len(g.data):
        return np.zeros(g.docs, np.int64), np.zeros(g.docs, np.int64)
    breaks = np.flatnonzero(g.data == 10)
    starts = np.unique(np.concatenate([g.doc_at[:-1], breaks + 1]))
    starts = starts[starts < len(g.data)]
    ends = np.append(starts[1:], len(g.data))
    last = g.data[np.maximum(ends - 1, 0)] == 10
    ends = ends - last
    full = np.searchsorted(g.starts, ends) > np.searchsorted(g.starts, starts)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(g.doc_at, starts, "right") - 1
    total = np.bincount(doc, minlength=g.docs)
    if not len(starts):
        return total, total
    up, down = wd._power_tables(len(g.data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(wd._TABLE[g.data] * up[: len(g.data)])])
    h = wd.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    _, first = np.unique(wd.mix(h ^ wd.mix(doc.astype(_U))), return_index=True)
    return total, total - np.bincount(doc[first], minlength=g.docs)


@F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in FEATURES]))
def text_features(text: pa.Array) -> pa.Array:
    parts = [_features(g) for g in wd.groups(text)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64) if parts else [], pa.int64()) for x in (zip(*parts, strict=True) if parts else [()] * len(FEATURES))], names=list(FEATURES))


def _inside(x: Column, least: float | None, most: float | None) -> Column:
    sides = ([x >= least] if least is not None else []) + ([x <= most] if most is not None else [])
    return sides[0] & sides[1] if len(sides) == 2 else sides[0]


def votes(features: str) -> list[Column]:
    """A column for each rule: 1 good, 0 bad, null abstains; `features` names the struct."""
    out = []
    for _, value, tolerable, good in RULES:
        top, bottom = (F.col(f"`{features}`.{part}") for part in value.split(" / "))
        x = F.try_divide(top, bottom)
        out.append(F.when(~_inside(x, *tolerable), 0).when(_inside(x, *good), 1))
    return out


@dataclass
class Model:
    """A prior of good documents, and each rule's accuracy on good and on bad ones."""

    prior: float
    good: list[float]
    bad: list[float]

    def log_odds(self, vote: Column, k: int) -> Column:
        return F.when(vote == 1, math.log(self.good[k] / (1 - self.bad[k]))).when(vote == 0, math.log((1 - self.good[k]) / self.bad[k])).otherwise(0.0)

    def posterior(self, features: str) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, vote in enumerate(votes(features)):
            odds = odds + self.log_odds(vote, k)
        return 1 / (1 + F.exp(-odds))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit from vote patterns (1, 0, -1 for abstained) and how often each occurs. Of the two classes, the good one is
    that in which rules vote good more often."""
    rules = patterns.shape[1]
    prior, good, bad = START_PRIOR, np.full(rules, START_GOOD), np.full(rules, START_BAD)
    up, down = (patterns == 1).astype(float), (patterns == 0).astype(float)
    cast = up + down
    for _ in range(rounds if len(counts) else 0):
        odds = np.log(prior / (1 - prior)) + up @ np.log(good / (1 - bad)) + down @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-odds))
        w, v = counts * p, counts * (1 - p)
        after = (
            (w @ up + START_VOTES * START_GOOD) / (w @ cast + START_VOTES),
            (v @ down + START_VOTES * START_BAD) / (v @ cast + START_VOTES),
        )
        moved = max(np.abs(after[0] - good).max(), np.abs(after[1] - bad).max())
        good, bad = after
        prior = float((w.sum() + START_VOTES * START_PRIOR) / (counts.sum() + START_VOTES))
        if moved < 1e-9:
            break
    if (good + bad).sum() < rules:
        prior, good, bad = 1 - prior, 1 - bad, 1 - good
    return Model(prior, good.tolist(), bad.tolist())


def fit(rows: DataFrame, features: str) -> Model:
    """The model of the documents that pass the base test, by a column of features; the driver gets a row for each
    pattern of votes."""
    names = [f"v{k}" for k in range(len(RULES))]
    cast = (F.coalesce(v, F.lit(-1)).cast("int").alias(n) for v, n in zip(votes(features), names, strict=True))
    found = rows.where(~base_failed(features)).select(*cast).groupBy(*names).count().orderBy(*names).toArrow()
    patterns = np.stack([found.column(n).to_numpy() for n in names], axis=1).reshape(-1, len(names))
    return expectation_maximisation(patterns, found.column("count").to_numpy())


def base_failed(features: str) -> Column:
    n, repeat = F.col(f"`{features}`.n_words"), F.col(f"`{features}`.n_repeat_words")
    return (n < 50) | (100 * repeat > 50 * n)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the features, base_failed, posterior, kept) of every document."""
    rows = cut(docs.select(column(docs, id_col).cast("long").alias("doc_id"), text_features(column(docs, text_col).cast("string")).alias("f")), "quality")
    p = fit(rows, "f").posterior("f")
    return rows.select("doc_id", "f.*", base_failed("f").alias("base_failed"), p.alias("posterior"), (~base_failed("f") & (p >= THRESHOLD)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents with all their columns; reads the texts twice, shuffles none of them."""
    name = fresh(docs.columns, "quality_features")
    rows = docs.select("*", text_features(column(docs, text_col).cast("string")).alias(name))
    model = fit(cut(rows.select(name), "quality"), name)
    return rows.where(~base_failed(name) & (model.posterior(name) >= THRESHOLD)).drop(name)
