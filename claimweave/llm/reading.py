"""Reading level of documents with gradient-boosted trees.

The trees see how the words of a sentence are distributed: length (words, quantiles of
word length), vocabulary (quantiles of how common the words are in the whole corpus,
share of rare ones, variety), syntax (commas, clause marks, function words) and cohesion
(words shared with the two sentences before). No grades come with the texts, so the
target is the LIX index (a public readability scale) of the document's *other* sentences:
nothing of a sentence's own counts is in its target, and what the model learns is which
shapes of sentences stand in demanding company. Out-of-fold predictions by source give
the calibration line (observed on predicted) that grades go through, and their error is
reported beside that of the sentence's own index. Bands are the index's public classes.

Word frequencies are counted over all documents. Fitted on a bounded sample:
``sample_docs`` documents chosen by the hash of their id and at most ``sample_sentences``
sentences. Everything else reads every document whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.boosting import BoostedTrees

FEATURES = (
    "words length_mean length_q25 length_q50 length_q75 length_max long_share common_q50 common_q75 common_q90 rare_share function_share "
    "variety commas clauses shared_1 shared_2"
).split()
# The index's public classes end at 25 (children's books) and begin at 60 (scholarly prose).
EASY, HARD = 25.0, 60.0
_TAG = re.compile(r"</?(?:p|div|br|i|b|em|strong|span|h[1-6]|li|ul|ol|a|blockquote)\b[^<>]*>", re.I)
_SENTENCE = re.compile(r"[^.?!\n。！？।]+[.?!。！？।]+")
_ENDS = ".?!。！？।"
# lines that are no prose: JSON, page marks, quads and other lines of terms
_NOT_PROSE = re.compile(r"^\s*[{\[]|^\s*--|^\s*\(c\)|<(?:ex|ctx|rdf|http|https|_):|^\s*_:|\?\w+ \w+:\w+")
# table rows and query clauses, if they don't end like a sentence
_UNENDED = re.compile(r"\||^\s*[A-Z]{4,} ")
_LINK = re.compile(r"https?://\S+")
RARE = 15  # class of words outside the list of common ones; class k holds ranks 2**k to 2**(k+1) - 1


def prose_sentences(text: str) -> list[list[str]]:
    """Words of each prose sentence; quads, JSON, queries, tables and page marks aside.

    A line's last words without an end mark count if they are eight or more, of letters only.
    """
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    out = []
    for line in text.split("\n"):
        if not line or _NOT_PROSE.search(line) or line.count("|") > 1:
            continue
        end = line.rstrip("\"')»”“ \t\r")
        ended = end[-1:] in _ENDS
        if not ended and _UNENDED.search(line):
            continue
        if "://" in line:
            line = _LINK.sub(" ", line)
        for s in _SENTENCE.findall(line):
            words = s.split()
            if len(words) >= 2:
                out.append(words)
        tail = "" if ended else line[max(line.rfind(c) for c in _ENDS) + 1 :]
        if len(tail) > 30 and ":" not in tail:
            words = tail.split()
            if len(words) >= 8 and not any(c.isdigit() for c in tail):
                out.append(words)
    return out


def sentence_features(docs: list[list[list[str]]], common: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all sentences of a batch of documents, each row's document, and LIX counts (words, long, counted).

    Words are looked at once per batch; the rest are array operations over the batch.
    """
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    sentences = [s for d in docs for s in d]
    m = len(sentences)
    if not m:
        return np.zeros((0, len(FEATURES)), np.float32), owner, np.zeros((0, 3))
    n = np.fromiter(map(len, sentences), np.int64, m)
    start = np.cumsum(n) - n
    ids, words = pd.factorize(np.array([w for s in sentences for w in s], object))
    bare = [w.strip(".,;:!?\"'()[]«»„“”–-") for w in words]
    size = np.fromiter(map(len, words), np.int64, len(words))
    low = np.fromiter((w[0] >= "a" for w in words), bool, len(words))  # words in lower case are no names (in German: no nouns either)
    rank = np.fromiter((common.get(w.lower(), RARE) for w in bare), np.int64, len(words))
    mark = np.fromiter((0 if w[-1] == "," else 1 if w[-1] in ";:" else 2 for w in words), np.int64, len(words))
    which = np.repeat(np.arange(m), n)
    per = lambda x: np.add.reduceat(x, start)
    counted = per(low[ids].astype(np.int64))
    use = low[ids] | (counted == 0)[which]
    k = np.maximum(per(use.astype(np.int64)), 1)
    long = per((use & (size[ids] > 6)).astype(np.int64))

    def quantiles(values: np.ndarray, qs: list[float]) -> list[np.ndarray]:
        w = which[use]
        key = np.sort(w * 64 + np.minimum(values[ids][use], 63))
        first = np.searchsorted(key, np.arange(m) * 64)
        return [key[first + (q * (k - 1)).astype(np.int64)] % 64 for q in qs]

    v = len(words) + 1
    place = np.arange(m) + 3 * owner  # documents lie apart, so that none continues another
    seen = np.unique(place[which] * v + ids)
    seen_in = np.searchsorted(place, seen // v)
    shared = []
    for back in (1, 2):
        at = np.minimum(np.searchsorted(seen, seen - back * v), len(seen) - 1)
        shared.append(np.bincount(seen_in, seen[at] == seen - back * v, m) / n)
    q25, q50, q75, top = quantiles(size, [0.25, 0.5, 0.75, 1.0])
    c50, c75, c90 = quantiles(rank, [0.5, 0.75, 0.9])
    x = np.stack([
        n, per(np.where(use, size[ids], 0)) / k, q25, q50, q75, top, long / k, c50, c75, c90, per((use & (rank[ids] == RARE)).astype(np.int64)) / k,
        per((rank[ids] <= 5).astype(np.int64)) / n, np.bincount(seen_in, minlength=m) / n,
        per((mark[ids] == 0).astype(np.int64)), per((mark[ids] == 1).astype(np.int64)), *shared,
    ], 1).astype(np.float32)
    return x, owner, np.stack([n, long, k], 1).astype(float)


def index_of(counts: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """LIX from sums of (words, long words, counted words) and numbers of sentences."""
    return counts[..., 0] / np.maximum(sentences, 1) + 100.0 * counts[..., 1] / np.maximum(counts[..., 2], 1)


def common_words(docs: DataFrame, most: int = 16_384) -> dict[str, int]:
    """Frequency class (0: the commonest word, 14: ranks 16,384 and on) of the ``most`` commonest words of all documents."""
    words = docs.where("text is not null").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()  # a list of fixed length
    return {r["w"]: (i + 1).bit_length() - 1 for i, r in enumerate(top)}


class ReadingModel:
    """Trees, calibration line, word classes, and the held-out errors: ``folds`` against the whole
    document's index by fold, ``sources`` against that of its other sentences by source."""

    def __init__(self, trees: BoostedTrees, slope: float, shift: float, common: dict[str, int], folds: list, sources: list):
        self.trees, self.slope, self.shift, self.common, self.folds, self.sources = trees, slope, shift, common, folds, sources

    def grade(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.trees.predict(x) + self.shift


def fit_model(docs: DataFrame, sample_docs: int = 1_500, sample_sentences: int = 20_000, n_folds: int = 5) -> ReadingModel:
    """Fit on the bounded sample; cross-validate by source and calibrate on the out-of-fold predictions."""
    usable = docs.where("doc_id is not null and text is not null")
    total = usable.count()
    share = min(1.0, 1.3 * sample_docs / max(1, total))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = chosen.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").limit(sample_docs).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["source"], r["text"]))
    common = common_words(docs) if rows else {}
    texts, names = [], []
    for r in rows:
        sentences = prose_sentences(r["text"])
        if len(sentences) >= 3:
            texts.append(sentences), names.append(r["source"])
    if not texts:
        return ReadingModel(BoostedTrees(rounds=0).fit(np.zeros((1, len(FEATURES))), np.zeros(1)), 1.0, 0.0, common, [], [])
    x, owner, counts = sentence_features(texts, common)
    n = np.bincount(owner)
    totals = np.stack([np.bincount(owner, c) for c in counts.T], 1)
    y = index_of(totals[owner] - counts, n[owner] - 1)  # the document without the sentence
    own, whole = index_of(counts, np.ones(len(counts))), index_of(totals[owner], n[owner])
    s = np.array(names)[owner]
    if len(x) > sample_sentences:
        pick = np.random.default_rng(0).permutation(len(x))[:sample_sentences]
        x, y, s, own, whole = x[pick], y[pick], s[pick], own[pick], whole[pick]
    sources = np.unique(s)
    fold = np.searchsorted(sources, s) % n_folds
    out, folds = np.zeros(len(y)), []
    for k in range(n_folds):
        held = fold == k
        if held.all() or not held.any():
            out[held] = y.mean()
            continue
        out[held] = BoostedTrees().fit(x[~held], y[~held]).predict(x[held])
        folds.append((f"fold {k}", int(held.sum()), float(np.abs(out[held] - whole[held]).mean()), float(np.abs(whole[held] - whole[~held].mean()).mean())))
    spread = float(((out - out.mean()) ** 2).sum())
    slope = float(((out - out.mean()) * (y - y.mean())).sum()) / spread if spread > 0 else 1.0
    shift = float(y.mean() - slope * out.mean())
    error = lambda guess, at: float(np.abs(guess[at] - y[at]).mean())
    by_source = [
        (str(name), int(at.sum()), error(slope * out + shift, at), error(own, at), error(np.full(len(y), y.mean()), at), float((slope * out + shift - y)[at].mean()))
        for name in sources for at in [s == name]
    ]
    return ReadingModel(BoostedTrees().fit(x, y), slope, shift, common, folds, by_source)


SCHEMA = "doc_id long, n_sentences int, grade double, low_share double, high_share double, band int"


def _rate(model: ReadingModel, low: float, high: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                ids = b.column(0)
                docs = [prose_sentences(t) if t else [] for t in b.column(1).to_pylist()]
                x, owner, _ = sentence_features(docs, model.common)
                n, grades = np.bincount(owner, minlength=len(docs)), model.grade(x)
                sums = lambda v: np.bincount(owner, v, len(docs)) / np.maximum(n, 1)
                mean, lo, hi = sums(grades), sums(grades <= low), sums(grades >= high)
                band = np.where(n < least, 0, np.where(lo > 0.5, 1, np.where(hi > 0.5, 3, 2)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()), pa.array(n.astype(np.int32)), pa.array(mean, mask=n == 0), pa.array(lo), pa.array(hi),
                        pa.array(band.astype(np.int32), mask=n < least),
                    ],
                    names=["doc_id", "n_sentences", "grade", "low_share", "high_share", "band"],
                )

    return run


def reading_level(docs: DataFrame, model: ReadingModel, low: float = EASY, high: float = HARD, least: int = 3) -> DataFrame:
    """One row per document row: mean grade of its sentences, shares of easy and demanding ones, band.

    ``band``: 1 if more than half of the sentences are graded ``low`` or easier, 3 if more
    than half are ``high`` or harder, else 2; null with fewer than ``least`` prose sentences. Sentences
    count one each, whatever their length.

    Defined cases: null and empty texts have no sentence, null grade and band; repeated
    rows stay repeated; rows without doc_id are left out; extra columns are ignored.
    """
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_rate(model, low, high, least), SCHEMA)
