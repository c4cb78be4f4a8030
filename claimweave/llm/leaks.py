"""Test passages inside corpus documents.

Method: q-gram lemma filtering. Texts are reduced to their letters and digits in lower
case, in any script (entities, tags, accents, look-alike letters, spacing and line-end
hyphens don't count). A stretch of m letters that is changed by e edits keeps at least
m + 1 - q*(e + 1) of its q-grams, all on diagonals (place in document minus place in item)
that drift by e at most. m is the shortest stretch of an item that holds enough of its
words, e a share of it; q is the longest one that leaves q-grams to count. Shared q-grams
are counted in overlapping diagonal bands, and every region that meets the bound is
aligned letter by letter inside its band; the aligned stretch must hold at least half of
the item's words.

The test set is a stated query set: it travels with the job in blocks of bounded size,
every document is read once, whole, and nothing is shuffled but the found rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Cyrillic and Greek letters that look like Latin ones, and letters that don't decompose.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНοανρτικεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhaeopcyxijskmtbhoavptikeabezhikmnoptyx"))
_TABLE = str.maketrans({**LOOKALIKES, "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ø": "o", "Ø": "o", "ł": "l", "ı": "i", "đ": "d"})
_TAG = re.compile(r"<[^<>]{0,400}>")
_NO_LETTER = re.compile(r"[\W_]+")
# scripts written without spaces: every sign counts as a word
_WORD = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\s\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def clear_text(text: str) -> str:
    """Lower-case text without markup and accents; words stay apart."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        if "Ã" in text or "â€" in text:
            try:
                text = text.encode("cp1252").decode("utf-8")
            except UnicodeError:
                pass
        text = unicodedata.normalize("NFKD", text.translate(_TABLE))
    return text.lower()


def letters(text: str) -> np.ndarray:
    """The letters and digits of a text in any script, as 16-bit codes."""
    text = _NO_LETTER.sub("", clear_text(text))
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8).astype(np.uint16)
    wide = np.frombuffer(text.encode("utf-32-le", "ignore"), np.uint32)
    return (wide ^ (wide >> 16)).astype(np.uint16)


def gram_codes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].astype(np.uint64)
    for k in range(1, q):
        out *= _FACTOR
        out += codes[k : k + n]
    return out ^ (out >> np.uint64(29))


def budget(length: int, rate: float) -> tuple[int, int]:
    """(q, shared q-grams) for a stretch of ``length`` letters of which ``rate`` may be edited.

    The lemma leaves ``length + 1 - q * (edits + 1)`` q-grams; q is the longest one up to 6
    that leaves enough to tell (eight, or four for q below 5), and 1 for the shortest stretches.
    """
    edits = int(rate * length)
    for q, least in ((6, 8), (5, 8), (4, 4), (3, 4), (2, 4)):
        if length + 1 - q * (edits + 1) >= least:
            return q, length + 1 - q * (edits + 1)
    return 1, max(1, length - edits)


class ItemIndex:
    """Q-grams of test items that share one q, with the place of each word."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray, tuple[int, int]]], q: int, drift: float, floor: float = 0.0):
        self.q = q
        self.ids = np.array([i for i, _, _, _ in items], np.int64)
        self.stretch = np.array([x[0] for _, _, _, x in items], np.int64)
        self.least_score = (floor * self.stretch).astype(np.int64)
        self.need = np.array([x[1] for _, _, _, x in items], np.int64)
        self.length = np.array([len(t) for _, t, _, _ in items], np.int64)
        self.band = (16 + drift * self.length).astype(np.int64)
        self.codes = np.zeros((len(items), int(self.length.max(initial=1))), np.uint16)
        self.word_ends = [ends for _, _, ends, _ in items]
        grams, owner, place = [], [], []
        for n, (_, t, _, _) in enumerate(items):
            self.codes[n, : len(t)] = t
            g = gram_codes(t, q)
            grams.append(g), owner.append(np.full(len(g), n)), place.append(np.arange(len(g)))
        g = np.concatenate(grams)
        o, p = (np.concatenate(x).astype(np.int64) for x in (owner, place))
        order = np.argsort(g, kind="stable")
        self.owner, self.place = o[order], p[order]
        self.unique, self.start, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.slot(self.unique)] = True

    def slot(self, g: np.ndarray) -> np.ndarray:
        return (g & np.uint64((1 << 22) - 1)).astype(np.int64)


def index_items(items: list[tuple[int, str]], least: float, rate: float, drift: float, floor: float = 0.0) -> list[ItemIndex]:
    """One index per q for a block of items; items without a letter are left out."""
    by_q: dict[int, list] = {}
    for item, text in items:
        parts = [x for x in (letters(w) for w in _WORD.findall(clear_text(text))) if len(x)]
        if not parts:
            continue
        ends = np.cumsum([len(x) for x in parts])
        k = max(1, int(np.ceil(least * len(parts))))  # the shortest stretch of that many words
        begins = np.concatenate([[0], ends[:-1]])
        shortest = int((ends[k - 1 :] - begins[: len(ends) - k + 1]).min())
        q, need = budget(shortest, rate)
        by_q.setdefault(q, []).append((item, np.concatenate(parts), ends, (shortest, need)))
    return [ItemIndex(group, q, drift, floor) for q, group in sorted(by_q.items())]


def candidates(index: ItemIndex, streams: list[np.ndarray], grams: np.ndarray, margin: int = 12) -> tuple[np.ndarray, ...]:
    """(document, item, diagonal, half width) of all regions whose bands hold enough shared q-grams.

    Bands overlap by half; of neighbours that both pass only the fuller one counts. The
    width of the alignment is that of the band's q-grams which continue one another, and a margin.
    """
    q, none = index.q, np.zeros(0, np.int64)
    sizes = np.array([len(s) for s in streams], np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(index.seen[index.slot(grams)])
    which = np.minimum(np.searchsorted(index.unique, grams[at]), len(index.unique) - 1)
    good = index.unique[which] == grams[at]
    at, which = at[good], which[good]
    doc = np.searchsorted(starts, at, side="right") - 1
    inside = at + q <= starts[doc] + sizes[doc]  # no q-gram across two documents
    at, which, doc = at[inside], which[inside], doc[inside]
    if not len(at):
        return none, none, none, none
    times = index.count[which]
    first = np.repeat(index.start[which] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    item, ipos = index.owner[first], index.place[first]
    doc, dpos = np.repeat(doc, times), np.repeat(at - starts[doc], times)
    n_items = len(index.ids)
    # a pair with too few q-grams altogether has no band with enough
    pair = doc * n_items + item
    keep = np.bincount(pair, minlength=len(streams) * n_items)[pair] >= index.need[item]
    if not keep.any():
        return none, none, none, none
    doc, item, dpos, ipos = doc[keep], item[keep], dpos[keep], ipos[keep]
    offset = int(index.length.max()) + int(index.band.max())
    diag = dpos - ipos + offset
    n_bands = (int(sizes.max(initial=0)) + 2 * offset) // int(index.band.min()) + 2
    slot = diag // index.band[item]
    key = (doc * n_items + item) * n_bands + slot
    key, diag, ipos = np.concatenate([key, key - 1]), np.concatenate([diag, diag]), np.concatenate([ipos, ipos])
    order = np.lexsort((ipos, key))
    key, diag, ipos = key[order], diag[order], ipos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ipos[1:] != ipos[:-1])  # a q-gram of the item counts once per band
    key, diag, ipos = key[new], diag[new], ipos[new]
    run = np.zeros(len(key), bool)
    if len(key) > 1:
        joint = (key[1:] == key[:-1]) & (diag[1:] == diag[:-1]) & (ipos[1:] == ipos[:-1] + 1)
        run[1:] |= joint
        run[:-1] |= joint
    band_key, begin, hits = np.unique(key, return_index=True, return_counts=True)
    far = np.int64(1 << 40)
    low = np.minimum.reduceat(np.where(run, diag, far), begin)
    high = np.maximum.reduceat(np.where(run, diag, -far), begin)
    alone = high < low  # no two q-grams in a row: the whole band counts
    low = np.where(alone, np.minimum.reduceat(diag, begin), low)
    high = np.where(alone, np.maximum.reduceat(diag, begin), high)
    # the bound holds for a stretch: so many q-grams must begin within its length in the item
    wide = np.int64(1 << 20)
    spot = np.repeat(np.arange(len(band_key)), hits) * wide + ipos
    reach = np.searchsorted(spot, spot + index.stretch[(key // n_bands) % n_items] - q, side="right") - np.arange(len(spot))
    enough = np.maximum.reduceat(reach, begin) >= index.need[(band_key // n_bands) % n_items]
    band_key, hits, low, high = band_key[enough], hits[enough], low[enough], high[enough]
    if not len(band_key):
        return none, none, none, none
    near = band_key[1:] == band_key[:-1] + 1
    top = np.ones(len(band_key), bool)
    top[:-1] &= ~(near & (hits[1:] > hits[:-1]))
    top[1:] &= ~(near & (hits[:-1] >= hits[1:]))
    pair, low, high = band_key[top] // n_bands, low[top], high[top]
    return pair // n_items, pair % n_items, (low + high) // 2 - offset, (high - low + 1) // 2 + margin


def align(index: ItemIndex, streams: list[np.ndarray], doc: np.ndarray, item: np.ndarray, diag: np.ndarray, half_width: int):
    """Best local alignment of each candidate inside its band: first and last item letter, matches.

    Match 1, any edit -1. The last letter comes from a pass over the item, the first one
    from a pass over both texts turned round. Candidates are columns, so that every step
    runs over contiguous rows.
    """
    n, width = len(doc), 2 * half_width + 1
    longest = int(index.length[item].max())
    text = np.zeros((n, longest + width), np.uint16)
    for k in range(n):
        s = streams[doc[k]]
        lo = int(diag[k]) - half_width
        a, b = max(lo, 0), min(lo + longest + width, len(s))
        if a < b:
            text[k, a - lo : b - lo] = s[a:b]
    codes = index.codes[item][:, :longest].copy()
    codes[np.arange(longest)[None, :] >= index.length[item][:, None]] = 0xFFFF
    text, codes = np.ascontiguousarray(text.T), np.ascontiguousarray(codes.T)
    score, end = _best_end(text, codes, width)
    start = end.copy()
    # a stretch that ends too early, or scores too little, is short: its first letter doesn't matter
    going = np.flatnonzero((end >= 0.9 * index.stretch[item]) & (score >= index.least_score[item]))
    if len(going):
        _, back = _best_end(np.ascontiguousarray(text[::-1, going]), np.ascontiguousarray(codes[::-1, going]), width)
        start[going] = np.minimum(longest - back, end[going])
    return start, end, (score + end - start) // 2


def _best_end(text: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and end of the best local alignment of each column, all columns advancing together.

    Scores are kept with one point added per item letter and per place in the band, so
    that edits cost nothing or one point and a running maximum needs no correction.
    """
    longest, n = codes.shape
    floor = np.repeat(np.arange(width + 1, dtype=np.int16)[:, None], n, 1)
    score = floor.copy()
    best, end = np.zeros(n, np.int16), np.zeros(n, np.int64)
    a, b = np.empty((width, n), np.int16), np.empty((width, n), np.int16)
    for i in range(longest):
        np.multiply(text[i : i + width] == codes[i], np.int16(2), out=a)
        a += score[:-1]
        score[-1] = width + i  # nothing comes from outside the band
        np.maximum(a, score[1:] - np.int16(1), out=a)  # a letter of the item left out
        k = 1
        while k < width:  # letters of the document left out: a running maximum, by doubling
            np.maximum(a[k:], a[:-k], out=b[k:])
            b[:k] = a[:k]
            a, b = b, a
            k *= 2
        floor += np.int16(1)
        np.maximum(a, floor[:-1], out=score[:-1])
        a = np.subtract(score[:-1], floor[:-1], out=a)
        top = a.max(0)
        better = top > best
        best[better], end[better] = top[better], i + 1
    return best.astype(np.int64), end


def _judge(index: ItemIndex, streams: list[np.ndarray], grams: np.ndarray, least: float, accuracy: float, step: int = 256) -> dict:
    """(document, item) -> (words, item words, matched, span) of pairs of which some region passes the alignment."""
    doc, item, diag, half = candidates(index, streams, grams)
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    order = np.argsort(half, kind="stable")
    for at in range(0, len(order), step):  # regions of like width are aligned together
        part = order[at : at + step]
        d, i = doc[part], item[part]
        lo, hi, match = align(index, streams, d, i, diag[part], int(half[part].max()))
        for k in range(len(part)):
            ends = index.word_ends[i[k]]
            begins = np.concatenate([[0], ends[:-1]])
            inside = np.minimum(ends, hi[k]) - np.maximum(begins, lo[k])
            words, span = int((2 * inside > ends - begins).sum()), int(max(hi[k] - lo[k], 1))
            if words >= least * len(ends) and match[k] >= accuracy * span:
                key, row = (int(d[k]), int(i[k])), (words, len(ends), int(match[k]), span)
                found[key] = max(found.get(key, row), row)
    return found


def _scan(blocks: list, least: float, accuracy: float, rate: float, drift: float, batch: int = 1_024):
    """mapInArrow function: every document against every block of items; blocks are broadcast variables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = 0.9 * (2 * accuracy - 1)  # score per letter that the accuracy asks for; words may be cut at the ends
        kept = index_items(blocks[0].value, least, rate, drift, floor) if len(blocks) == 1 else None
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                streams = [letters(t) if t else np.zeros(0, np.uint16) for t in b.column(1).to_pylist()]
                joined, grams, out = np.concatenate(streams), {}, []
                for block in blocks:
                    indexes = kept
                    if indexes is None:
                        indexes = index_items(block.value, least, rate, drift, floor)
                        block.__dict__.pop("_value", None)  # only one block at a time stays in memory
                    for index in indexes:
                        if index.q not in grams:
                            grams[index.q] = gram_codes(joined, index.q)
                        if len(grams[index.q]):
                            for (d, i), row in _judge(index, streams, grams[index.q], least, accuracy).items():
                                out.append((ids[d], index.ids[i], *row))
                if out:
                    columns = [pa.array(np.array(c, np.int64)) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "words", "item_words", "matched", "span"])

    return run


def find_leaks(
    docs: DataFrame, items: DataFrame, least: float = 0.5, accuracy: float = 0.62, rate: float = 0.12, drift: float = 0.3, block: int = 2_000,
) -> DataFrame:
    """``doc_id, item_id, words, item_words, matched, span`` of documents that hold at least ``least`` of an item's words.

    ``rate``: edits per letter of the shortest such stretch that the q-gram count must
    survive; ``drift``: letters of the item by which a region may shift, as part of its
    length (and 16 more); ``accuracy``: matched letters per letter of the aligned stretch;
    ``block``: items that are in memory at once. Every document is read once, whatever the
    number of items; blocks reach the executors as broadcasts of this bounded size.

    Defined cases: null or empty texts and items without a letter leak nothing; in scripts
    without spaces every sign is a word; a document with several rows is reported once per
    differing find; extra columns are ignored; empty tables give no rows.
    """
    context = docs.sparkSession.sparkContext
    rows = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    blocks, part = [], []
    for r in rows.orderBy("item_id", "text").toLocalIterator():  # the stated query set, block by block
        part.append((r["item_id"], r["text"]))
        if len(part) == block:
            blocks.append(context.broadcast(part))
            part = []
    if part:
        blocks.append(context.broadcast(part))
    schema = "doc_id long, item_id long, words long, item_words long, matched long, span long"
    if not blocks:
        return docs.sparkSession.createDataFrame([], schema)
    source = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return source.mapInArrow(_scan(blocks, least, accuracy, rate, drift), schema).distinct()
