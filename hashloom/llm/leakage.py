"""Evaluation texts leaking into training text: BM25 over an inverted index of the test items, block-max pruning, verification.

Words are reduced to the letters and digits that survive scanning: lower case, nothing but ASCII letters and digits (so accents and
whatever garbled them vanish on both sides), letters that scanners take for one another as one. The terms of the index are pairs of
neighbouring words: columns read across each other and adverts leave most of them whole, and unrelated pages hardly have any.
Every page is one query of its distinct terms against the index of items, so that the parts of a reproduction count together however
far apart they stand. A term's postings are its items in order with their impacts; items stand in blocks of BLOCK, and for each term
and block with postings the largest impact is kept. Block-max WAND walks the postings of a page's terms item by item: the pivot is
the first item whose terms could together reach a threshold, whole blocks are left out whose largest impacts can't, and only what
remains is scored. An item's threshold is a fraction of the least score that ``least`` successive words of it could give. The index
takes memory in proportion to the words of the items.

Hits are verified by aligning page and item: words in the same order, any number of words of other columns or adverts in between
allowed, words lost to misreadings allowed, single words that merely happen to recur left out. Words weigh as much as they tell items apart, so
that items made after one pattern aren't taken for each other.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Items per block of the index, and items per index, which bounds its memory: larger sets of items are matched index by index.
BLOCK, SHARD = 16, 50_000
#: Share of the least possible score of ``least`` successive words that a page must reach.
TOLERANCE = 0.45
#: What a lost word of the item costs against its weight. Foreign words of the page may lie in between in any number, at no cost.
LOST = 0.6
#: Share of the weight of ``least`` successive words that must be found. Reproductions have at least ``least`` words, other shared runs less than half.
ENOUGH = 0.72

_KEEP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_DROP = bytes(i for i in range(128) if not (chr(i).isalnum() or chr(i).isspace()))
#: Letters and digits that scanners take for one another; each group is written as its last member.
_ALIKE = bytes.maketrans(b"01il5s8b6h9qgcoeauvrnft", b"olllsssbbbgggeeeennnntt")
_BROKEN = re.compile("(?<=\\w)[-\u00ad\u2010\u2011\u00ac=~][ \t]*\n[ \t]*(?=\\w)")


def words(text: str | None) -> list[bytes]:
    """The reduced words of a text, whole; a word broken at a line end with a mark is put together."""
    if not text:
        return []
    flat = _BROKEN.sub("", text).encode("ascii", "ignore").translate(_KEEP, _DROP)
    return flat.replace(b"vv", b"w").replace(b"rn", b"m").replace(b"cl", b"d").replace(b"li", b"h").translate(_ALIKE).split()


@dataclass
class Index:
    """Postings of pairs of neighbouring words. Arrays are per item, term, posting, or per block with postings of a term."""

    ids: list[int]
    items: list[list[bytes]]
    weights: list[list[float]]  # of the items' words
    need: np.ndarray  # by item
    block_need: np.ndarray  # by block of items, the lowest in it
    vocabulary: dict[bytes, int]
    keys: np.ndarray  # of the terms, sorted: first word x words + second word
    at: np.ndarray  # term -> its first posting; one more than terms
    post: np.ndarray  # items
    impact: np.ndarray
    peak: np.ndarray  # term -> its largest impact
    block_at: np.ndarray  # term -> its first block
    blocks: np.ndarray
    block_peak: np.ndarray

    def terms(self, page: list[bytes]) -> np.ndarray:
        """The distinct terms of a page that some item has."""
        own = np.fromiter((self.vocabulary.get(w, -1) for w in page), np.int64, len(page))
        first, second = own[:-1], own[1:]
        key = np.unique((first * len(self.vocabulary) + second)[(first >= 0) & (second >= 0)])
        if not len(key) or not len(self.keys):
            return np.empty(0, np.int64)
        t = np.searchsorted(self.keys, key)
        t[t == len(self.keys)] = 0
        return t[self.keys[t] == key]


def build_index(items: list[tuple[int, str | None]], least: int = 25) -> Index:
    """BM25 impacts of the items with at least ``least`` words; shorter ones can't be reproduced by that many words."""
    kept = sorted(((i, w) for i, t in items if len(w := words(t)) >= least), key=lambda x: x[0])
    n = len(kept)
    seen = Counter(x for _, w in kept for x in set(w))
    weights = [[math.log1p((n - seen[x] + 0.5) / (seen[x] + 0.5)) for x in w] for _, w in kept]
    vocabulary = {w: k for k, w in enumerate(seen)}
    own = [np.array([vocabulary[x] for x in w], np.int64) for _, w in kept]
    runs = [w[:-1] * len(vocabulary) + w[1:] for w in own]  # the terms of the items in their order
    counted = [np.unique(r, return_counts=True) for r in runs]
    term_of = np.concatenate([k for k, _ in counted]) if n else np.empty(0, np.int64)
    post = np.repeat(np.arange(n, dtype=np.int32), [len(k) for k, _ in counted])
    tf = np.concatenate([c for _, c in counted]).astype(np.float64) if n else np.empty(0)
    order = np.lexsort((post, term_of))
    term_of, post, tf = term_of[order], post[order], tf[order]
    keys, at, df = np.unique(term_of, return_index=True, return_counts=True)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    length = np.array([len(r) for r in runs], np.float64)
    norm = K1 * (1 - B + B * length / max(length.mean() if n else 1, 1))
    impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[post])
    term = np.repeat(np.arange(len(keys)), df)
    need = np.zeros(n)
    by_item = np.lexsort((term_of, post))  # the postings item by item, terms ascending, as ``counted`` has them
    ends = np.cumsum([0, *(len(k) for k, _ in counted)])
    for j, r in enumerate(runs):
        mine = impact[by_item[ends[j] : ends[j + 1]]]
        need[j] = TOLERANCE * _least_score(np.searchsorted(counted[j][0], r), mine, least - 1)
    block = post // BLOCK
    new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1)) if len(post) else np.empty(0, np.int64)
    starts = range(0, n, BLOCK)
    return Index(
        [i for i, _ in kept], [w for _, w in kept], weights, need, np.array([need[b : b + BLOCK].min() for b in starts]), vocabulary, keys,
        np.append(at, len(post)), post, impact, np.maximum.reduceat(impact, at) if n else impact,
        np.append(np.searchsorted(new, at), len(new)), block[new], np.maximum.reduceat(impact, new) if n else impact,
    )


def _least_score(run: np.ndarray, impact: np.ndarray, least: int) -> float:
    """The lowest sum of distinct terms' impacts over all runs of ``least`` successive terms; ``run`` has positions in ``impact``."""
    return min(float(impact[np.unique(run[i : i + least])].sum()) for i in range(len(run) - least + 1))


class _Cursor:
    """One term's postings, walked in the order of the items."""

    __slots__ = ("items", "impact", "peak", "blocks", "block_peak", "i", "now")

    def __init__(self, index: Index, t: int):
        a, b, c, d = index.at[t], index.at[t + 1], index.block_at[t], index.block_at[t + 1]
        self.items, self.impact, self.peak = index.post[a:b].tolist(), index.impact[a:b].tolist(), float(index.peak[t])
        self.blocks, self.block_peak, self.i, self.now = index.blocks[c:d].tolist(), index.block_peak[c:d].tolist(), 0, int(index.post[a])

    def go(self, item: int) -> bool:
        """On to the first posting at or after ``item``; False if there is none."""
        self.i = bisect_left(self.items, item, self.i)
        if self.i == len(self.items):
            return False
        self.now = self.items[self.i]
        return True

    def bound(self, block: int) -> float:
        k = bisect_left(self.blocks, block)
        return self.block_peak[k] if k < len(self.blocks) and self.blocks[k] == block else 0.0


def candidates(page: list[bytes], index: Index) -> list[int]:
    """Positions of all items that the page scores for, by block-max WAND with the items' own thresholds."""
    terms = index.terms(page)
    slack = 1e-9
    if not len(terms) or index.peak[terms].sum() + slack < index.need.min():
        return []
    lowest = float(index.need.min()) - slack
    cursors, hits = [_Cursor(index, t) for t in terms.tolist()], []
    while cursors:
        cursors.sort(key=lambda c: c.now)
        reach = 0.0
        for k, c in enumerate(cursors):
            reach += c.peak
            if reach >= lowest:
                break
        else:
            break  # the terms left can't reach any threshold
        pivot = cursors[k].now
        while k + 1 < len(cursors) and cursors[k + 1].now == pivot:
            k += 1
        block = pivot // BLOCK
        if sum(c.bound(block) for c in cursors[: k + 1]) < index.block_need[block] - slack:
            # no item from the pivot on reaches its threshold before the block ends or another term comes in
            on = (block + 1) * BLOCK if k + 1 == len(cursors) else min((block + 1) * BLOCK, cursors[k + 1].now)
            cursors = [c for j, c in enumerate(cursors) if j > k or c.now >= on or c.go(on)]
            continue
        if cursors[0].now < pivot:
            cursors = [c for c in cursors if c.now >= pivot or c.go(pivot)]
            continue
        score = sum(c.impact[c.i] for c in cursors[: k + 1])
        if score >= index.need[pivot] - slack:
            hits.append(pivot)
        cursors = [c for c in cursors if c.now > pivot or c.go(pivot + 1)]
    return hits


def alignment(at: dict[bytes, list[int]], item: list[bytes], weight: list[float], least: int) -> float:
    """The share of the weight of ``least`` successive item words that the page has in order, at its best.

    ``at`` has the positions of the page's words. A word counts only if a word next to it (or next but one) in the item stands next
    to it on the page as well.
    """
    diagonals = defaultdict(list)
    for q, w in enumerate(item):
        for p in at.get(w, ()):
            diagonals[p - q].append(q)
    points = []
    for d, qs in diagonals.items():
        for k, q in enumerate(qs):
            if (k and q - qs[k - 1] <= 2) or (k + 1 < len(qs) and qs[k + 1] - q <= 2):
                points.append((q + d, q))
    upto = [0.0, *accumulate(weight)]
    whole = np.array(upto)
    whole = whole[least:] - whole[:-least]

    def share(found: Iterable[int]) -> float:
        have = np.zeros(len(item) + 1)
        for q in found:
            have[q + 1] = weight[q]
        sums = np.cumsum(have)
        return float(((sums[least:] - sums[:-least]) / whole).max())

    bound = share({q for _, q in points})  # whatever their order on the page
    if bound < ENOUGH:
        return bound
    points.sort(key=lambda x: (x[1], x[0]))
    best, back, held, top_best = [0.0] * len(points), [-1] * len(points), [0.0] * len(points), 0.0
    done_at: dict[int, tuple[list[int], list[int]]] = {}  # by item position: page positions, and the best point up to each
    j = 0
    while j < len(points):
        q, at_q, tops, before = points[j][1], [], [], []
        for i in range(q - 1, -1, -1):
            cost = LOST * (upto[q] - upto[i + 1])
            if cost >= top_best:  # no chain is worth what lies in between
                break
            if i in done_at:
                before.append((done_at[i], cost))
        while j < len(points) and points[j][1] == q:
            p, score, whence = points[j][0], 0.0, -1
            for (places, leads), cost in before:
                k = bisect_left(places, p) - 1
                if k >= 0 and (s := best[leads[k]] - cost) > score:
                    score, whence = s, leads[k]
            best[j], back[j] = score + weight[q], whence
            held[j] = weight[q] + (held[whence] if whence >= 0 else 0.0)
            at_q.append(p)
            tops.append(tops[-1] if tops and best[tops[-1]] > best[j] else j)
            j += 1
        top_best = max(top_best, best[tops[-1]])
        done_at[q] = at_q, tops
    top, done, least_weight = 0.0, set(), ENOUGH * float(whole.min())
    for j in sorted(range(len(points)), key=lambda j: -best[j]):
        if j in done or held[j] < least_weight:  # part of a better chain, or too little for any stretch
            continue
        found, i = [], j
        while i >= 0:
            done.add(i)
            found.append(points[i][1])
            i = back[i]
        top = max(top, share(found))
    return top


def positions(page: list[bytes]) -> dict[bytes, list[int]]:
    at: dict[bytes, list[int]] = defaultdict(list)
    for p, w in enumerate(page):
        at[w].append(p)
    return at


def leaks_of(text: str | None, index: Index, least: int) -> list[tuple[int, float]]:
    """(item id, share found) of the items that a text reproduces."""
    page = words(text)
    hits = candidates(page, index)
    if not hits:
        return []
    at = positions(page)
    scored = [(index.ids[j], alignment(at, index.items[j], index.weights[j], least)) for j in hits]
    return [(i, s) for i, s in scored if s >= ENOUGH]


def leaks(documents: DataFrame, items: DataFrame, least: int = 25, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, score) of documents (doc_id, text) that reproduce at least ``least`` successive words of an item.

    Items (item_id, text) are read to the driver, at most about ``shard`` of them for one index, which every worker holds. Up to that
    number of items documents are read and cut into words once; more items take one pass over the documents per index.
    Null and empty texts have no leaks; items with fewer than ``least`` words, null ones among them, are never reported. An item
    or document id that is repeated is reported for each of its texts, once per pair.
    """
    spark = documents.sparkSession
    n = items.count()
    parts = max(1, -(-n // shard))
    out = None
    for k in range(parts):
        own = items.where("item_id is not null").where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).select("item_id", "text")
        index = spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in own.collect()], least))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = [(d, i, s) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, s in leaks_of(t, index.value, least)]
                if hits:
                    d, i, s = zip(*hits)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "item_id", "score"])

        found = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
