"""Abusive, hateful or sexual content (problem 10): nearest labelled examples.

Texts are cut into passages, as one passage is enough to make a text abusive. Disguised spellings
are undone, passages become TF-IDF vectors of words, word pairs and stems (characters for
Japanese and Chinese), with frequencies over all documents. An inverted index of the passages of a
bounded sample of labelled documents, with the largest weight of every term in every block, finds the
exact nearest neighbours by cosine: a block's bound is the sum of those weights, and the blocks of the largest
bounds are read, few at a time, until no bound reaches the worst neighbour. Similarity-weighted votes of the neighbours give a passage's score, the
passage with the largest score that of the document, and a logistic fit on left-out votes calibrates it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skeleton import skeleton

#: Hashed term space, neighbours that vote, least similarity of a neighbour, passages in an index block.
BITS, NEIGHBOURS, LEAST_SIMILARITY, BLOCK = 18, 12, 0.2, 32

#: Blocks that are read at a time for each text, in order of their bounds.
AT_A_TIME = 12

#: Texts that are looked up side by side.
TOGETHER = 32

#: Bounds of the labelled sample: documents (chosen by a hash of the id) and distinct passages of them.
SAMPLE_DOCUMENTS, SAMPLE_PASSAGES = 8000, 60_000

#: A document is reported from this calibrated score on.
THRESHOLD = 0.5

#: A passage of more words is also read in stretches of so many, as abuse may hide in a run-on one whose other words are clean.
WINDOW = 8

#: Weight and value of the prior in a vote.
PRIOR_WEIGHT, PRIOR = 1.0, 0.05

#: Suspicion of a passage that no other labelled document resembles, in a document called toxic.
UNSEEN = 0.3

#: Stands for each hidden letter of a masked word.
MASK = "ˣ"

# Signs that stand for letters in disguised words.
_SIGNS = str.maketrans("01345789@$!€+|", "oieastbgasietl")

_EDGE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？!?])|[\r\n]+|[^\w\s.,;:!?…'’‘\"“”«»()&%/+*=°§#@$€£¿¡、。「」・ー〜！？_|{}\[\]<>~^`\\-]+")
_JOINT = re.compile(r"(?<=[^\W\dA-ZÀ-ÞА-ЯЁ_])\s+(?=[A-ZÀ-ÞА-ЯЁ][^\W\dA-ZÀ-ÞА-ЯЁ_]*\s+[^\W\dA-ZÀ-ÞА-ЯЁ_])")
_STAMP = re.compile(r"\[?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\]?")
_TAGS = re.compile(r"(?<!\w)[@#][\w.&]+|https?://\S+")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*·/])[^\W\d_])(?:\1[^\W\d_])+\1?(?![^\W_])")
_RUN = re.compile(r"([^\W\d_ˣ])\1{2,}")
_MASKED = re.compile(r"(?<![\w*])(\w)([*_•]{2,})(\w?)(?!\w)")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DISGUISED = re.compile(r"(?<![\w])(?=[^\s]*[a-zа-яё])(?=[^\s]*[0-9@$!€+|])[\w@$!€+|]+(?=[\s,.;:?'\"“”»)]|!*(?:\s|$)|$)")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_CODE = re.compile(r"^(?:[\d:.,%x/-]+[a-z%]{0,3}|[a-z]{1,2}\d[\w-]*|\w*\d\w*[-_]\w+)$")


def plain(text: str) -> str:
    """Lower case without look-alikes, invisible characters, accents, spacing-out, stretched letters and signs for letters."""
    out = skeleton(text.lower()) or ""
    out = "".join(c for c in unicodedata.normalize("NFKD", out.replace(MASK, "\ue001")) if not unicodedata.combining(c) or c in "\u3099\u309a")
    out = unicodedata.normalize("NFC", out).replace("\ue001", MASK)
    if _SPACED.search(out):
        out = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·/]", "", m.group()) + " ", out)
    out = _RUN.sub(r"\1", out)
    return _DISGUISED.sub(lambda m: m.group() if _CODE.match(m.group()) else m.group().rstrip("!").translate(_SIGNS), out)


def passages(text: str | None) -> list[tuple[str, str]]:
    """``(source, plain)`` of the passages of a text, in order; those without a word are left out. Null and blank texts have none."""
    if not text:
        return []
    out = []
    cleaned = _STAMP.sub(" ", text)
    if "\u200b" in cleaned or "\u2060" in cleaned or "\u00ad" in cleaned:
        cleaned = re.sub("[\u200b\u2060\u00ad\u200c\ufeff]", "", cleaned)
    for part in _EDGE.split(_TAGS.sub(" ", cleaned)):
        part = part.strip()
        if len(part) > 1:
            p = plain(_MASKED.sub(lambda m: m[1] + MASK * len(m[2]) + m[3], part))
            words = [w for w in _TOKEN.findall(p) if not w[0].isdigit()]
            if words:
                out.append((part, " ".join(words)))
    return out


def run_on(part: str) -> list[str]:
    """Plain pieces of a passage that a small-to-capital change of words (or a blank in Japanese or Chinese) splits, where writers left out the full stop; none if there is no such change."""
    pieces = [p for p in (part.split() if _CJK.search(part) else _JOINT.split(part)) if p]
    if len(pieces) < 2:
        return []
    words = ([w for w in _TOKEN.findall(plain(p)) if not w[0].isdigit()] for p in pieces)
    return [" ".join(w) for w in words if len(w) >= 3 or w and _CJK.search(w[0])]


def windows(words: str) -> list[str]:
    """Overlapping stretches of WINDOW words of a longer passage."""
    tokens = words.split(" ")
    return [" ".join(tokens[i : i + WINDOW]) for i in range(0, max(0, len(tokens) - WINDOW // 2), WINDOW // 2)] if len(tokens) > WINDOW else []


def terms(words: str) -> list[int]:
    """Hashed terms of a plain passage: words, pairs of words, stems of longer words; pairs and triples of characters for Japanese and Chinese."""
    out = []
    tokens = words.split(" ")
    for i, w in enumerate(tokens):
        if _CJK.search(w):
            out += [f"c{w[j : j + n]}" for n in (1, 2, 3) for j in range(len(w) - n + 1) if MASK not in w[j : j + n]]
            continue
        if MASK in w:  # what it may stand for is looked up in the index
            continue
        out.append(f"w{w}")
        if len(w) > 5:
            out.append(f"s{w[:5]}")
        if i:
            out.append(f"b{tokens[i - 1]} {w}")
    return [zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in out]


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over all documents, and their number; one count per term reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    n += 1
                    seen = {x for _, p in passages(t) for x in terms(p)}
                    total[np.fromiter(seen, np.int64, len(seen))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])

    got = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``first`` and have ``size`` members, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _along(near: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """All passages, each followed by its nearest one that is not placed yet, and so on from there."""
    out: list[int] = []
    placed = np.zeros(len(near), bool)
    for start in range(len(near)):
        todo = [start]
        while todo:
            i = todo.pop()
            if not placed[i]:
                placed[i] = True
                out.append(i)
                todo += near[i][0][::-1].tolist()  # the nearest comes off first
    return out


@dataclass
class Index:
    """Block-max inverted index of labelled passages, with votes."""

    texts: list[str]
    idf: np.ndarray
    votes: np.ndarray  # labelled documents that have the passage
    toxic: np.ndarray  # the sum of their labels
    slope: float = 8.0
    centre: float = 0.5
    segment: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1, np.int64))  # where a term's segments begin in the next two
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the block of each segment, ascending within a term
    largest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # the largest weight of the term in the block
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where the segment's postings begin in the next two
    within: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # place of each posting's passage in the block
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic_end: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.int64))  # where a term's segments of toxic blocks end
    blocks: int = 0
    toxic_blocks: int = 0  # blocks with toxic votes; they are the first ones
    read: int = 0  # blocks read so far
    shapes: dict[tuple[int, str], list[str]] = field(default_factory=dict)  # (length, first letter) -> words

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms and their weights, scaled to length 1."""
        if MASK in text:
            text = " ".join(self._unmasked(w) if MASK in w else w for w in text.split(" "))
        t, c = np.unique(np.array(terms(text), np.int64), return_counts=True)
        w = c * self.idf[t]
        return t, w / max(np.linalg.norm(w), 1e-9)

    def _unmasked(self, word: str) -> str:
        """The word of the index that a masked one stands for: that of most toxic votes among those of its length and letters; the word itself if there is none."""
        pattern = re.compile(word.replace(MASK, "."))
        return next((w for w in self.shapes.get((len(word), word[0]), ()) if pattern.fullmatch(w)), word)

    def build(self, near: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Index:
        """Passages with toxic votes come first; in both parts similar passages share blocks.

        They are sorted by the terms that weigh most and are shared most or, if the neighbours ``near`` of
        every passage are known already, along these: from each passage on to its nearest one not yet placed.
        """
        said: dict[str, float] = defaultdict(float)
        for x, n in zip(self.texts, self.toxic, strict=True):
            for w in set(x.split(" ")):
                if MASK not in w:
                    said[w] += float(n)
        self.shapes = {}
        for w in sorted(said, key=lambda w: (-said[w], w)):
            self.shapes.setdefault((len(w), w[0]), []).append(w)
        vectors = [self.vector(x) for x in self.texts]
        if near is None:
            shared = np.log1p(np.bincount(np.concatenate([t for t, _ in vectors]), minlength=1 << BITS) - 0.99) if vectors else np.zeros(0)
            order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1] * shared[vectors[i][0]], kind="stable")[:3]].tolist(), self.texts[i]))
        else:
            order = _along(near)
        order.sort(key=lambda i: not self.toxic[i])  # stable
        self.texts, vectors = [self.texts[i] for i in order], [vectors[i] for i in order]
        self.votes, self.toxic = self.votes[order], self.toxic[order]
        n = len(vectors)
        self.blocks, self.toxic_blocks = -(-n // BLOCK), -(-int((self.toxic > 0).sum()) // BLOCK)
        term = np.concatenate([t for t, _ in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if n else np.zeros(0)
        row = np.repeat(np.arange(n), [len(t) for t, _ in vectors]) if n else np.zeros(0, np.int64)
        by = np.lexsort((row, term))
        term, self.weight, row = term[by], weight[by], row[by]
        block = row // BLOCK
        starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.first = np.append(starts, len(term))
        self.block = block[starts]
        self.largest = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.within = row % BLOCK
        self.segment = np.searchsorted(term[starts], np.arange((1 << BITS) + 1))
        self.toxic_end = self.segment[:-1] + np.bincount(term[starts][self.block < self.toxic_blocks], minlength=1 << BITS)
        return self

    def nearest(self, texts: list[str], k: int = NEIGHBOURS, toxic: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every text the exact ``k`` nearest passages with a cosine of at least LEAST_SIMILARITY, best first, ties by place; with ``toxic`` only those of blocks with toxic votes.

        No passage is more similar than its block's bound. A text's blocks are read in order of their bounds,
        AT_A_TIME together, until none that is left can reach its worst neighbour. TOGETHER texts go side by side.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(texts), TOGETHER):
            out += self._nearest(texts[i : i + TOGETHER], k, toxic)
        return out

    def most(self, texts: list[str]) -> np.ndarray:
        """The largest vote each text can get: that of its nearest toxic passages alone, as others only lower it and those that others displace are fewer."""
        sums = [float(sims**2 @ self.toxic[ids]) for ids, sims in self.nearest(texts, toxic=True)]
        return np.array([(x + PRIOR_WEIGHT * PRIOR) / (x + PRIOR_WEIGHT) for x in sums])

    def _nearest(self, texts: list[str], k: int, toxic: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        m, blocks = len(texts), self.toxic_blocks if toxic else self.blocks
        if not blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        vectors = [self.vector(x) for x in texts]
        term = np.concatenate([t for t, _ in vectors])
        a = self.segment[term]
        n = (self.toxic_end[term] if toxic else self.segment[term + 1]) - a
        of = np.repeat(np.arange(m), [len(t) for t, _ in vectors])
        at, each = _ranges(a, n), np.repeat(np.concatenate([w for _, w in vectors]), n)
        key = np.repeat(of * blocks, n) + self.block[at]  # (text, block) of every segment
        bounds = np.bincount(key, self.largest[at] * each, m * blocks).reshape(m, blocks)
        worst = np.full(m, LEAST_SIMILARITY)
        left = bounds >= LEAST_SIMILARITY - 1e-9
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        while left.any():
            inside = left.ravel()[key]
            at, each, key = at[inside], each[inside], key[inside]
            now = left.copy()
            if blocks > AT_A_TIME:
                held = np.where(left, bounds, 0.0)
                now &= held >= np.partition(held, blocks - AT_A_TIME, axis=1)[:, blocks - AT_A_TIME, None]
            pairs = np.flatnonzero(now)
            self.read += len(pairs)
            slot = np.full(m * blocks, -1)
            slot[pairs] = np.arange(len(pairs)) * BLOCK
            chosen = np.flatnonzero(slot[key] >= 0)
            first = self.first[at[chosen]]
            size = self.first[at[chosen] + 1] - first
            postings = _ranges(first, size)
            sims = np.bincount(np.repeat(slot[key[chosen]], size) + self.within[postings], self.weight[postings] * np.repeat(each[chosen], size), len(pairs) * BLOCK)
            near = np.flatnonzero(sims >= LEAST_SIMILARITY - 1e-9)
            pair = pairs[near // BLOCK]
            found = tuple(np.append(x, y) for x, y in zip(found, (pair // blocks, pair % blocks * BLOCK + near % BLOCK, sims[near]), strict=True))
            order = np.lexsort((found[1], -found[2], found[0]))
            found = tuple(x[order] for x in found)
            begins = np.searchsorted(found[0], np.arange(m + 1))
            rank = np.arange(len(found[0])) - begins[found[0]]
            found = tuple(x[rank < k] for x in found)
            begins = np.searchsorted(found[0], np.arange(m + 1))
            full = np.flatnonzero(np.diff(begins) == k)
            worst[full] = found[2][begins[full + 1] - 1]
            left &= ~now & (bounds >= worst[:, None] - 1e-9)
        begins = np.searchsorted(found[0], np.arange(m + 1))
        return [(found[1][i:j], found[2][i:j]) for i, j in zip(begins[:-1], begins[1:], strict=True)]

    def vote(self, ids: np.ndarray, sims: np.ndarray, votes: np.ndarray | None = None, toxic: np.ndarray | None = None) -> float:
        """Share of toxic votes, each weighted by its squared similarity."""
        n, s = (self.votes[ids], self.toxic[ids]) if votes is None else (votes, toxic)
        w = sims**2
        return float((w @ s + PRIOR_WEIGHT * PRIOR) / (w @ n + PRIOR_WEIGHT))

    def calibrated(self, raw: float) -> float:
        return float(1.0 / (1.0 + np.exp(-self.slope * (raw - self.centre))))


def fit(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS, most: int = SAMPLE_PASSAGES) -> Index:
    """An index from ``doc_id, text`` and ``doc_id, toxic`` (opinions; the mean of a document's opinions is its label).

    A document's label says nothing about which passage earned it. So each passage is first scored with
    its own document left out; in a document called toxic only the passages that come near its best one
    keep the label.
    """
    frequencies, n_docs = document_frequencies(docs, "text")
    mean = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, y, p) for i, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in dict.fromkeys(p for _, p in passages(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "label", "passage"])

    cuts = docs.join(F.broadcast(mean), "doc_id").select("doc_id", "label", "text").mapInArrow(cut, "doc_id long, label double, passage string")
    rows = cuts.orderBy(F.xxhash64("passage"), "passage", "doc_id").limit(most).collect()
    by_doc: dict[int, list[int]] = defaultdict(list)
    label: dict[int, float] = {}
    place: dict[str, int] = {}
    for r in rows:
        by_doc[r.doc_id].append(place.setdefault(r.passage, len(place)))
        label[r.doc_id] = float(r.label >= 0.5)
    votes, toxic = np.zeros(len(place)), np.zeros(len(place))
    for d, ps in by_doc.items():
        votes[ps] += 1
        toxic[ps] += label[d]
    index = Index(list(place), np.log((1.0 + n_docs) / (1.0 + frequencies)) + 1.0, votes, toxic).build()
    place = {t: i for i, t in enumerate(index.texts)}
    by_doc = {d: [place[r] for r in ps] for d, ps in _passages_of(rows).items()}
    near = index.nearest(index.texts)

    def left_out(i: int, y: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, sims = near[i]
        own = ids == i
        return ids, sims, index.votes[ids] - own, index.toxic[ids] - own * y

    def suspicion(i: int, y: float, base: float) -> float:
        """By how much the passage's toxic votes exceed what any passage would get; UNSEEN where nothing resembles it."""
        _, sims, n, s = left_out(i, y)
        w = sims**2
        rate = (w @ s + PRIOR_WEIGHT * (base + UNSEEN * (1 - base))) / (w @ n + PRIOR_WEIGHT)
        return (rate - base) / max(1 - base, 1e-9)

    kept = {(d, i): label[d] for d, ps in by_doc.items() for i in ps}
    base = float(np.mean([label[d] for d in by_doc])) if by_doc else 0.0
    for _ in range(3):
        chosen: dict[tuple[int, int], float] = {}
        for d, ps in by_doc.items():
            if label[d]:
                now = {i: suspicion(i, kept.get((d, i), 0.0), base) for i in ps}
                best = max(now.values())
                chosen |= {(d, i): 1.0 for i, x in now.items() if x >= 0.85 * best or x == best}
        kept = chosen
        index.toxic = np.zeros(len(index.texts))
        for _, i in kept:
            index.toxic[i] += 1.0
        base = float(index.toxic.sum() / max(index.votes.sum(), 1.0))
    raw = np.array([max(index.vote(*left_out(i, kept.get((d, i), 0.0))) for i in ps) for d, ps in by_doc.items()])
    index.slope, index.centre = _logistic(raw, np.array([label[d] for d in by_doc]))
    return index.build(near)  # the blocks follow the votes that are left, and the neighbours


def _passages_of(rows) -> dict[int, list[str]]:
    out: dict[int, list[str]] = defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r.passage)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Slope and centre of a logistic curve, by gradient descent with a slight pull to the defaults."""
    if len(set(y.tolist())) < 2:
        return 8.0, 0.5
    a, b = 8.0, -4.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(a * x + b)))
        g = p - y
        a -= 2.0 * ((g @ x) / len(x) + 1e-3 * (a - 8.0))
        b -= 2.0 * (g.mean() + 1e-3 * (b + 4.0))
    a = max(a, 1.0)
    return a, min(0.9, max(0.1, -b / a))


SCORE = "doc_id long, source string, score double, passage string, neighbour string, similarity double"


def score_documents(docs: DataFrame, index: Index, least: float | None = None) -> DataFrame:
    """``doc_id, source, score, passage, neighbour, similarity`` of every document of ``doc_id, source, text``.

    ``passage`` is the one with the largest score, ``neighbour`` the labelled passage nearest to it. Documents
    without a passage (null, empty, blank) score 0 without evidence. Whole texts are read. With ``least`` only the documents that
    score at least so much come out; these, their scores and evidence are the same, but passages whose largest possible
    vote (:meth:`Index.most`) stays below it are not looked up further.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by SAMPLE_PASSAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        memo: dict[str, tuple[float, int, float]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, sources, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
                read = [[(raw, [p, *run_on(raw), *windows(p)]) for raw, p in passages(t)] for t in texts]
                if len(memo) > 200_000:
                    memo.clear()
                new = list(dict.fromkeys(p for parts in read for _, ps in parts for p in ps if p not in memo))
                if least is not None:
                    reach = [ix.calibrated(x) >= least for x in ix.most(new)]
                    memo |= {p: (-1.0, -1, 0.0) for p, r in zip(new, reach, strict=True) if not r}
                    new = [p for p, r in zip(new, reach, strict=True) if r]
                for p, (near, sims) in zip(new, ix.nearest(new), strict=True):
                    memo[p] = (ix.vote(near, sims), int(near[0]) if len(near) else -1, float(sims[0]) if len(near) else 0.0)
                out: list[tuple] = []
                for i, source, parts in zip(ids, sources, read, strict=True):
                    best, where = None, None
                    for raw, ps in parts:
                        s = max([memo[p] for p in ps], key=lambda x: x[0])
                        if best is None or s[0] > best[0]:
                            best, where = s, raw
                    row = (i, source, ix.calibrated(best[0]), where, ix.texts[best[1]] if best[1] >= 0 else None, best[2]) if best else (i, source, 0.0, None, None, None)
                    if least is None or best and row[2] >= least:
                        out.append(row)
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], [x.split()[0] for x in SCORE.split(", ")])

    return docs.select("doc_id", "source", "text").mapInArrow(run, SCORE)


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, n_documents, n_toxic, rate, mean_score`` per source, letter case aside; a null source is 'unknown'."""
    source = F.coalesce(F.lower(F.trim("source")), F.lit("unknown"))
    return scored.groupBy(source.alias("source")).agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("score") >= threshold).alias("n_toxic"), (F.count_if(F.col("score") >= threshold) / F.count("*")).alias("rate"), F.avg("score").alias("mean_score")
    )
