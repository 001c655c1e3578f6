"""Toxic spans by a linear-chain conditional random field.

Tokens carry one of two tags. Emissions are sums of weights of lexical features (word, prefixes,
suffix), transitions are a 2 x 2 table; forward-backward gives each token's marginal probability of
the toxic tag. Marginals of 0.5 and more make up the offending spans, and a document's score is a
logistic function of its largest marginal and of the expected number of toxic tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import held, ragged, slices, table

#: Tokens that one step of the block-wise scan advances by.
BLOCK = 64
#: Tokens that one forward-backward pass holds; it needs a few dozen numbers for each.
PIECE = 50_000
WEIGHTS = 1 << 18
RUN = re.compile(r"[^\W_]+")
CHUNK = re.compile(r"\S+")
#: Characters of a white-space separated token beyond which its runs of letters or digits are tokens of their own.
LONG = 200


def cuts(token: str) -> list[tuple[int, int]]:
    """Where the tokens of the field stand in a white-space separated one: one, or one for each run if it is long."""
    starts = [m.start() for m in RUN.finditer(token)] if len(token) > LONG else []
    edges = [0, *starts[1:], len(token)]
    return list(zip(edges, edges[1:]))


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of a text's tokens."""
    for m in CHUNK.finditer(text):
        for a, b in cuts(m.group()):
            yield m.start() + a, m.start() + b


def features(token: str) -> list[int]:
    """Hashed features of a token: of each run of letters or digits, the word, prefixes of 3 to 6 and suffixes of 3 and 4."""
    names = set()
    for w in RUN.findall(token.lower()):
        names.add(f"w={w}")
        names.update(f"p{n}={w[:n]}" for n in (3, 4, 5, 6) if len(w) >= n)
        names.update(f"s{n}={w[-n:]}" for n in (3, 4) if len(w) > n)
    return [zlib.crc32(n.encode()) % WEIGHTS for n in sorted(names)]


class Layout:
    """Where the tokens of several documents stand in blocks of BLOCK positions; the last block of a document is padded."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        blocks = -(-lengths // BLOCK)
        self.first = np.cumsum(blocks) - blocks
        self.blocks, self.count = blocks, int(blocks.sum())
        start = np.repeat(self.first * BLOCK - (np.cumsum(lengths) - lengths), lengths)
        self.at = np.arange(int(lengths.sum())) + start  # token -> padded position
        self.real = np.zeros(self.count * BLOCK, bool)
        self.real[self.at] = True

    def spread(self, x: np.ndarray, fill: float) -> np.ndarray:
        """Array [BLOCK, blocks] of one value per token."""
        out = np.full(self.count * BLOCK, fill)
        out[self.at] = x
        return np.ascontiguousarray(out.reshape(self.count, BLOCK).T)

    def gather(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.T).reshape(-1)[self.at]

    def carry(self, m: list[np.ndarray], order: np.ndarray, first: float) -> np.ndarray:
        """The ratio that enters each block, from the blocks' products m; order 1: from the first block on, -1: from the last."""
        enter = np.empty(self.count)
        ratio, left = np.full(len(self.blocks), float(first)), np.arange(len(self.blocks))
        for k in range(int(self.blocks.max(initial=0))):
            left = left[self.blocks[left] > k]
            b = self.first[left] + (k if order > 0 else self.blocks[left] - 1 - k)
            enter[b] = r = ratio[left]
            ratio[left] = (m[2][b] + m[3][b] * r) / (m[0][b] + m[1][b] * r)
        return enter


def scan(layout: Layout, m: list[np.ndarray], order: int, first: float) -> np.ndarray:
    """Apply the 2 x 2 maps m (row-major lists of [BLOCK, blocks]) one after the other to a ratio, within each document.

    Whole blocks are multiplied first, then each document's blocks are chained, then all blocks advance
    side by side; the result holds the ratio after each position.
    """
    steps = range(BLOCK) if order > 0 else range(BLOCK - 1, -1, -1)
    p = [np.ones(layout.count), np.zeros(layout.count), np.zeros(layout.count), np.ones(layout.count)]
    for t in steps:
        a, b, c, d = (x[t] for x in m)
        p = [a * p[0] + b * p[2], a * p[1] + b * p[3], c * p[0] + d * p[2], c * p[1] + d * p[3]]
        scale = 1 / (p[0] + p[1] + p[2] + p[3])
        p = [x * scale for x in p]
    ratio, out = layout.carry(p, order, first), np.empty((BLOCK, layout.count))
    for t in steps:
        a, b, c, d = (x[t] for x in m)
        ratio = (c + d * ratio) / (a + b * ratio)
        out[t] = ratio
    return out


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 for each token, and the expected number of each of the four transitions.

    emission: tag 1 over tag 0, as logarithm; transition[s, s']: logarithm; start: tag 1 over 0 before the first token.
    """
    if not len(emission):
        return np.zeros(0), np.zeros((2, 2))
    layout = Layout(lengths)
    t = np.exp(transition - transition.max())
    u = layout.spread(np.exp(np.clip(emission, -30, 30)), 1.0)
    real = layout.real.reshape(layout.count, BLOCK).T
    first = np.zeros((BLOCK, layout.count), bool)
    first[0, layout.first[layout.blocks > 0]] = True
    on = lambda x, other: np.where(real, x, other)
    # forward: ratio alpha(1) / alpha(0); the first token has no transition before it
    fresh = np.where(first, np.exp(start), 0.0)
    r = scan(layout, [on(np.where(first, 1.0, t[0, 0]), 1.0), on(np.where(first, 0.0, t[1, 0]), 0.0), on(np.where(first, u * fresh, u * t[0, 1]), 0.0), on(np.where(first, 0.0, u * t[1, 1]), 1.0)], 1, 0.0)
    # backward: entering position i from the right gives beta(1) / beta(0) at i - 1
    after = scan(layout, [on(np.full_like(u, t[0, 0]), 1.0), on(u * t[0, 1], 0.0), on(np.full_like(u, t[1, 0]), 0.0), on(u * t[1, 1], 1.0)], -1, 1.0)
    before, flat_u = layout.gather(after), layout.gather(u)
    last = np.cumsum(lengths)[lengths > 0] - 1
    beta = np.ones(len(emission))
    beta[:-1] = before[1:]
    beta[last] = 1.0
    alpha = layout.gather(r)
    marginal = alpha * beta / (1 + alpha * beta)
    inner = np.ones(len(emission), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    pair = [np.full(len(i), t[0, 0]), t[0, 1] * flat_u[i + 1] * beta[i + 1], t[1, 0] * alpha[i], t[1, 1] * alpha[i] * flat_u[i + 1] * beta[i + 1]]
    total = pair[0] + pair[1] + pair[2] + pair[3]
    return marginal, np.array([float((x / total).sum()) for x in pair]).reshape(2, 2)


def parts(lengths: np.ndarray, most: int) -> Iterator[tuple[slice, slice]]:
    """Documents and their tokens, at most `most` tokens at a time unless one document has more."""
    ends, start, done = np.cumsum(lengths), 0, 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(start, stop), slice(done, int(ends[stop - 1]))
        start, done = stop, int(ends[stop - 1])


def summary(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: 1, the log-odds of its largest marginal, log(1 + expected toxic tokens)."""
    out = np.zeros((len(lengths), 3))
    out[:, 0], out[:, 1] = 1, -12
    full = lengths > 0
    if full.any():
        starts = (np.cumsum(lengths) - lengths)[full]
        top = np.clip(np.maximum.reduceat(marginal, starts), 1e-6, 1 - 1e-6)
        out[full, 1] = np.log(top / (1 - top))
        out[full, 2] = np.log1p(np.add.reduceat(np.where(marginal >= 0.05, marginal, 0.0), starts))
    return out


@dataclass
class Tagger:
    """Weights of the field and of the document score."""

    weights: np.ndarray
    transition: np.ndarray
    start: float
    document: np.ndarray
    cache: int = 300_000
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emissions(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.utf8_split_whitespace(texts)
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.cache:
            self.known = {}
        known, weights, values, long = self.known, self.weights, np.empty(len(distinct)), {}
        for k, x in enumerate(distinct):
            v = known.get(x)
            if v is None and len(x) > LONG:
                long[k] = np.array([weights[features(x[a:b])].sum() for a, b in cuts(x)], float)
                v = 0.0
            if v is None:
                v = float(weights[features(x)].sum()) if x else -np.inf
                if len(x) <= 40:
                    known[x] = v
            values[k] = v
        codes = coded.indices.to_numpy(zero_copy_only=False)
        per = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        found = values[codes]
        if (empty := np.isneginf(found)).any():  # splitting leaves an empty token at either end
            per = per - np.bincount(np.repeat(np.arange(len(per)), per)[empty], minlength=len(per))
            found, codes = found[~empty], codes[~empty]
        if long:
            count, first = np.ones(len(distinct), np.int64), np.arange(len(distinct))
            for k, x in long.items():
                count[k], first[k] = len(x), len(values)
                values = np.concatenate([values, x])
            sums = np.concatenate([[0], np.cumsum(count[codes])])
            ends = np.cumsum(per)
            per = sums[ends] - sums[ends - per]
            found = values[ragged(first[codes], count[codes])]
        return found, per

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each token's marginal and each text's number of tokens; PIECE tokens at a time, or one longer text."""
        found, per = self.emissions(texts)
        for d, t in parts(per, PIECE):
            found[t] = forward_backward(found[t], per[d], self.transition, self.start)[0]
        return found, per

    def scores(self, marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(marginal, lengths) @ self.document, -50, 50)))

    def spans(self, text: str, marginal: np.ndarray) -> list[dict]:
        """Offsets (in code points, end exclusive) of runs of toxic tokens."""
        out: list[dict] = []
        if (marginal >= 0.5).any():
            before = False
            for (start, end), p in zip(tokens(text), marginal, strict=True):
                if p >= 0.5 and before:
                    out[-1]["end"], out[-1]["p"] = end, max(out[-1]["p"], float(p))
                elif p >= 0.5:
                    out.append({"start": start, "end": end, "p": float(p)})
                before = p >= 0.5
        return out


class Corpus:
    """Labelled documents as arrays: token codes, documents' lengths, and the features of each distinct token."""

    def __init__(self, texts: list[str | None]):
        index: dict[str, int] = {}
        codes = [np.array([index.setdefault(w, len(index)) for a, b in tokens(t or "") for w in [t[a:b]]], np.int32) for t in texts]
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        lists = [np.array(features(w), np.int32) for w in index]
        self.size = len(lists)
        self.flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(self.size, dtype=np.int32), [len(x) for x in lists])

    def marginals(self, weights: np.ndarray, transition: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
        u = np.bincount(self.row, weights[self.flat], minlength=self.size)
        found = [forward_backward(u[self.codes[t]], self.lengths[d], transition, start) for d, t in parts(self.lengths, PIECE)]
        return np.concatenate([p for p, _ in found]), sum(x for _, x in found)


def weak_labels(corpus: Corpus, toxic: np.ndarray, *, odds: float = 20.0, contexts: int | None = None) -> np.ndarray:
    """Tags (0 or 1) of the tokens of labelled documents.

    A token of a toxic document is tagged if one of its features is `odds` times as frequent in toxic
    documents and stands after at least `contexts` different tokens there (by default one for sixty toxic
    documents, from 5 to 20), so that copies of one document don't make its words toxic.
    """
    contexts = contexts or int(np.clip(toxic.sum() / 60, 5, 20))
    first = np.searchsorted(corpus.row, np.arange(corpus.size))
    size = np.bincount(corpus.row, minlength=corpus.size)
    of = lambda codes: corpus.flat[ragged(first[codes], size[codes])]
    count, ends = np.zeros((2, WEIGHTS)), np.cumsum(corpus.lengths)
    for end, n, y in zip(ends, corpus.lengths, toxic, strict=True):
        count[int(y), np.unique(of(np.unique(corpus.codes[end - n : end])))] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marked = (count[1] > 0) & ((count[1] + 0.5) / n1 > odds * (count[0] + 0.5) / n0)
    word = np.bincount(corpus.row, marked[corpus.flat], minlength=corpus.size) > 0
    bad = np.repeat(toxic > 0, corpus.lengths)
    at = np.flatnonzero(bad & word[corpus.codes])
    before = np.where(np.isin(at, ends - corpus.lengths), -1, corpus.codes[at - 1])
    own = of(corpus.codes[at])
    pairs = np.unique(own.astype(np.int64) << 32 | np.repeat(before, size[corpus.codes[at]]) + 1)
    marked &= np.bincount(pairs >> 32, minlength=WEIGHTS) >= contexts
    word = np.bincount(corpus.row, marked[corpus.flat], minlength=corpus.size) > 0
    return (bad & word[corpus.codes]).astype(float)


def fit(texts: list[str | None], toxic: list[int], *, epochs: int = 16, rate: float = 0.5, penalty: float = 1e-4) -> Tagger:
    """Learn tags from weakly labelled tokens, then the document score from the documents' labels.

    Without documents of both kinds everything scores low.
    """
    y = np.array([int(x == 1) for x in toxic], float)
    tagger = Tagger(np.zeros(WEIGHTS), np.log(np.array([[0.99, 0.01], [0.7, 0.3]])), -4.0, np.array([-3.0, 1.0, 0.0]))
    corpus = Corpus(texts)
    if not len(corpus.codes) or y.min() == y.max():
        tagger.weights, tagger.document = np.full(WEIGHTS, -1.0), np.array([-5.0, 0.0, 0.0])
        return tagger
    tags, n = weak_labels(corpus, y), len(corpus.codes)
    inner = np.ones(n, bool)
    inner[np.cumsum(corpus.lengths)[corpus.lengths > 0] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.bincount((2 * tags[i] + tags[i + 1]).astype(int), minlength=4).reshape(2, 2).astype(float)
    want = np.bincount(corpus.codes, tags, minlength=corpus.size)
    squares, squares_t = np.full(WEIGHTS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(epochs):
        p, pairs = corpus.marginals(tagger.weights, tagger.transition, tagger.start)
        error = want - np.bincount(corpus.codes, p, minlength=corpus.size)
        g = np.bincount(corpus.flat, error[corpus.row], minlength=WEIGHTS) / n - penalty * tagger.weights / n
        gt = (seen - pairs) / n
        squares += g * g
        squares_t += gt * gt
        tagger.weights = tagger.weights + rate * g / np.sqrt(squares)
        tagger.transition = tagger.transition + 0.2 * rate * gt / np.sqrt(squares_t)
    x = summary(corpus.marginals(tagger.weights, tagger.transition, tagger.start)[0], corpus.lengths)
    w = np.zeros(3)
    for _ in range(50):  # Newton steps, with a little shrinkage for separable labels
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - q) - 0.05 * w)
    tagger.document = w
    return tagger


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, most: tuple[int, int] = (2000, 1000)) -> Tagger:
    """A tagger from at most most[0] clean and most[1] toxic documents, none of them held out.

    They are the ones with the smallest hash of doc_id. Labels that are null or of unknown documents are
    skipped; a document with several labels counts as toxic if one says so, and of several texts under one
    doc_id the smallest counts.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = [(x.doc_id, x.toxic) for y in (0, 1) for x in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]).collect()]
    if not chosen:
        return fit([], [])
    small = spark.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")  # sum(most) rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, spans) for each row, over the whole text.

    Null and empty texts get the score of a text without tokens; equal texts get equal scores; rows with a
    null id are scored like others; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # WEIGHTS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity", lambda: None)  # lets other operators' memory go
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = pc.fill_null(batch.column("text"), "")
            marginal, lengths = model.value.marginals(texts)
            found = model.value.scores(marginal, lengths)
            spans: list[list[dict]] = [[] for _ in found]
            ends = np.cumsum(lengths)
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(marginal >= 0.5), "right")):
                spans[k] = model.value.spans(texts[int(k)].as_py(), marginal[ends[k] - lengths[k] : ends[k]])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=["id", "score", "predicted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, spans array<struct<start int, end int, p double>>")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, tagger: Tagger, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose whole text scores under 0.5."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity", lambda: None)
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            keep = model.value.scores(*model.value.marginals(pc.fill_null(batch.column(text_col), ""))) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document; spans are more than the contract asks for and stay."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "spans")
