"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix is the one vocabulary entry at its end that stays apart from the last token of
what it leaves, so a prefix has one token more than the prefix that its last token leaves. Chunks that no
token spans advance together, each distinct one once; their counts are laid one after another into the
counts of a text. How many tokens a cut text has, or how much of it fits a budget, is then looked up and
nothing is encoded again.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import held, ragged, slices, table, tokenizer_path
from labelweave.llm.merges import Merges

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Chunks that a worker remembers, at about 250 bytes each.
REMEMBERED = 400_000
#: Bytes of a chunk up to which chunks advance side by side; longer ones go by themselves, in windows.
LONGEST, WINDOW = 256, 1 << 18
#: Characters of a text beyond which it is worked on in parts.
PART = 4 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
SPACE, LETTER, NUMBER, OTHER, UNSEEN = range(5)


def _rest(n: int) -> int:
    return n & (2**64 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where it prints, else the next one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteModel:
    """A byte-level BPE vocabulary with the tables that counting needs."""

    def __init__(self, data: dict):
        model, before = data["model"], data["pre_tokenizer"]
        odd = [x for x in data["added_tokens"] if x["single_word"] or x["lstrip"] or x["rstrip"]]
        if data["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["type"] != "BPE" or model["ignore_merges"] or model["dropout"] or odd:
            raise ValueError("only byte-level BPE without normalization or added spaces is known")
        letters = byte_letters()
        self.special = sorted((x["content"] for x in data["added_tokens"]), key=lambda t: (-len(t), t))
        tokens = {t: i for t, i in model["vocab"].items() if t not in self.special}
        n = max(model["vocab"].values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(n)
        left, right, made = (np.array([tokens[x] for x in part]) for part in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        if len(np.unique(made)) < len(made):
            raise ValueError("a token has two merges")
        self.merges.rank[made], self.merges.left[made], self.merges.right[made] = np.arange(len(made)), left, right
        order = np.argsort(left * n + right)
        self.merges.pairs, self.merges.pair_rank = (left * n + right)[order], order
        self._reached(made, left, right, [i for t, i in tokens.items() if len(t) == 1], n)
        self._keys({bytes(letters[c] for c in t): i for t, i in tokens.items() if self.reached[i]})

    def _reached(self, made: np.ndarray, left: np.ndarray, right: np.ndarray, single: list[int], n: int) -> None:
        """Tokens that come out when their own bytes are merged: both parts do, and nothing merges across them before."""
        whole = self.merges.apart(left, right, np.arange(len(made)))
        self.reached, known = np.zeros(n, bool), -1
        self.reached[single] = True
        while known != (known := int(self.reached.sum())):
            self.reached[made] = whole & self.reached[left] & self.reached[right]

    def _keys(self, tokens: dict[bytes, int]) -> None:
        """Sorted hashes of the tokens of each length."""
        by: dict[int, list[tuple[int, int]]] = {}
        for t, i in tokens.items():
            h = 0
            for b in t:
                h = _rest(h * MULTIPLIER + b + 1)
            by.setdefault(len(t), []).append((h, i))
        if len(by.get(1, [])) < 256:
            raise ValueError("a byte has no token")
        self.keys = {}
        for size, own in sorted(by.items()):
            own.sort()
            self.keys[size] = np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own])
            if len({h for h, _ in own}) < len(own):
                raise ValueError("two tokens have one hash")
        self.width = max(self.keys)

    def _candidates(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, token) of each reached token in data; at is each byte's place in its chunk, from 1."""
        n = len(data)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, MULTIPLIER, np.uint64)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(MULTIPLIER, -1, 2**64), np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * back[:n], dtype=np.uint64)])
        live, ends, lengths, tokens = np.arange(n), [], [], []
        for size, (keys, ids) in self.keys.items():
            live = live[at[live] >= size]
            if not len(live):
                break
            h = (sums[live + 1] - sums[live + 1 - size]) * power[live]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            ends.append(live[hit]), tokens.append(ids[place[hit]])
            lengths.append(np.full(len(ends[-1]), size))
        return np.concatenate(ends), np.concatenate(lengths), np.concatenate(tokens)

    def prefixes(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of tokens of every prefix of every chunk; data holds the chunks' bytes, one after the other."""
        counts = np.zeros(len(data), np.int32)
        first = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > LONGEST):
            counts[first[k] : first[k] + sizes[k]] = self._alone(data[first[k] : first[k] + sizes[k]])
        short = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        if len(short):
            where = ragged(first[short], sizes[short])
            counts[where] = self._together(data[where], sizes[short])
        return counts

    def _together(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        end, length, token = self._candidates(data, at)
        order = np.argsort(at[end], kind="stable")
        end, length, token = end[order], length[order], token[order]
        cut = np.searchsorted(at[end], np.arange(1, int(sizes.max()) + 2))
        last, counts = np.full(len(data), -1), np.zeros(len(data), np.int32)
        for i in range(len(cut) - 1):
            e, n, t = end[cut[i] : cut[i + 1]], length[cut[i] : cut[i + 1]], token[cut[i] : cut[i + 1]]
            whole = n == i + 1
            before = np.where(whole, e, e - n)
            fits = np.flatnonzero(whole | self.merges.apart(np.where(whole, -1, last[before]), t))
            last[e[fits]] = t[fits]
            counts[e[fits]] = np.where(whole[fits], 0, counts[before[fits]]) + 1
        return counts

    def _alone(self, data: np.ndarray) -> np.ndarray:
        """One long chunk, in windows that overlap by the longest token."""
        n, known = len(data), {}
        counts, last = np.zeros(n, np.int32), np.full(n, -1)
        for start in range(0, n, WINDOW):
            low, high = max(0, start - self.width), min(n, start + WINDOW)
            end, length, token = self._candidates(data[low:high], np.arange(low + 1, high + 1) if low == 0 else np.arange(1, high - low + 1))
            end += low
            keep = end >= start
            order = np.argsort(end[keep], kind="stable")
            rows = zip(*(x[keep][order].tolist() for x in (end, length, token)), strict=True)
            for e, k, t in rows:
                if k == e + 1:
                    last[e], counts[e] = t, 1
                elif (fits := known.get(pair := (int(last[e - k]), t))) is not False:
                    if fits is None:
                        fits = known[pair] = bool(self.merges.apart(np.array([pair[0]]), np.array([t]))[0])
                    if fits:
                        last[e], counts[e] = t, counts[e - k] + 1
        return counts


class Chunks:
    """Where texts are cut before tokens are looked for, with the kinds of characters as the library has them."""

    def __init__(self, tokenizer):
        self.cut_of, self.kind = tokenizer.pre_tokenizer.pre_tokenize_str, np.full(0x110000, UNSEEN, np.uint8)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        out = self.kind[points]
        if (new := out == UNSEEN).any():
            for c in np.unique(points[new]).tolist():
                joined = [kind for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.cut_of(lead + chr(c))) == 1]
                self.kind[c] = joined[0] if joined else SPACE
            out = self.kind[points]
        return out

    def starts(self, points: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, run_start, run_end, middle) for characters with `fresh` where a part begins that is cut for itself.

        start marks the first characters of chunks. Blanks from run_start to run_end (exclusive) are one chunk as
        long as nothing follows and several afterwards; middle is the second letter of a contraction, which is a
        chunk for itself as long as the third is missing.
        """
        kind, n = self.kinds(points), len(points)
        run = fresh.copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        word = np.flatnonzero(run & ~fresh & (kind != SPACE))
        word = word[kind[word - 1] == SPACE]
        start[word - 1] = True
        start[word[points[word - 1] == 0x20]] = False
        runs = np.flatnonzero(run)
        first = runs[np.searchsorted(runs, word, "left") - 1]
        long = word - first > 1
        near = lambda i, k: np.where(i + k < n, points[np.minimum(i + k, n - 1)], 0) * ~fresh[np.minimum(i + k, n - 1)]
        mark = np.flatnonzero(start & (points == ord("'")))
        one, two = near(mark, 1), near(mark, 2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        three = np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | three] + 1] = False
        after = np.concatenate([mark[short] + 2, mark[three] + 3])
        start[after[after < n]] = start[after[after < n]] | (kind[after[after < n]] == LETTER)
        return start, first[long], word[long], mark[three] + 1


class PrefixCounter:
    """Token counts at every prefix of texts; chunks are remembered, up to `cache` of them, which changes no result."""

    def __init__(self, path: str, cache: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.model = ByteModel(json.load(f))
        self.chunks, self.cache = Chunks(Tokenizer.from_file(path)), cache
        self.special = re.compile("|".join(map(re.escape, self.model.special))) if self.model.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.used = np.zeros(1 << 18, np.int32), 0
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)

    def _learn(self, chunks: pa.Array, names: list[str]) -> None:
        """Remember the counts at the ends of all characters of new chunks."""
        for low in range(0, len(names), 50_000):
            part = chunks.slice(low, 50_000)
            sizes = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer("".join(names[low : low + 50_000]).encode(), np.uint8)
            counts = self.model.prefixes(data, sizes)
            full = np.append((data[1:] & 0xC0) != 0x80, True)
            counts, chars = counts[full], np.add.reduceat(full, np.cumsum(sizes) - sizes, dtype=np.int64)
            n = len(self.known)
            while self.used + len(counts) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            while n + len(part) > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.counts[self.used : self.used + len(counts)] = counts
            self.start[n : n + len(part)], self.length[n : n + len(part)] = self.used + np.cumsum(chars) - chars, chars
            self.known.update(zip(names[low : low + 50_000], range(n, n + len(part)), strict=True))
            self.used += len(counts)

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The numbers under which chunks are remembered."""
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [i for i, x in enumerate(names) if x not in self.known]:
            self._learn(coded.dictionary.take(pa.array(new, pa.int64())), [names[i] for i in new])
        of = np.fromiter((self.known[x] for x in names), np.int64, len(names))
        return of[coded.indices.to_numpy(zero_copy_only=False)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts at all characters' ends, one text after the other, and each text's number of characters."""
        if len(self.known) > self.cache:
            self.forget()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), sizes
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        fresh, own = np.zeros(len(points), bool), np.zeros(len(points), bool)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        fresh[starts] = True
        found = [(first + m.start(), first + m.end()) for first, text in zip(starts.tolist(), (t for t in texts if t), strict=True) for m in self.special.finditer(text)] if self.special and any(s in whole for s in self.model.special) else []
        for a, b in found:
            fresh[a], own[a:b] = True, True
            fresh[b : b + 1] = True
        start, run_start, run_end, middle = self.chunks.starts(points, fresh)
        start[own] = False
        start[[a for a, _ in found]] = True
        begins = np.flatnonzero(start)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = np.frombuffer(whole.encode(), np.uint8)
        chars = np.diff(np.append(begins, len(points)))
        number = self._numbers(_strings(data, np.append(place[begins], place[-1])))
        total = self.counts[self.start[number] + self.length[number] - 1].astype(np.int64)
        special = own[begins]
        total[special] = 1
        before = np.cumsum(total) - total
        text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
        before -= before[np.searchsorted(begins, starts)][text[begins]]
        out = self.counts[ragged(self.start[number], chars)] + np.repeat(before, chars)
        keep = ~own[run_start]
        run_start, run_end = run_start[keep], run_end[keep]
        if len(run_start):
            size = place[run_end] - place[run_start]
            blank = self._numbers(_strings(data[ragged(place[run_start], size)], np.concatenate([[0], np.cumsum(size)])))
            out[run_end - 1] = before[np.searchsorted(begins, run_start)] + self.counts[self.start[blank] + self.length[blank] - 1]
        middle = middle[~own[middle]]
        out[middle] = before[np.searchsorted(begins, middle, "right") - 1] + 2
        firsts = set(starts.tolist())
        for a, b in found:
            # prefixes that end within a special string: it is ordinary text still, and may go on with the chunk before it
            k = int(np.searchsorted(begins, a))
            joined = a not in firsts and not own[a - 1]
            low = int(begins[k - 1]) if joined else a
            flat, lengths = self([whole[low:end] for end in range(a + 1, b)])
            out[a : b - 1] = before[k - 1 if joined else k] + flat[np.cumsum(lengths) - 1]
            out[b - 1] = before[k] + 1
        return out.astype(np.int32), sizes


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


#: A letter, digit or underscore before a blank: a chunk always ends between them, and neither side depends on the other.
SEAM = re.compile(r"\w(?= )")


def parts_of(text: str, most: int = PART) -> list[str]:
    """A long text in parts whose counts add up; a stretch without a seam stays whole."""
    out, start = [], 0
    while len(text) - start > most and (seam := SEAM.search(text, start + most)):
        out.append(text[start : seam.end()])
        start = seam.end()
    return [*out, text[start:]]


def _counted(counter: PrefixCounter, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The counter's result for texts of any length."""
    if len(texts) > 1 or len(texts[0]) <= PART:
        return counter(texts)
    out, done = [], 0
    for part in parts_of(texts[0]):
        flat, _ = counter([part])
        out.append(flat + np.int32(done))
        done = int(out[-1][-1])
    return np.concatenate(out), np.array([len(texts[0])], np.int64)


def _run(docs: DataFrame, id_col: str, text_col: str, path: str, remembered: int, schema: str, make) -> DataFrame:
    """`make` turns a slice's ids, byte lengths, counts and numbers of characters into a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(f"tokens {path} {remembered}", lambda: PrefixCounter(path, remembered))
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = pc.fill_null(batch.column("text"), "")
            flat, sizes = _counted(counter, texts.to_pylist())
            yield make(batch.column("id"), pc.binary_length(texts).cast(pa.int64()), flat, sizes)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def _ends(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, np.append(flat, 0)[ends - 1], 0).astype(np.int64)


def prefix_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """(id, n_bytes, n_chars, n_tokens, counts) for each row: counts[i] is the number of tokens of the text's first i + 1 characters alone.

    To be written once and asked by `tokens_of_prefix` and `longest_prefix`. A null text counts as empty and has
    no counts; rows with equal or null ids stand each for itself; an empty table gives no rows; other columns are
    not read. Special strings inside texts are one token, as the library's default has it, once they are complete.
    `vocabulary` is the path of a tokenizer file on every node; `remembered` bounds a worker's memory only.
    """

    def make(ids, n_bytes, flat, sizes):
        counts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(sizes), pa.array(_ends(flat, sizes)), counts], names=["id", "n_bytes", "n_chars", "n_tokens", "counts"])

    return _run(docs, id_col, text_col, vocabulary or tokenizer_path(VOCABULARY), remembered, "n_bytes bigint, n_chars bigint, n_tokens bigint, counts array<int>", make)


def tokens_of_prefix(chars: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first `chars` characters (all, if there are fewer; none for 0 or less), from a stored table."""
    n = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts))
    return F.when(n > 0, F.get(counts, (n - 1).cast("int"))).otherwise(0)


def longest_prefix(budget: Column | int, counts: str = "counts") -> Column:
    """Characters of the longest prefix that has at most `budget` tokens, from a stored table.

    A longer prefix may have fewer tokens than a shorter one, so the last that fits is looked for, not the first that doesn't.
    """
    most = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.array_position(F.transform(F.reverse(counts), lambda c: c <= most), True)
    return F.when(fits > 0, F.size(counts) - fits + 1).otherwise(0).cast("bigint")


def token_counts(docs: DataFrame, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, kept_chars) for each row, from the counts at every prefix, which are not kept.

    kept_chars is the length of the longest prefix of at most `limit` tokens. Cases are as in `prefix_table`.
    """

    def make(ids, n_bytes, flat, sizes):
        total = _ends(flat, sizes)
        place = ragged(np.ones(len(sizes), np.int64), sizes)
        kept = np.zeros(len(sizes), np.int64)
        if (own := sizes > 0).any():
            kept[own] = np.maximum.reduceat(np.where(flat <= limit, place, 0), (np.cumsum(sizes) - sizes)[own])
        return pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(total), pa.array(total > limit), pa.array(kept)], names=["id", "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    return _run(docs, id_col, text_col, vocabulary or tokenizer_path(VOCABULARY), remembered, "n_bytes bigint, n_tokens bigint, over_limit boolean, kept_chars bigint", make)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and how much of each a budget of 1,024 tokens holds."""
    return token_counts(table(spark, sf_dir, "documents"))
