"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / max_length) pieces of max_length and one piece for each bit
set in the rest, longest first. Every piece is a sequence of its own and sequences of equal length
form a bucket, so a training batch drawn from one bucket needs no padding and no sequence crosses
documents.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import held, ragged, slices, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAX_LENGTH = 4096
#: Words that a worker remembers, at about 250 bytes each.
REMEMBERED = 800_000
#: How the vocabulary normalizes and cuts texts; `words` cuts no chunk of a text for another one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SPACE, LETTER, DIGIT, MARK = range(4)
#: Kinds of bytes, and lower case. Bytes beyond ASCII count as letters; chunks where they are others stay whole.
KIND = np.array([SPACE if k in b"\t\n\v\f\r " else DIGIT if chr(k) in "0123456789" else LETTER if k >= 128 or chr(k).isalpha() else MARK for k in range(256)], np.uint8)
LOWER = np.array([k + 32 if 65 <= k <= 90 else k for k in range(256)], np.uint8)


def words(texts: pa.Array, cut: bool) -> tuple[pa.Array, np.ndarray]:
    """Words that can be encoded apart, one text's after the other's, and each text's number of them.

    Texts are divided at ASCII white space, and with `cut` these chunks into what the pre-tokenizer makes of
    them, in lower case: runs of letters, contractions, runs of marks. A chunk stays whole, as it is, if it
    has a character beyond ASCII and Latin-1's letters (it may compose with others), a digit (each would be
    a word) or what special strings begin with.
    """
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    rows = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if data else np.zeros(0, np.uint8)
    rows, n = rows - rows[0], len(raw)
    kind, first = KIND[raw], np.zeros(n + 4, bool)
    first[rows] = True
    inside = kind != SPACE
    chunk, low = inside.copy(), raw
    chunk[1:] &= ~inside[:-1] | first[1:n]
    start = chunk
    if cut:
        start, low, after = inside.copy(), LOWER[raw], np.zeros(n + 3, np.uint8)
        start[1:] &= (kind[1:] != kind[:-1]) | first[1:n]
        after[:n] = low
        at = np.flatnonzero(raw == ord("'"))
        at = at[start[at] & ~first[at + 1]]
        a, b = after[at + 1], after[at + 2]
        short = np.isin(a, list(b"stmd"))
        long = ((np.isin(a, list(b"rv")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & ~first[at + 2]
        start[at[short | long] + 1] = False
        ends = np.concatenate([at[short] + 2, at[long] + 3])
        ends = ends[ends < n]
        start[ends] = inside[ends]
        high = np.flatnonzero(raw >= 128)
        lead, then = raw[high], after[high + 1]
        capital = high[(lead == 0xC3) & (then < 0x9F)] + 1
        low[capital] += 32
        odd = high[(lead >= 0xC0) & ((lead != 0xC3) | (then == 0x97) | (then == 0xB7))]  # other characters, and the signs between the letters
        special = np.flatnonzero(raw == ord("<"))
        special = special[after[special + 1] == ord("|")]
        if len(odd := np.concatenate([odd, special, np.flatnonzero(kind == DIGIT)])):
            at = np.flatnonzero(chunk)
            ends = np.append(at[1:], n)
            whole = np.unique(np.searchsorted(at, odd, "right") - 1)
            span = ragged(at[whole], ends[whole] - at[whole])
            start[span], low[span] = False, raw[span]
            start[at[whole]] = True
    low = low[inside]
    found = pa.Array.from_buffers(pa.large_string(), int(np.count_nonzero(start)), [None, pa.py_buffer(np.append(np.flatnonzero(start[inside]), len(low))), pa.py_buffer(low)])
    return found, np.diff(np.searchsorted(np.flatnonzero(start), rows))


class CachedEncoder:
    """ids of texts, by word.

    The vocabulary's pre-tokenizer never joins text across white space, nor what it cuts apart, so words can
    be encoded apart; each distinct word goes through the tokenizer once and the rest is array arithmetic.
    A vocabulary that cuts otherwise gets chunks between white space. `cache` bounds the remembered words:
    beyond it, those that a single batch had are forgotten, or all if too many are left. Results do not
    depend on the memory.
    """

    #: Stands between words that are encoded in one call, which takes half the time of a call for each.
    BETWEEN = "\0"

    def __init__(self, path: str, cache: int = REMEMBERED, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side; threads in each would only need memory
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.longest = Tokenizer.from_file(path), cache, longest
        form = json.loads(self.tokenizer.to_str())
        self.cut = form["normalizer"] == NORMALIZER and form["pre_tokenizer"] == PRE_TOKENIZER
        between = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if self.cut and len(between) == 1 else None
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.seen = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def forget(self) -> None:
        keep = np.flatnonzero(self.seen[: len(self.known)] > 1)
        keep = keep if 2 * len(keep) <= self.cache else keep[:0]
        names = list(self.known)  # in the order of their numbers
        length = self.length[keep]
        ids = self.ids[ragged(self.start[keep], length)]
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.used = len(ids)
        self.ids[: self.used] = ids
        self.start[: len(keep)], self.length[: len(keep)] = np.cumsum(length) - length, length
        self.seen[:] = 0

    def _encode(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all, and each one's number of them."""
        if self.between is not None:
            one = self.tokenizer.encode_batch_fast([f" {self.BETWEEN} ".join([*part, ""])], add_special_tokens=False)[0]
            flat = np.array(one.ids, np.uint32)
            at = np.flatnonzero(flat == self.between)
            if len(at) == len(part):  # else a word holds what stands between them
                return np.delete(flat, at), np.diff(at, prepend=-1) - 1
        found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 250):
            part = new[at : at + 250]
            found, lengths = self._encode(part)
            n = len(self.known)
            while self.used + len(found) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(part) > len(self.start):
                self.start, self.length, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.seen))
            self.ids[self.used : self.used + len(found)] = found
            self.start[n : n + len(part)] = self.used + np.cumsum(lengths) - lengths
            self.length[n : n + len(part)] = lengths
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
            self.used += len(found)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and each text's number of ids."""
        if len(self.known) > self.cache:
            self.forget()
        found, per = words(texts, self.cut)
        coded = pc.dictionary_encode(found)
        distinct = coded.dictionary.to_pylist()
        of = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(of < 0)
        short = np.fromiter((len(distinct[k]) <= self.longest for k in new), bool, len(new))
        new, long = new[short], new[~short]
        of[new] = len(self.known) + np.arange(len(new))
        self._learn([distinct[k] for k in new])
        start, length, ids = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), self.ids[: self.used]
        start[of >= 0], length[of >= 0] = self.start[of[of >= 0]], self.length[of[of >= 0]]
        self.seen[of[of >= 0]] += 1
        if len(long):
            more, length[long] = self._encode([distinct[k] for k in long])
            start[long] = len(ids) + np.cumsum(length[long]) - length[long]
            ids = np.concatenate([ids, more])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = length[codes]
        before, ends = np.concatenate([[0], np.cumsum(n)]), np.cumsum(per)
        return ids[ragged(start[codes], n)], before[ends] - before[ends - per]


def piece_lengths(n: int, max_length: int) -> list[int]:
    """n as a sum of powers of two of max_length at most, longest first."""
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 2, -1, -1) if n % max_length >> b & 1]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, end_id: int = END_ID, vocabulary: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: id, start, length, bucket (log2 of length), ids, doc_tokens, sequence_id, offset.

    `ids` holds the piece's ids as little-endian unsigned 32-bit integers; `vocabulary` is the path of a
    tokenizer file (on every node); `remembered` bounds a worker's memory of words, at the price of time
    where it is small, and changes no result. A null text counts as empty and gives one piece with `end_id` alone;
    rows with equal or null ids are packed each for itself; an empty table gives no rows; columns other
    than the two named are not read. `sequence_id` is unique, and `offset` is 0 as a sequence holds one piece.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length has to be a power of two")
    path = vocabulary or tokenizer_path(VOCABULARY)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(f"packing {path} {remembered}", lambda: CachedEncoder(path, remembered))
        for batch in (part for whole in batches for part in slices(whole, "text")):
            flat, counts = encode(pc.fill_null(batch.column("text"), ""))
            ends = np.cumsum(counts)
            row, start, length, total, ids = [], [], [], [], []
            last = np.array([end_id], np.uint32)
            for k, (end, n) in enumerate(zip(ends, counts, strict=True)):
                own, at = np.concatenate([flat[end - n : end], last]).astype("<u4").tobytes(), 0
                for size in piece_lengths(int(n) + 1, max_length):
                    row.append(k), start.append(at), length.append(size), total.append(int(n) + 1)
                    ids.append(own[4 * at : 4 * (at + size)])
                    at += size
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return out.select(F.col("doc_id").alias(id_col), "start", "length", F.round(F.log2("length")).cast("int").alias("bucket"), "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as power-of-two sequences, with a checksum in place of the ids."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
