"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

Texts are cut where no piece can span the cut. Cut pieces of equal length advance together, one
character at a time: hashes of all substrings that end there probe the sorted keys of the vocabulary,
and the best candidate's length is kept as a backpointer. For a unigram model the best is the largest
sum of scores. For a BPE model a candidate's score is 0 if it may follow the last piece of the best
path and minus infinity if not; it may if merging the two pieces' characters by the model's rules gives
these two pieces. Exactly one path has score 0, and it is what merging the whole word gives.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import held, ragged, slices, table, tokenizer_path
from labelweave.llm.merges import Merges

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Kinds of pieces and models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A unigram model's score of an unknown character, below the lowest score of a piece.
PENALTY = 10.0
#: Characters of a cut piece up to which pieces advance side by side; longer ones are merged one by one.
LONGEST = 400
MULTIPLIER = 0x9E3779B97F4A7C15


def read_fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        elif key & 7 == 5:
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """A vocabulary with the tables that encoding needs."""

    def __init__(self, data: bytes):
        self.text, self.score, self.kind, trainer, normalizer = [], [], [], {}, {}
        for number, value in read_fields(data):
            if number == 1:
                piece = dict(read_fields(value))
                self.text.append(piece[1].decode()), self.score.append(piece.get(2, 0.0)), self.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(read_fields(value))
            elif number == 3:
                normalizer = dict(read_fields(value))
        self.type, self.unknown = trainer.get(3, UNIGRAM), trainer.get(40, 0)
        if self.type not in (UNIGRAM, BPE) or USER in self.kind or normalizer.get(2) or normalizer.get(4, 1) or trainer.get(24) or not normalizer.get(3, 1):
            raise ValueError("only unigram and BPE models without normalization, user-defined pieces or changed white space are known")
        self.bytes = np.full(256, -1)
        for i, k in enumerate(self.kind):
            if k == BYTE:
                self.bytes[int(self.text[i][3:5], 16)] = i
        self.fallback = bool(trainer.get(35)) and (self.bytes >= 0).all()
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        for t in self.id:
            if len(t.lstrip(SPACE)) + t.count(SPACE) != len(t) or (self.type == BPE and SPACE * 2 in t and t.strip(SPACE)):
                raise ValueError(f"piece {t!r} spans words")
        self.width = max(map(len, self.id))
        chars = np.array(sorted({ord(a) << 21 | ord(b) for t in self.id for a, b in zip(t, t[1:], strict=False)}), np.int64)
        self.bigrams = chars
        self._keys()
        if self.type == BPE:
            self._merges()
        self._surfaces()

    def _keys(self) -> None:
        hashes, ids, lengths = [], [], []
        for t, i in self.id.items():
            h = 0
            for c in t:
                h = (h * MULTIPLIER + ord(c) + 1) & (2**64 - 1)
            hashes.append(h), ids.append(i), lengths.append(len(t))
        order = np.argsort(np.array(hashes, np.uint64))
        self.keys, self.key_id, self.key_length = np.array(hashes, np.uint64)[order], np.array(ids)[order], np.array(lengths)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")

    def _merges(self) -> None:
        """The pairs that merge, and which pieces come out when their own characters are merged."""
        n = len(self.text)
        self.merges, self.reached = Merges(n), np.zeros(n, bool)
        long = sorted((t for t in self.id if len(t) > 1 and t.strip(SPACE)), key=lambda t: (-self.score[self.id[t]], self.id[t]))
        self.ties = len({self.score[self.id[t]] for t in long}) < len(long) or any(c not in self.id for t in self.id for c in t)
        for r, t in enumerate(long):
            self.merges.rank[self.id[t]] = r
        pairs = {}
        for t in long:
            last: list[tuple[str, str]] = []
            self.reached[self.id[t]] = self.merge(t, last) == [t]
            if self.reached[self.id[t]]:
                self.merges.left[self.id[t]], self.merges.right[self.id[t]] = (self.id[x] for x in last[-1])
            for cut in range(1, len(t)):
                if t[:cut] in self.id and t[cut:] in self.id:
                    pairs[self.id[t[:cut]] * n + self.id[t[cut:]]] = self.merges.rank[self.id[t]]
        for t, i in self.id.items():
            self.reached[i] |= len(t) == 1
        self.merges.pairs = np.array(sorted(pairs))
        self.merges.pair_rank = np.array([pairs[p] for p in self.merges.pairs.tolist()])

    def _surfaces(self) -> None:
        surface = []
        for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)):
            surface.append({NORMAL: t.replace(SPACE, " ").encode(), BYTE: bytes([int(t[3:5], 16)]) if k == BYTE else b"", UNKNOWN: " ⁇ ".encode()}.get(k, b""))
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_length = np.array([len(s) for s in surface])
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.raw = np.array([k == BYTE for k in self.kind])

    def merge(self, text: str, last: list | None = None) -> list[str]:
        """BPE by definition: again and again the neighbours whose union scores highest, the leftmost of equals."""
        part: list[str | None] = list(text)
        before, after = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        queue: list[tuple[float, int, str]] = []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and (k := self.id.get(union := part[i] + part[j])) is not None:
                heapq.heappush(queue, (-self.score[k], i, union))

        for i in range(len(part)):
            push(i)
        while queue:
            _, i, union = heapq.heappop(queue)
            if part[i] is None or (j := after[i]) < 0 or part[i] + part[j] != union:
                continue
            if last is not None:
                last.append((part[i], part[j]))
            part[i], part[j], after[i] = union, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i]), push(i)
        return [p for p in part if p is not None]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart when their characters are merged; ids below 0 are unknown characters."""
        return self.merges.apart(a, b)

    def _viterbi(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for rows of equally many code points: flat ids (an unknown character c as -1 - c) and their number in each row."""
        n, size = c.shape
        hashes, power = [np.zeros(n, np.uint64)], [np.uint64(1)]
        for i in range(size):
            hashes.append(hashes[-1] * np.uint64(MULTIPLIER) + c[:, i].astype(np.uint64) + np.uint64(1))
            power.append(np.uint64(int(power[-1]) * MULTIPLIER & (2**64 - 1)))
        best = np.full((size + 1, n), -np.inf, np.float32)
        best[0] = 0
        token, back = np.full((size + 1, n), -1), np.ones((size + 1, n), np.int64)
        score = np.array(self.score, np.float32)
        low = np.float32(min(self.score[i] for i in self.id.values()) - PENALTY)
        for i in range(1, size + 1):
            single = np.zeros(n, bool)
            for length in range(min(i, self.width), 0, -1):
                h = hashes[i] - hashes[i - length] * power[length]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero((self.keys[at] == h) & (self.key_length[at] == length))
                t = self.key_id[at[hit]]
                if length == 1:
                    single[hit] = True
                if self.type == BPE:
                    fits = self.reached[t] & np.isfinite(best[i - length, hit])
                    hit, t = hit[fits], t[fits]
                    if i > length:
                        fits = self.follows(token[i - length, hit], t)
                        hit, t = hit[fits], t[fits]
                    found = np.zeros(len(hit), np.float32)
                else:
                    found = best[i - length, hit] + score[t]
                better = found > best[i, hit]
                hit, t = hit[better], t[better]
                best[i, hit], token[i, hit], back[i, hit] = found[better], t, length
            alone = np.flatnonzero(~single)
            found = best[i - 1, alone] + (np.float32(0) if self.type == BPE else low)
            better = found > best[i, alone]
            alone = alone[better]
            best[i, alone], token[i, alone], back[i, alone] = found[better], -1 - c[alone, i - 1], 1
        out, at = [], np.full(n, size)
        rows = np.arange(n)
        while (at > 0).any():
            out.append(np.where(at > 0, token[at, rows], np.iinfo(np.int64).min))
            at = np.where(at > 0, at - back[at, rows], 0)
        flat = np.array(out[::-1]).T
        real = flat != np.iinfo(np.int64).min
        return flat[real], real.sum(axis=1)

    def words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that no piece spans, flat, and the number for each."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        joint = np.zeros(len(points) + 1, bool)
        joint[1:-1] = np.isin(points[:-1] << 21 | points[1:], self.bigrams)
        joint[np.cumsum(sizes)] = False
        joint[0] = False
        start = np.flatnonzero(~joint[:-1])
        length = np.diff(np.append(start, len(points)))
        owner = np.repeat(np.arange(len(units)), sizes)[start]
        count, parts = np.zeros(len(start), np.int64), []
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            for at in range(0, len(rows), max(1, 2_000_000 // int(size))):
                part = rows[at : at + max(1, 2_000_000 // int(size))]
                c = points[start[part][:, None] + np.arange(size)]
                if self.type == BPE and (size > LONGEST or self.ties):
                    merged = [[self.id.get(p, -1 - ord(p[0])) for p in self.merge("".join(map(chr, row)))] for row in c.tolist()]
                    flat, k = np.array([i for m in merged for i in m], np.int64), np.array([len(m) for m in merged])
                else:
                    flat, k = self._viterbi(c)
                count[part] = k
                parts.append((part, flat, k))
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.int64)
        for part, flat, k in parts:
            ids[ragged(first[part], k)] = flat
        return self._unknown(ids, np.repeat(owner, count), len(units))

    def _unknown(self, ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as the bytes of their UTF-8 form, or as the unknown id (once for several in a row)."""
        if (odd := ids < 0).any():
            if self.fallback:
                point = np.where(odd, -1 - ids, 0)
                size = np.where(odd, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
                out, at = np.repeat(ids, size), np.cumsum(size) - size
                where = np.flatnonzero(odd)
                raw = "".join(map(chr, point[where].tolist())).encode("utf-8", "surrogatepass")
                out[ragged(at[where], size[where])] = self.bytes[np.frombuffer(raw, np.uint8)]
                ids, owner = out, np.repeat(owner, size)
            else:
                repeat = odd[1:] & odd[:-1] & (owner[1:] == owner[:-1])
                keep = np.append(True, ~repeat)
                ids, owner = np.where(odd, self.unknown, ids)[keep], owner[keep]
        return ids, np.bincount(owner, minlength=n)


class Encoder:
    """Ids of whole texts; words are remembered, up to `cache` of them. Results don't depend on the memory."""

    def __init__(self, model: Model, cache: int = 600_000):
        self.model, self.cache, self.runs = model, cache, {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        ids, lengths = self.model.words([SPACE + w for w in words])
        n = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += len(ids)

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces that stand alone."""
        if n not in self.runs:
            self.runs[n] = [self.model.id.get(p, self.model.unknown) for p in self.model.merge(SPACE * n)] if self.model.type == BPE else self.model.words([SPACE * n])[0].tolist()
        return self.runs[n]

    def spaced(self, text: str) -> np.ndarray:
        """Ids of a text with several spaces in a row or at an end."""
        out, run, alone = [], 0, self.model.id.get(SPACE)
        for word in text.split(" "):
            if not word:
                run += 1
                continue
            if self.model.type == UNIGRAM:
                out.append(self.model.words([SPACE * (run + 1) + word])[0])
            else:
                k = self.known[word]
                ids = self.ids[self.start[k] : self.start[k] + self.length[k]]
                if len(ids) and ids[0] == alone:
                    out += [np.array(self.spaces(run + 1), np.int32), ids[1:]]
                else:
                    out += [np.array(self.spaces(run) if run else [], np.int32), ids]
            run = 0
        if run:
            out.append(np.array(self.spaces(run), np.int32))
        return np.concatenate(out).astype(np.int32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and each text's number of ids."""
        if len(self.known) > self.cache:
            self.forget()
        texts = pc.replace_substring(texts, SPACE, " ")
        words = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w and w not in self.known]
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])
        of = np.fromiter((self.known[w] if w else -1 for w in distinct), np.int64, len(distinct))
        codes = of[coded.indices.to_numpy(zero_copy_only=False)]
        per = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        gap = codes < 0
        length = np.where(gap, 0, self.length[codes])
        flat = self.ids[ragged(self.start[codes], length)]
        ends = np.cumsum(per)
        before = np.concatenate([[0], np.cumsum(length)])
        counts = before[ends] - before[ends - per]
        if gap.any():
            odd = np.unique(np.searchsorted(ends, np.flatnonzero(gap), "right"))
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for k in odd:
                text = texts[int(k)].as_py()
                parts[k] = self.spaced(text) if text else np.zeros(0, np.int32)
            flat, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat, counts


def decode_ids(model: Model, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters, ids outside the vocabulary raise."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(model.text)):
        raise ValueError("id outside the vocabulary")
    data = model.surface[ragged(model.surface_start[ids], model.surface_length[ids])].tobytes()
    shown = np.flatnonzero(model.surface_length[ids] > 0)
    strip = len(shown) and model.kind[int(ids[shown[0]])] == NORMAL and data[:1] == b" "
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text, cuts = "", np.flatnonzero(np.diff(model.raw[ids])) + 1
        for part in np.split(ids, cuts):
            own = model.surface[ragged(model.surface_start[part], model.surface_length[part])].tobytes()
            while own:
                try:
                    text, own = text + own.decode(), b""
                except UnicodeDecodeError as e:
                    text, own = text + own[: e.start].decode() + "�", own[e.start + 1 :]
    return text[1:] if strip else text


def encoder(path: str) -> Encoder:
    """The encoder of a model file in this Python worker."""

    def load() -> Encoder:
        with open(path, "rb") as f:
            return Encoder(Model(f.read()))

    return held(f"pieces {path}", load)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_ids, ids) for each row: ids as little-endian 32-bit integers; `vocabulary` is a model file's path, the same on every node.

    Null and empty texts have no ids; equal rows get equal ids; null ids are kept; an empty table gives no
    rows; other columns are not read.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            flat, counts = encode(pc.fill_null(batch.column("text"), ""))
            data, ends = flat.astype("<u4").tobytes(), np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array([data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())], names=["id", "n_ids", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_ids bigint, ids binary").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, n_ids, ids, text) for each row of what encode() returns; null ids give a null text."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path).model
        for batch in (part for whole in batches for part in slices(whole, "ids", 16 << 20)):
            texts = [None if x is None else decode_ids(model, np.frombuffer(x, "<u4").astype(np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum of every document's ids, and digest of the text that they decode to."""
    coded = decode(encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))
