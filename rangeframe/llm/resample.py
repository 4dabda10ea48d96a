"""Importance resampling of documents towards a target corpus.

Runs of one to three words are features; a feature's bucket is a checksum modulo the number of buckets.
A bucket gains by how much more frequent it is in the target than in the documents, a
document weighs the sum of its features' gains, and random noise on the weights (the largest of which
is drawn with a probability that follows the weight) decides the sample.

Features are interned per batch in an open-addressed table of NumPy arrays: the xxhash64 of
a feature's bytes gives its first slot, a slot belongs to the feature whose bytes are equal, and
others probe the next one, all in step.  A slot stores the bucket and the count of its
feature, so the checksum is taken once per distinct feature and batch; every occurrence knows its slot,
through which it gathers the gain.

Both passes read whole texts and keep one batch at a time.  The driver sees two rows
of counts per bucket and nothing else.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import with_rank
from .common import map_frames, quoted, text_digest, written

BUCKETS = 10_000
LONGEST = 3  # words of a feature
PERCENT = 5  # of the documents that are long enough are drawn
LEAST_WORDS = 20
SEED = 42
BATCH_WORDS = 1 << 16  # words whose features are interned together
_LONG = 64  # bytes above which features are compared, and their checksums taken, one by one

# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z have been lower-cased; all other bytes separate words
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


# fixed values of the xxhash64 and crc32 definitions
_P1, _P2, _P3, _P4, _P5 = map(
    np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_CRC_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_CRC_POLYNOMIAL), table >> 1)
    return table


_CRC_TABLE = _crc_table()


@dataclass
class Words:
    """Words of several texts in one buffer, joined by one space, and the text of each."""

    buffer: bytes
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    folded = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    lengths = np.array([len(f) + 1 for f in folded], dtype=np.int64)
    raw = np.frombuffer(b" ".join(folded), dtype=np.uint8)
    inside = raw != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    kept = inside.copy()
    kept[end[end < len(raw)]] = True  # one separator behind each word
    closed = np.cumsum(end - start + 1)
    owner = np.searchsorted(np.cumsum(lengths), start, side="right")
    return Words(raw[kept].tobytes(), closed - (end - start + 1), closed - 1, owner)


def features(words: Words, first: int, last: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, owner)`` of the features that begin with words ``first`` to ``last``; none crosses texts."""
    starts, ends, owners = [], [], []
    for more in range(longest):
        at = np.arange(first, min(last, len(words.start) - more))
        at = at[words.owner[at] == words.owner[at + more]]
        starts.append(words.start[at])
        ends.append(words.end[at + more])
        owners.append(words.owner[at])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(owners)


def eights_of(buffer: bytes) -> np.ndarray:
    """The eight bytes that begin at each place of the buffer, as one number."""
    padded = np.frombuffer(buffer + bytes(8), dtype=np.uint8)
    return np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def xxhash64(buffer: bytes, eights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The xxhash64 of each span; spans below 32 bytes, nearly all, are hashed together."""
    size = end - start
    h = size.astype(np.uint64) + _P5
    for lane in range(3):
        at = np.flatnonzero(size >= 8 * lane + 8)
        h[at] = _rotated(h[at] ^ _rotated(eights[start[at] + 8 * lane] * _P2, 31) * _P1, 27) * _P1 + _P4
    place = start + (size & ~7)
    at = np.flatnonzero(size & 4)
    h[at] = _rotated(h[at] ^ (eights[place[at]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    place[at] += 4
    for byte in range(3):
        at = np.flatnonzero(size & 3 > byte)
        h[at] = _rotated(h[at] ^ (eights[place[at] + byte] & np.uint64(0xFF)) * _P5, 11) * _P1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(buffer[start[i] : end[i]])
    return h


def crc32(buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of each span, a byte of all spans at a time; long ones first, so that those still open stand together."""
    raw, size = np.frombuffer(buffer, dtype=np.uint8), end - start
    order = np.argsort(-size, kind="stable")
    first, left = start[order], size[order]
    state = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    single = int(np.count_nonzero(left > _LONG))
    for k in range(int(left[single]) if single < len(left) else 0):
        until = int(np.searchsorted(-left, -k, side="left"))  # these have more than k bytes
        some = state[single:until]
        state[single:until] = _CRC_TABLE[(some ^ raw[first[single:until] + k]) & 0xFF] ^ (some >> np.uint32(8))
    out = np.empty(len(size), dtype=np.int64)
    out[order] = ~state
    for i in order[:single].tolist():
        out[i] = zlib.crc32(buffer[start[i] : end[i]])
    return out


class Table:
    """Distinct features of a batch in slots: ``slot`` of each occurrence, ``bucket`` and ``count`` of each slot."""

    def __init__(self, buffer: bytes, start: np.ndarray, end: np.ndarray, buckets: int, *, keys: np.ndarray | None = None) -> None:
        self._bytes, self._start, self._size = buffer, start, end - start
        self._eights = eights_of(buffer)
        held = self._interned(xxhash64(buffer, self._eights, start, end) if keys is None else keys)
        used = np.flatnonzero(held >= 0)
        self.count = np.bincount(self.slot, minlength=len(held))
        self.bucket = np.zeros(len(held), dtype=np.int64)
        self.bucket[used] = crc32(buffer, start[held[used]], end[held[used]]) % buckets
        self.used = used

    def _interned(self, keys: np.ndarray) -> np.ndarray:
        """The occurrence that holds each slot, -1 for none; fewer than half of the slots are taken."""
        mask = (1 << (2 * len(keys) + 1).bit_length()) - 1
        held = np.full(mask + 1, -1, dtype=np.int64)
        self.slot = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = self.slot[left]
            free = held[at] < 0
            held[at[free]] = left[free]  # of several, one stays
            rival = held[at]
            same = keys[rival] == keys[left]
            doubt = np.flatnonzero(same & (rival != left))
            same[doubt] = self._equal(rival[doubt], left[doubt])
            left = left[~same]
            self.slot[left] = (self.slot[left] + 1) & mask
        return held

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of occurrences ``a`` and ``b`` are the same, eight at a time."""
        same = self._size[a] == self._size[b]
        for i in np.flatnonzero(same & (self._size[a] > _LONG)).tolist():
            p, q, n = int(self._start[a[i]]), int(self._start[b[i]]), int(self._size[a[i]])
            same[i] = self._bytes[p : p + n] == self._bytes[q : q + n]
        open_ = np.flatnonzero(same & (self._size[a] <= _LONG))
        done = 0
        while len(open_):
            x, y = a[open_], b[open_]
            rest = np.minimum(self._size[x] - done, 8).astype(np.uint64)
            differ = self._eights[self._start[x] + done] ^ self._eights[self._start[y] + done]
            differ <<= np.uint64(8) * (np.uint64(8) - rest)  # rest is 1 to 8
            same[open_[differ != 0]] = False
            done += 8
            open_ = open_[(differ == 0) & (self._size[x] > done)]
        return same


def _batches(words: Words, longest: int, buckets: int) -> Iterator[tuple[Table, np.ndarray]]:
    """Tables of the features of several texts, with the text of each occurrence."""
    for first in range(0, len(words.start), BATCH_WORDS):
        start, end, owner = features(words, first, first + BATCH_WORDS, longest)
        low, high = int(start[0]), int(end.max())  # the batch's own part of the buffer
        yield Table(words.buffer[low:high], start - low, end - low, buckets), owner


def bucket_counts(docs: DataFrame, *, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts in each bucket; a task sends one row per bucket."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for frame in frames:
            for table, _ in _batches(words_of(list(frame["text"])), longest, buckets):
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = docs.select(quoted(text).cast("string").alias("text"))
    return map_frames(rows, count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, smoothed by one."""
    n = len(source)
    own, other = float(source.sum()) + n, float(target.sum()) + n
    ratios = ((t + 1.0) * own / ((s + 1.0) * other) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Thousandths of a Gumbel draw of a document; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    docs: DataFrame,
    target: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    seed: int = SEED,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``(doc_id, mark, n_words, n_features, weight, score)`` of every row, from the counts of all rows."""
    counted = []
    for table, column in ((docs, text), (target, target_text)):
        counts = np.zeros(buckets, dtype=np.int64)
        for row in bucket_counts(table, text=column, longest=longest, buckets=buckets).collect():  # one row per bucket
            counts[row["bucket"]] = row["n"]
        counted.append(counts)
    gained = docs.sparkSession.sparkContext.broadcast(gains(*counted))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, words = len(frame), words_of(list(frame["text"]))
            n_features, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for table, owner in _batches(words, longest, buckets):
                n_features += np.bincount(owner, minlength=n)
                np.add.at(weight, owner, gained.value[table.bucket][table.slot])
            n_words = np.bincount(words.owner, minlength=n)
            drawn = np.array([noise(key, seed) for key in frame["doc_id"]], dtype=np.int64)
            kept = frame[["doc_id", "mark"]]
            yield kept.assign(n_words=n_words, n_features=n_features, weight=weight, score=weight + drawn)

    rows = docs.select(quoted(doc_id).alias("doc_id"), text_digest(quoted(text)).alias("mark"), quoted(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_frames(rows, score, f"doc_id {kind}, mark bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """``(doc_id, mark, n_words, n_features, weight, score, rank)`` of every row; ``rank`` from 1 for those drawn, else null.

    Of the rows with ``least_words`` or more words, ``percent`` in a hundred (rounded down) with the highest
    scores are drawn.  Ties go to the smaller id, null ids last; rows of one id and score are
    ranked in any order, each with a rank of its own.  Null, blank and wordless texts have no features, weigh 0 and
    are never drawn while ``least_words`` is above 0.  Texts of any length count as a whole.  With an empty
    target every bucket's gain follows from the smoothing alone; no documents give an empty result.  Other columns take no part.
    """
    rows = written(scored(docs, target, **options).withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    enough = F.col("n_words") >= least_words
    drawn = rows.filter(enough).count() * percent // 100
    keyed = rows.filter(enough).select("*", (-F.col("score")).alias("falling"), F.col("doc_id").isNull().alias("missing"))
    ranked = with_rank(keyed, ["falling", "missing", "doc_id", "row"], "place").drop("falling", "missing")
    place = F.when(F.col("place") < drawn, F.col("place") + 1).cast("bigint")
    out = ranked.withColumn("rank", place).drop("place").unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("bigint")))
    return out.drop("row")


def drawn_documents(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns and no others.

    Rows alike in id and text are told apart by nothing, so they come out as often as they are drawn.
    """
    ranked = resample(docs, target, doc_id=doc_id, text=text, **options).filter("rank IS NOT NULL")
    wanted = written(ranked.groupBy(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark")).agg(F.count(F.lit(1)).alias("w_n")), "resample-drawn")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), quoted(doc_id).alias("row_id"), text_digest(quoted(text)).alias("row_mark"))
    met = rows.join(wanted, F.col("row_id").eqNullSafe(F.col("w_id")) & (F.col("row_mark") == F.col("w_mark")))
    one = met.dropDuplicates(["row_id", "row_mark"])
    return one.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("w_n")))).select("row.*")
