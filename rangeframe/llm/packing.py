"""Packing of documents into training sequences: best fit, then local search by swaps.

A document's token ids, with an end id, are one piece; only a document longer than a sequence is cut, its
first piece being the one that may be shorter.  Pieces never share a document's order
across sequences, so only their lengths matter for the packing.

Pieces are dealt to groups of bounded size, a task each: long pieces first, each into the bin
with the least room that still takes it.  A local search then improves the bins that are not full.  From the
emptiest bin a piece moves, one or two pieces are exchanged for one, or one for two, if
that raises the sum of the squared fills.  Squares grow when a fuller bin gains what an emptier
one loses, so bins fill up or run empty, and empty ones go.

Full bins are final.  The pieces of the others are dealt anew, fewer groups each round, so what a
group could not fill meets the remainders of other groups.  No step needs all pieces in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, quoted, written

CAPACITY = 2048
END_ID = 0
GROUP = 65_536  # pieces that are packed together
ROUNDS = 4
EFFORT = 2_000  # comparisons that a group's local search may make for each of its pieces
SEGMENT = 1 << 16  # characters of a very long text that are encoded at once
TOKENIZER = "byte_bpe_50k.json"


# -- token ids ------------------------------------------------------------------


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A fast encoder for the byte-level BPE that a tokenizer file describes, and its special strings.

    The file's vocabulary writes bytes as printable characters and numbers tokens in the order of its merges,
    which is all that the ids depend on.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in described["added_tokens"] if t["special"]}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in described["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def _segments(text: str, most: int) -> Iterator[str]:
    """The text in parts that encode alone as they do together: cut before single blanks between ASCII letters."""
    start = 0
    while len(text) - start > most:
        cut = start + most
        while cut < len(text) and not (text[cut] == " " and _letter(text[cut - 1]) and _letter(text[cut + 1 : cut + 2])):
            cut = text.find(" ", cut + 1)
            if cut < 0:
                cut = len(text)
        yield text[start:cut]
        start = cut
    yield text[start:]


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text without added special tokens; special strings inside the text are their own ids."""
    encoder, special = _encoder(path)
    ids: list[int] = []
    for part in _segments(text or "", SEGMENT):
        ids += encoder.encode(part, allowed_special="all") if any(s in part for s in special) else encoder.encode_ordinary(part)
    return np.array(ids, dtype="<u4")


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: full ones, the first may be shorter."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def tokenized(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``(row, doc_id, piece, start, length, ids_crc32[, ids])``: the pieces of every row, written.

    ``row`` numbers the pieces of the whole table without gaps that mean anything; it tells repeated rows apart.
    """
    path = path or tokenizer_path()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        for frame in frames:
            made = []
            for key, content in zip(frame["doc_id"], frame["text"]):
                ids = np.append(token_ids(content, path), np.uint32(end_id)).astype("<u4")
                start = 0
                for piece, length in enumerate(piece_lengths(len(ids), capacity)):
                    part = ids[start : start + length]
                    made.append((number, key, piece, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                    number, start = number + 1, start + length
            yield pd.DataFrame(made, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return written(map_frames(rows, batches, schema), "pack-pieces")


# -- bins of one group ----------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: long items first, each into the bin with the least sufficient room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if left := room - size:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins


def _takes(bins: list[list[int]], lengths: np.ndarray, open_: list[int]) -> tuple[np.ndarray, ...]:
    """What bins could give back: ``(bin, i, j, length)`` of nothing, one item and two items (-1 for none)."""
    at, first, second = [], [], []
    for b in open_:
        own = bins[b]
        i, j = np.triu_indices(len(own), 1)
        own = np.array(own, dtype=np.int64)
        none = np.array([-1])
        first += [none, own, own[i]]
        second += [none, np.full(len(own), -1), own[j]]
        at.append(np.full(1 + len(own) + len(i), b))
    i, j = np.concatenate(first), np.concatenate(second)
    sizes = np.append(lengths, 0)
    return np.concatenate(at), i, j, sizes[i] + sizes[j]


def improve(bins: list[list[int]], lengths: list[int], capacity: int, effort: int = EFFORT, least: int | None = None) -> list[list[int]]:
    """The bins after exchanges that raise the sum of squared fills; empty bins are left out.

    The search ends when no exchange gains, when only ``least`` bins are left (unless given, as few as the sum
    of the lengths allows), or after ``effort`` comparisons per item.  All items stay packed whenever it ends.
    """
    effort *= len(lengths)
    least = -(-sum(lengths) // capacity) if least is None else least
    size = np.array(lengths, dtype=np.int64)
    bins = [list(b) for b in bins]
    fill = np.array([int(size[b].sum()) for b in bins], dtype=np.int64)
    gained = True
    while gained and effort > 0 and np.count_nonzero(fill) > least:
        gained = False
        open_ = [b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < capacity]
        for donor in open_:
            at = None
            while 0 < fill[donor] < capacity and effort > 0 and np.count_nonzero(fill) > least:
                if at is None:
                    others = [b for b in open_ if b != donor and fill[donor] <= fill[b] < capacity]
                    if not others:
                        break
                    at, i, j, back = _takes(bins, size, others)
                    effort -= len(at) + 1000 * len(others)  # listing a bin costs about as much
                own = sorted(bins[donor], key=lambda x: -lengths[x])
                gives = [(x,) for x in own] + [(x, y) for n, x in enumerate(own) for y in own[n + 1 :]]
                step = None
                for give in gives:
                    effort -= len(at)
                    more = int(size[list(give)].sum()) - back
                    fits = (more > 0) & (more <= capacity - fill[at]) & (fill[at] + more > fill[donor])
                    if len(give) == 2:
                        fits &= j < 0  # two for one, not two for two
                    if fits.any():
                        best = int(np.argmax(np.where(fits, more, 0)))
                        step = give, best
                        break
                    if effort <= 0:
                        break
                if step is None:
                    break
                give, best = step
                to, taken = int(at[best]), [int(x) for x in (i[best], j[best]) if x >= 0]
                bins[donor] = [x for x in bins[donor] if x not in give] + taken
                bins[to] = [x for x in bins[to] if x not in taken] + list(give)
                fill[donor] -= int(more[best])
                fill[to] += int(more[best])
                at, gained = None, True
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[list[int]]:
    """Bins of item numbers; every item is in one, no bin is above ``capacity``."""
    return improve(best_fit(lengths, capacity), lengths, capacity, effort)


# -- all pieces -----------------------------------------------------------------


def _packed(pieces: DataFrame, round_number: int, capacity: int, group: int, effort: int) -> DataFrame:
    """Each partition's pieces in bins, ``group`` of them at a time, with ``sequence_id``, ``offset`` and whether the bin is ``full``."""
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]

    def one(frame: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        lengths = frame["length"].tolist()
        bins = pack_lengths(lengths, capacity, effort)
        order = np.array([i for b in bins for i in b], dtype=np.int64)
        counts = np.array([len(b) for b in bins], dtype=np.int64)
        out = frame.iloc[order].reset_index(drop=True)
        ends = np.cumsum(out["length"].to_numpy(np.int64))
        last = np.cumsum(counts) - 1
        begins = np.append(0, ends[last[:-1]])
        out["sequence_id"] = np.repeat(first + np.arange(len(bins)), counts)
        out["offset"] = ends - out["length"].to_numpy(np.int64) - np.repeat(begins, counts)
        out["full"] = np.repeat(ends[last] - begins == capacity, counts)
        return out, first + len(bins)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = round_number << 56 | TaskContext.get().partitionId() << 32
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame[names])
            while sum(map(len, held)) >= group:
                rows = pd.concat(held, ignore_index=True)
                out, number = one(rows.iloc[:group].reset_index(drop=True), number)
                held = [rows.iloc[group:]]
                yield out
        if sum(map(len, held)):
            out, number = one(pd.concat(held, ignore_index=True), number)
            yield out

    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, full boolean"
    return written(map_frames(pieces.select(*names), batches, schema), "packed")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS, effort: int = EFFORT) -> DataFrame:
    """``(row, doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: where each of the ``tokenized`` pieces goes.

    Each round deals the pieces to as many tasks as there are groups of ``group`` of them, by a hash of
    ``row``; from the second round on these are the pieces of bins that are not full.  The last round is the one
    that needs a single group, or number ``rounds``.  A group leaves few bins that are not full, so with
    ``rounds`` reached the loss is about one bin per group.
    """
    done, left = [], pieces
    for number in range(rounds):
        tasks = max(1, -(-left.count() // group))
        packed = _packed(left.repartition(tasks, F.xxhash64("row", F.lit(number))), number, capacity, group, effort)
        if tasks == 1 or number == rounds - 1:
            done.append(packed)
            break
        done.append(packed.filter("full"))
        left = packed.filter(~F.col("full"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole.drop("full")


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, **options) -> DataFrame:
    """Every row of ``docs`` as pieces in sequences of at most ``capacity`` ids: the rows of ``pack``.

    A null text is an empty one, whose only id is the end id.  Repeated rows and rows with a null id are
    packed one by one.  A text of any length is encoded whole.  Ties of length are broken by the
    rows' order in their task; other columns take no part, whatever their names.  An empty table gives an empty result.
    """
    return pack(tokenized(docs, capacity=capacity, **options), capacity=capacity, group=group)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``(sequence_id, n_pieces, ids)``: the ids of each sequence, from pieces made ``with_ids`` and their places.

    A sequence has at most ``capacity`` ids, which bounds what is gathered for it.
    """
    met = places.select("row", "sequence_id", "offset").join(pieces.select("row", "ids"), "row")
    listed = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    gathered = met.groupBy("sequence_id").agg(listed.alias("parts"))
    return gathered.select("sequence_id", F.size("parts").cast("bigint").alias("n_pieces"), F.flatten("parts.ids").alias("ids"))
