"""Fill-in-the-middle transformation with a compressed set of cut places.

Where a text may be cut is a set of code-point offsets: the start, and the end of each unit.
It is kept the way compressed bitmap indexes keep row numbers.  Offsets with the same
high 16 bits share a container, which is the smallest of three forms: a sorted array, a bitmap, or
runs of consecutive offsets.  A list of cumulative cardinalities over the containers says in which one the
``k``-th offset lies, and a select inside it gives the offset.  Both cuts of a
text are two such selects.

Units are words with the blanks before them (texts that end in blanks have one more
unit), or single code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_frames, quoted

LOW_BITS = 16
BITMAP_BYTES = 1 << LOW_BITS >> 3


class ArrayContainer:
    """Sorted low halves, two bytes each."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per place, and how many bits are set before each 64-bit word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(1 << LOW_BITS, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        rest = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            rest &= rest - 1  # drops the lowest bit
        return 64 * word + (rest & -rest).bit_length() - 1


class RunContainer:
    """First places of runs of consecutive ones, and how many ones come before each run."""

    def __init__(self, low: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.start, self.before = low[first], first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form of sorted, distinct places below 65,536."""
    runs = int(np.count_nonzero(np.diff(low, prepend=-2) != 1))
    sizes = ((2 * len(low), ArrayContainer), (4 * runs, RunContainer), (BITMAP_BYTES, BitmapContainer))
    return min(sizes, key=lambda s: s[0])[1](low)


class BoundarySet:
    """Sorted, distinct offsets with select; as long as the text they belong to needs."""

    def __init__(self, offsets: np.ndarray) -> None:
        offsets = np.asarray(offsets, dtype=np.int64)
        high = offsets >> LOW_BITS
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[first]
        self.before = np.append(first, len(offsets))  # cumulative cardinalities
        low = offsets & ((1 << LOW_BITS) - 1)
        self.containers = [container(low[a:b]) for a, b in zip(self.before[:-1].tolist(), self.before[1:].tolist())]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The ``k``-th offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.high[at]) << LOW_BITS | self.containers[at].select(k - int(self.before[at]))


def boundaries(text: str, unit: str = "word") -> BoundarySet:
    """Where ``text`` may be cut: 0 and the end of each unit, in code points."""
    if unit == "char":
        return BoundarySet(np.arange(len(text) + 1))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return BoundarySet(np.concatenate([[0], ends, [len(text)]] if text else [[0]]))


@dataclass(frozen=True)
class Spec:
    """How documents are dealt to forms, in percent, and what marks the parts."""

    seed: int = 42
    cut_percent: int = 50  # of documents are cut; the others stay plain
    spm_percent: int = 80  # of those have the suffix first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "word"

    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(doc_id: object, seed: int) -> list[int]:
    """Four 32-bit numbers of a document; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id: object, text: str | None, spec: Spec = Spec()) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    text = text or ""
    cuts = boundaries(text, spec.unit)
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(doc_id, spec.seed)
    if not text or any(m in text for m in spec.markers()) or h3 % 100 >= spec.cut_percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, last = cuts.select(a), cuts.select(b)
    head, body, tail = spec.prefix + text[:first], spec.middle + text[first:last], spec.suffix + text[last:]
    form, parts = ("spm", (tail, head, body)) if h4 % 100 < spec.spm_percent else ("psm", (head, tail, body))
    return n, form, first, last - first, "".join(parts)


def fill_in_middle(docs: DataFrame, spec: Spec = Spec(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    A null text is an empty one.  Empty texts and texts that hold a marker stay plain, as their parts
    could not be told apart again; ``prefix_chars`` and ``middle_chars`` are null for plain rows.  Rows of one id
    are cut by the same draws; repeated rows give repeated results.  A text of any length is
    cut as a whole.  Columns other than the two named ones take no part, whatever their names.  An empty table gives an empty result.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [transformed(key, content, spec) for key, content in zip(frame["doc_id"], frame["text"])]
            out = pd.DataFrame(made, columns=["n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_frames(rows, batches, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, spec: Spec = Spec()) -> Column:
    """The text from an output and its form alone.

    A cut text holds no marker and a marker begins and ends with characters that no other part of it
    repeats, so each marker is found exactly once.
    """
    literal = "|".join(f"\\Q{m}\\E" for m in spec.markers())
    part = F.split(output, literal, -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
