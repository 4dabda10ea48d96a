"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

Paragraphs are lines.  A section ends at a blank line, or after a paragraph whose
digest ends in three zero bits, so a moved paragraph changes its own section only.
Inside a paragraph, pieces end at blanks that follow certain letters (about
every sixteenth), so an edit changes the piece it falls in and none behind it.

Each node's digest is made from its children's digests, up to the root.  The
fingerprint writes the tree out: the root's digest, a colon, then eight hex digits
per piece, ``/`` between paragraphs and ``|`` between sections.  Equal roots mean equal
texts; equal branches can be skipped when looking for edits, and the rest say
which section, paragraph and piece differ.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, quoted, text_digest

BUCKET_BYTES = 4 << 20
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 16
_FIRST = -(1 << 63)


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _piece_ends(raw: np.ndarray) -> np.ndarray:
    """Places behind the blanks that end a piece: those where the four bytes before say so."""
    blanks = np.flatnonzero(raw == 32)
    blanks = blanks[blanks >= 4]
    before = np.zeros(len(blanks), dtype=np.uint32)
    for back in range(1, 5):
        before = before << np.uint32(8) | raw[blanks - back]
    return blanks[before * np.uint32(2654435761) >> np.uint32(28) == 0] + 1


def fingerprint(text: str | None) -> str:
    """The written tree; null counts as the empty text, which has one empty paragraph."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ends = _piece_ends(np.frombuffer(raw, dtype=np.uint8)).tolist()
    sections, paragraphs, digests, tops = [], [], [], []

    def close_section() -> None:
        if digests:
            sections.append("/".join(paragraphs))
            tops.append(_digest(b"s" + b"".join(digests)))
            paragraphs.clear()
            digests.clear()

    start = at = 0
    for line in raw.split(b"\n"):
        stop = start + len(line)
        own = []
        while at < len(ends) and ends[at] <= stop:
            if ends[at] > start:
                own.append(_digest(raw[start : ends[at]]))
                start = ends[at]
            at += 1
        own.append(_digest(raw[start:stop]))
        paragraphs.append("".join(d[:4].hex() for d in own))
        digests.append(_digest(b"p" + b"".join(own)))
        if not line.strip() or digests[-1][-1] & 7 == 0:
            close_section()
        start = stop + 1
    close_section()
    return f"{_digest(b'r' + b''.join(tops)).hex()}:{'|'.join(sections)}"


def _leaves(print_: str) -> Counter:
    flat = print_[33:].replace("|", "").replace("/", "")
    return Counter(flat[i : i + 8] for i in range(0, len(flat), 8))


def likeness(one: str, other: str) -> float:
    """Share of pieces that two fingerprints have in common (Dice); 1 only for equal roots."""
    if one[:32] == other[:32]:
        return 1.0
    a, b = _leaves(one), _leaves(other)
    total = a.total() + b.total()
    return min(2 * (a & b).total(), total - 1) / total


def differences(old: str, new: str) -> list[tuple[int, int, int]]:
    """``(section, paragraph, piece)`` of every piece of ``new`` that stands in no equal branch of ``old``."""
    if old[:32] == new[:32]:
        return []
    had_sections = old[33:].split("|")
    had_paragraphs = {p for s in had_sections for p in s.split("/")}
    had_leaves, had_sections = _leaves(old), set(had_sections)
    out = []
    for i, section in enumerate(new[33:].split("|")):
        if section in had_sections:
            continue
        for j, paragraph in enumerate(section.split("/")):
            if paragraph not in had_paragraphs:
                pieces = [paragraph[k : k + 8] for k in range(0, len(paragraph), 8)]
                out += [(i, j, k) for k, piece in enumerate(pieces) if piece not in had_leaves]
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every row; a map without a shuffle."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fingerprint": [fingerprint(t) for t in frame["text"]]})

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"))
    return map_frames(rows, batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def in_falling_order(docs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """``(bucket, tail, key, mark, doc_id, text)``: rows dealt so that each row's successor is in its bucket.

    Buckets are ranges of the id from quantiles, so no task sorts everything.  The
    first row of a bucket also goes to the end (``tail``) of the bucket before,
    that of the first bucket to the end of the last.  Texts are shuffled once.
    """
    key = F.coalesce(quoted(doc_id).cast("bigint"), F.lit(_FIRST))
    size = F.sum(F.octet_length(F.coalesce(quoted(text).cast("string"), F.lit("")))).alias("bytes")
    n = docs.agg(size).first()["bytes"] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // BUCKET_BYTES))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = docs.agg(F.percentile_approx(key, shares, min(10**6, 20 * buckets)).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(bounds, dtype=np.int64))
    number = F.pandas_udf(lambda keys: pd.Series(len(bounds) - np.searchsorted(bounds, keys.to_numpy(np.int64), side="left")), "bigint")

    heads = docs.select(key.alias("key")).select("key", number("key").alias("bucket")).groupBy("bucket").agg(F.max("key").alias("head"))
    heads = sorted((r["bucket"], r["head"]) for r in heads.collect())  # one row per bucket
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    head_keys = np.array(sorted(before), dtype=np.int64)
    head_goes = np.array([before[k] for k in sorted(before)], dtype=np.int64)

    def placed(keys: pd.Series) -> pd.Series:
        """Twice the bucket; for the first row of a bucket also where it is the tail, plus one."""
        values = keys.to_numpy(np.int64)
        own = (2 * (len(bounds) - np.searchsorted(bounds, values, side="left"))).tolist()
        at = np.minimum(np.searchsorted(head_keys, values), len(head_keys) - 1)
        is_head = (head_keys[at] == values).tolist()
        tails = (2 * head_goes[at] + 1).tolist()
        return pd.Series([[o, t] if h else [o] for o, h, t in zip(own, is_head, tails)])

    places = F.pandas_udf(placed, "array<bigint>")
    rows = docs.select(key.alias("key"), quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"))
    rows = rows.select("*", text_digest(F.col("text")).alias("mark"), F.explode(places("key")).alias("place"))
    rows = rows.select(F.floor(F.col("place") / 2).alias("bucket"), (F.col("place") % 2 == 1).alias("tail"), "key", "mark", "doc_id", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(tasks, min(buckets // 4, 20_000)), "bucket")
    return dealt.sortWithinPartitions("bucket", "tail", F.desc("key"), "mark")


def edited_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likenesses.

    The edited text ends with the start of the next document, in falling id: the
    last ``floor(n/2)`` code points give way to as many of the next text, or all.
    The last document's next is the first; a single document's next is itself.
    Ids are whole numbers; a null id counts as the smallest; rows of one id follow
    each other by a digest of their text.  A null text is empty.  An empty
    table gives an empty result.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row: bucket, id, text, fingerprint
        for frame in frames:
            out = []
            for bucket, tail, key, content in zip(frame["bucket"], frame["tail"], frame["doc_id"], frame["text"]):
                content = content or ""
                if tail and (held is None or held[0] != bucket):
                    continue  # only the first tail row follows a row of the bucket
                own = fingerprint(content)
                if held is not None and held[0] == bucket:
                    _, before, start, print_ = held
                    half = len(start) // 2
                    edited = start[: len(start) - half] + content[:half]
                    changed = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(start), sha, print_, changed, likeness(print_, changed), likeness(print_, own)))
                held = None if tail else (bucket, key, content, own)
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ordered = in_falling_order(docs, doc_id=doc_id, text=text)
    kind = ordered.schema["doc_id"].dataType.simpleString()
    return map_frames(ordered.select("bucket", "tail", "doc_id", "text"), batches,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
