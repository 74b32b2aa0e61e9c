"""Token counts of sections, from one encoding of the whole document.

A document is encoded once. The bytes of its tokens give their spans, and an
interval join of sorted starts attributes them to sections. A token that
crosses a boundary between sections goes by the rule that is asked for:

- ``most``: to the section that holds most of its bytes, the earlier if equal;
- ``first``: to the section of its first byte;
- ``share``: to each section in proportion to the bytes in it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies on each executor; a parameter everywhere. On a cluster without it, send the file with ``addFile`` and give its path there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with this vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(path: str = VOCABULARY) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the length in bytes of each of its tokens."""
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(t) for t in ranks]
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[path]


def sentence_starts(data: bytes) -> np.ndarray:
    """First bytes of sections, which are sentences.

    A section ends with a line feed, or with a blank after ``.``, ``!`` or ``?``.
    """
    a = np.frombuffer(data, np.uint8)
    ends = a == 0x0A
    ends[1:] |= (a[1:] == 0x20) & np.isin(a[:-1], (0x21, 0x2E, 0x3F))
    at = np.flatnonzero(ends) + 1
    return np.concatenate([[0], at[at < len(data)]])


def attribute(lengths: np.ndarray, starts: np.ndarray, size: int, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its section's tokens cross its borders.

    ``lengths`` are the tokens' bytes in order, ``starts`` the sections' first
    bytes, in order from 0, and ``size`` the bytes in all.
    """
    stop = np.cumsum(lengths)
    start = stop - lengths
    a = np.searchsorted(starts, start, side="right") - 1
    b = np.searchsorted(starts, stop - 1, side="right") - 1
    count = np.bincount(a[a == b], minlength=len(starts)).astype(np.float64)
    crossing = np.zeros(len(starts), np.int64)
    limits = np.append(starts, size)
    two = np.flatnonzero(b == a + 1)
    held = limits[a[two] + 1] - start[two]
    np.add.at(crossing, a[two], 1)
    np.add.at(crossing, b[two], 1)
    if rule == "share":
        np.add.at(count, a[two], held / lengths[two])
        np.add.at(count, b[two], 1 - held / lengths[two])
    else:
        np.add.at(count, np.where((rule == "first") | (2 * held >= lengths[two]), a[two], b[two]), 1)
    for t in np.flatnonzero(b > a + 1).tolist():
        parts = np.arange(a[t], b[t] + 1)
        held = np.minimum(limits[parts + 1], stop[t]) - np.maximum(limits[parts], start[t])
        crossing[parts] += 1
        if rule == "share":
            count[parts] += held / lengths[t]
        else:
            count[parts[0] if rule == "first" else parts[int(np.argmax(held))]] += 1
    return count, crossing


def _rows(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(path)
        for batch in batches:
            keys, out, pending = [], [], 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                ids = np.array(encoding.encode_ordinary(text or ""), np.int64)
                starts = sentence_starts(data)
                count, crossing = attribute(sizes[ids], starts, len(data), rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                edge = chars[np.append(starts, len(data))]
                keys.append(np.full(len(starts), k))
                out.append((np.arange(len(starts)), edge[:-1], edge[1:], count, crossing))
                pending += len(starts)
                if pending > 1 << 17:
                    yield _batch(batch, keys, out)
                    keys, out, pending = [], [], 0
            if out:
                yield _batch(batch, keys, out)

    return run


def _batch(batch: pa.RecordBatch, keys: list, out: list) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(keys))), *map(pa.array, columns)], ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])


def section_tokens(docs: DataFrame, rule: str = "most", path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, section, start, stop, n_tokens, n_crossing)``, a row for each sentence of each row of ``docs``.

    ``start`` and ``stop`` are characters. The counts of a document's sections
    add up to its tokens. ``n_crossing`` are the tokens that a section shares
    with a neighbour. A null or empty text is one section without tokens.
    Repeated rows give their sections again; other columns are not read.
    """
    if rule not in ("most", "first", "share"):
        raise ValueError(f"unknown rule {rule!r}")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_rows(path, rule), "doc_id long, section long, start long, stop long, n_tokens double, n_crossing long")
