"""Benchmark decontamination with a hash set of test n-grams.

Items are cut into pieces of whole windows, and pieces are put together into
parts of about ``PART`` bytes. A part's windows of ``width`` words are
broadcast as sorted 64-bit hashes, each with the place of its words in the
part's text. Each task looks its documents' windows up in them, and every hit
is verified on the words themselves before it counts. Parts are applied one
after the other in the same way, however many there are: a row carries what
earlier parts have found.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared, words

WIDTH = 10
#: Bytes of benchmark text, about, whose windows are broadcast at once; a window takes 20 bytes besides.
PART = 16 << 20
#: Words of a piece of an item at most.
PIECE_WORDS = 1 << 16
#: Parts that are applied in one job; then the rows found so far are written.
PARTS_A_JOB = 4
_BITS = 22


def _word_list(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    s = words.slices(data, words.ALNUM)
    return [data[a:b] for a, b in zip(s.starts.tolist(), s.ends.tolist(), strict=True)]


def _cut_items(width: int):
    """Pieces of items as words joined by spaces; neighbours share ``width - 1`` words, so each window lies in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _word_list(text)
                for at in range(0, max(len(found) - width + 1, min(len(found), 1)), PIECE_WORDS):
                    piece = b" ".join(found[at : at + PIECE_WORDS + width - 1])
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([piece], pa.binary())], ["item_id", "words"])

    return run


class WindowSet:
    """Windows of a part of the benchmark, by their length in words: sorted hashes, where their words begin and end in the part's text, and their items."""

    def __init__(self, pieces: list[tuple[int | None, bytes]], width: int):
        self.items = [item for item, _ in pieces]
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        base, group, size = 0, [], 0
        for k, (_, piece) in enumerate([*pieces, (None, b"")]):
            if group and (k == len(pieces) or size + len(piece) > words.CHUNK):
                self._add(found, group, k - len(group), base, width)
                base, group, size = base + size, [], 0
            group.append(piece)
            size += len(piece) + 1
        self.text = b" ".join(piece for _, piece in pieces)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for k, parts in found.items():
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.tables[k] = tuple(c[order] for c in columns)

    @staticmethod
    def _add(found: dict, group: list[bytes], first: int, base: int, width: int) -> None:
        s = words.slices(b" ".join(group), words.ALNUM)
        bounds = np.searchsorted(s.starts, np.cumsum([0, *(len(x) + 1 for x in group)]))
        count, hashes = np.diff(bounds), s.hashes(s.starts, s.ends)
        for k in np.unique(np.minimum(count, width)).tolist():
            if not k:
                continue
            h = words.windows(hashes, k)
            owner = np.repeat(np.arange(len(group)), count)[: len(h)]
            at = np.flatnonzero((np.minimum(count, width)[owner] == k) & (np.arange(len(h)) + k <= bounds[owner + 1]))
            found[k].append((h[at], (base + s.starts[at]).astype(np.uint32), (base + s.ends[at + k - 1]).astype(np.uint32), (first + owner[at]).astype(np.int32)))

    def bits(self) -> dict[int, np.ndarray]:
        """For each length a table of bits that rejects most other windows."""
        out = {}
        for k, (h, *_) in self.tables.items():
            out[k] = np.zeros(1 << _BITS, bool)
            out[k][(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return out

    def items_of(self, k: int, h: np.uint64, window: bytes) -> set | None:
        """Items with just this window; None if no item has it."""
        hashes, starts, ends, owners = self.tables[k]
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        same = {self.items[owners[i]] for i in range(lo, hi) if self.text[starts[i] : ends[i]] == window}
        return same or None


def _find(known: WindowSet, bits: dict[int, np.ndarray], texts: list) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
    """Number of words, ranges of words that are hit, and items, of each text."""
    for first, count, h, bounds in words.hashed(texts, words.ALNUM):
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        split: dict[int, list[bytes]] = {}
        for k, (sorted_h, *_) in known.tables.items():
            w = words.windows(h, k)
            at = np.flatnonzero(bits[k][(w >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[sorted_h[np.minimum(np.searchsorted(sorted_h, w[at]), len(sorted_h) - 1)] == w[at]]
            of = np.searchsorted(bounds, at, side="right") - 1
            inside = at + k <= bounds[of + 1]
            for x, i in zip(at[inside].tolist(), of[inside].tolist(), strict=True):
                if i not in split:
                    split[i] = _word_list(texts[first + i])
                start = x - int(bounds[i])
                found = known.items_of(k, w[x], b" ".join(split[i][start : start + k]))
                if found:
                    hits[i].append((start, start + k))
                    items[i] |= found
        for i in range(count):
            yield int(bounds[i + 1] - bounds[i]), hits.get(i, []), items.get(i, set())


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _map(sent, text: int):
    """Adds what one part finds to the last three columns; ``text`` is the place of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        bits = known.bits()
        for batch in batches:
            n, spans, items = [], [], []
            before = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            for (old, listed), (count, hits, ids) in zip(before, _find(known, bits, batch.column(text).to_pylist()), strict=True):
                n.append(count)
                spans.append([{"start": a, "stop": b} for a, b in _merged([*((x["start"], x["stop"]) for x in old), *hits])] if hits else old)
                items.append(sorted({*listed, *(x for x in ids if x is not None)}) if ids else listed)
            kinds = [batch.schema.field(k).type for k in range(batch.num_columns - 3, batch.num_columns)]
            columns = [*batch.columns[:-3], *(pa.array(x, kind) for x, kind in zip((n, spans, items), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _scanned(rows: DataFrame, benchmark: DataFrame, width: int, part: int, found: list[str]) -> DataFrame:
    """``rows``, in which ``text`` is a column, with the columns ``found``: number of words, hit spans and items."""
    spark = rows.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    pieces = shared.table(items.mapInArrow(_cut_items(width), "item_id long, words binary").distinct(), "pieces")
    parts = -(-(pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // part) or 1
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)))
    empty = [F.lit(0).cast("long"), F.array().cast("array<struct<start:long,stop:long>>"), F.array().cast("array<long>")]
    out = rows.select("*", *(c.alias(name) for c, name in zip(empty, found, strict=True)))
    for i in range(parts):
        mine = [(r["item_id"], bytes(r["words"])) for r in pieces.where(F.col("part") == i).select("item_id", "words").collect()]  # about `part` bytes
        out = out.mapInArrow(_map(spark.sparkContext.broadcast(WindowSet(mine, width)), rows.columns.index("text")), out.schema)
        if (i + 1) % PARTS_A_JOB == 0 and i + 1 < parts:
            out = shared.table(out, "scanned")
    return out


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: str = "doc_id", part: int = PART) -> DataFrame:
    """``(key, n_words, spans, items)`` for each row of ``docs``.

    ``spans`` are the merged ranges of words, by their place in the document,
    that lie inside an occurrence of a window; ``items`` are the ids of the
    items with such windows, in order. Words are runs of ASCII letters and
    digits and of all other characters, with A-Z lowered. An item of fewer
    words than ``width``, but not none, is one window. Null and empty texts
    have no words and no hits; an item without an id marks its hits but is not
    listed; repeated items are listed once; rows with the same key give a row
    each. With an empty benchmark nothing is hit. Other columns are not read.
    """
    source = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    return _scanned(source, benchmark, width, part, ["n_words", "spans", "items"]).drop("text")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Figures of :func:`scan`: hit words, items and a digest of the items' ids."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return scan(docs, benchmark, width).select(
        F.col("key").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(text: int, most: float):
    """Drops or cuts by the last three columns, which go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            rows = zip(*(batch.column(k).to_pylist() for k in (text, batch.num_columns - 3, batch.num_columns - 2)), strict=True)
            for i, (value, n, spans) in enumerate(rows):
                spans = [(x["start"], x["stop"]) for x in spans]
                if sum(b - a for a, b in spans) > most * n:
                    continue
                keep.append(i)
                out.append(_without(value, spans) if spans else value)
            columns = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:-3]]
            columns[text] = pa.array(out, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(batch.num_columns - 3)]))

    return run


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    data = text.encode("utf-8", "surrogatepass")
    s = words.slices(data.lower(), words.ALNUM)
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : int(s.starts[a])])
        at = int(s.ends[b - 1])
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: float = 0.0, part: int = PART) -> DataFrame:
    """``docs`` without benchmark text.

    A document of which more than the share ``most`` of its words is hit goes;
    of the others the hit spans are cut out of ``text``, and ``n_chars``, if
    there is such a column, is counted again. With ``most`` 0 every hit
    document goes and all others stay as they are. Null and empty texts stay,
    repeated rows give a row each, and other columns stay whatever their names.
    """
    found = [shared.unused(docs, name) for name in ("n_words", "spans", "items")]
    out = _scanned(docs, benchmark, width, part, found)
    if most == 0:
        out = out.where(F.size(found[1]) == 0).select(*docs.columns)
    else:
        out = out.mapInArrow(_cut(docs.columns.index("text"), most), docs.schema)
    if most > 0 and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def items_digest(ids: list[int]) -> str:
    """The digest of item ids as :func:`report` gives it."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
