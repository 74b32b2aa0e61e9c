"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of ASCII letters and digits and of all other characters. A
token's features are itself, its prefixes of 4 to 6 bytes and its suffix of 4
bytes, hashed into a fixed table. Labels are given for whole documents only,
so token labels come from them by distant supervision: over all labelled
training rows, each feature's different texts are counted by label, and a token of a
toxic document counts as toxic if one of its features is far more frequent in
toxic documents than in others. A chain with two states is fitted to the
tokens of a bounded sample of those rows. Forward-backward marginals then give
each token's probability, the offending spans and, through a calibration with
three inputs, the document's score. Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared, words

#: Size of the table of hashed features, and so of what is broadcast.
TABLE_BITS = 21
#: Labelled documents of each class that the chain is fitted on, and the length of the longest of them in characters.
SAMPLE = 1000
SAMPLE_CHARS = 20_000
#: Tokens of the sample, about, that messages are held for at once.
CHAIN = 1 << 17
#: Characters that one chain holds at most, about. A longer text is several chains, which start anew after white space; its score is that of all its tokens.
PART = 1 << 21
#: Labels that are broadcast at most.
BROADCAST_LABELS = 1_000_000
#: A feature points to toxic tokens from this log-odds ratio of document frequencies and so many toxic documents.
LEAST_ODDS = 3.0
LEAST_DOCS = 4
#: Its toxic documents exceed those to be expected by so many standard deviations.
LEAST_SIGMA = 5.0
_KINDS = (("word", 0), ("prefix", 4), ("prefix", 5), ("prefix", 6), ("suffix", 4))


def features(s: words.Slices) -> np.ndarray:
    """Indices of each word's features, one column for each kind; -1 where a word is too short."""
    out = np.empty((len(s.starts), len(_KINDS)), np.int64)
    length = s.ends - s.starts
    for j, (kind, k) in enumerate(_KINDS):
        a, b = s.starts, s.ends
        if kind == "prefix":
            b = np.minimum(s.starts + k, s.ends)
        elif kind == "suffix":
            a = np.maximum(s.ends - k, s.starts)
        h = words.mix(s.hashes(a, b) + np.uint64(j + 1)) >> np.uint64(64 - TABLE_BITS)
        out[:, j] = np.where((length > k) | (k == 0), h.astype(np.int64), -1)
    return out


def _parts(texts: list) -> Iterator[tuple[int, int, str]]:
    """``(text, first character, part)``: each text whole, or a very long one in parts that are cut at white space."""
    for k, text in enumerate(texts):
        text = text or ""
        at = 0
        while len(text) - at > PART:
            cut = at + PART
            while cut < len(text) and not text[cut].isspace():
                cut += 1
            yield k, at, text[at:cut]
            at = cut
        yield k, at, text[at:]


def _groups(texts: list) -> Iterator[tuple[int, int, words.Slices, np.ndarray]]:
    """Groups of texts as one buffer: ``(first, count, slices, bounds of words)``."""
    first, group, size = 0, [], 0
    for k, text in enumerate([*texts, None]):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if group and (k == len(texts) or size + len(data) > words.CHUNK):
            s = words.slices(b" ".join(group), words.ALNUM)
            offsets = np.cumsum([0, *(len(x) + 1 for x in group)])
            yield first, len(group), s, np.searchsorted(s.starts, offsets)
            first, group, size = k, [], 0
        group.append(data)
        size += len(data) + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a feature, summed over a task."""
    total = np.zeros((2, 1 << TABLE_BITS), np.int32)
    n = np.zeros(2, np.int64)
    def add(key: np.ndarray, label: np.ndarray) -> None:
        of = label[key >> TABLE_BITS]
        for y in (0, 1):
            at, times = np.unique(key[of == y] & ((1 << TABLE_BITS) - 1), return_counts=True)
            total[y][at] += times.astype(np.int32)

    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        n += np.bincount(label, minlength=2)
        parts = list(_parts(batch.column(0).to_pylist()))
        owner = np.array([k for k, _, _ in parts], np.int64)
        several = np.bincount(owner, minlength=len(label)) > 1
        held: dict[int, np.ndarray] = {}  # keys of texts in several parts, by kind of feature
        for first, count, s, bounds in _groups([part for _, _, part in parts]):
            f = features(s)
            own = np.repeat(owner[first : first + count], np.diff(bounds))
            for j in range(f.shape[1]):
                ok = f[:, j] >= 0
                key = np.unique(own[ok] << TABLE_BITS | f[ok, j])
                cut = several[key >> TABLE_BITS]
                add(key[~cut], label)
                if cut.any():
                    held[j] = np.union1d(held[j], key[cut]) if j in held else key[cut]
        for key in held.values():
            add(key, label)
    at = np.flatnonzero(total[0] | total[1])
    index = np.concatenate([at, [-1]])
    yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(np.append(total[1][at], n[1]).astype(np.int64)), pa.array(np.append(total[0][at], n[0]).astype(np.int64))], ["feature", "toxic", "clean"])


def marginals(emission: np.ndarray, trans: np.ndarray, start: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of many chains that lie end to end.

    ``emission`` is the score of state 1 over state 0 at each token, ``trans``
    the scores of the four transitions, ``start`` those of the first state.
    Gives the probability of state 1 at each token and both normalised
    messages. All chains are one scan over products of 2 x 2 matrices, in which
    the first token of a chain forgets what came before; it runs along columns
    of a grid, so its Python steps grow with the square root of the tokens.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2))
    first = np.zeros(n, bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    e = np.ones((n, 2))
    e[:, 1] = np.exp(np.clip(emission, -30, 30))
    t = np.exp(trans)
    s = np.exp(start)
    # Forward: row vector times T times diag(e); at a first token every row is the start vector.
    m = np.broadcast_to(t, (n, 2, 2)) * e[:, None, :]
    m[first] = (s * e[first])[:, None, :]
    forward = _scan(m)
    # Backward: beta_i = T diag(e_{i+1}) beta_{i+1}; at the last token of a chain it is 1.
    last = np.append(first[1:], True)
    b = np.empty((n, 2, 2))
    b[:-1] = t[None] * e[1:, None, :]
    b[last] = 1.0
    # as row vectors in reverse order: beta_i' = beta_{i+1}' (T diag e)'
    back = _scan(np.ascontiguousarray(b[::-1].transpose(0, 2, 1)))[::-1]
    p = forward * back
    return p[:, 1] / p.sum(1), forward, back


def _scan(m: np.ndarray) -> np.ndarray:
    """Row vectors (1, 1) M_0 ... M_i, each scaled to sum 1."""
    n = len(m)
    rows = int(np.ceil(np.sqrt(n)))
    cols = -(-n // rows)
    grid = np.tile(np.array([1.0, 0.0, 0.0, 1.0]), (rows * cols, 1))
    grid[:n] = m.reshape(n, 4)
    # a column of the grid is contiguous: (column, entry, row)
    grid = np.ascontiguousarray(grid.reshape(rows, cols, 4).transpose(1, 2, 0))
    for j in range(cols):
        q = grid[j]
        if j:
            p = grid[j - 1]
            q = np.stack([p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]])
        grid[j] = q / q.sum(0)
    carry = np.empty((2, rows))
    v = np.array([0.5, 0.5])
    for i in range(rows):
        carry[:, i] = v
        v = v @ grid[-1, :, i].reshape(2, 2)
        v = v / v.sum()
    out = np.stack([carry[0] * grid[:, 0] + carry[1] * grid[:, 2], carry[0] * grid[:, 1] + carry[1] * grid[:, 3]], 2)
    out = out.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True)


@dataclass
class Model:
    """Weights of features, transitions and start, and the calibration of scores."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    trans: np.ndarray
    start: np.ndarray
    scale: np.ndarray

    def table(self) -> np.ndarray:
        w = np.zeros((1 << TABLE_BITS) + 1, np.float32)  # the last place is for features that a word lacks
        w[self.index] = self.weight
        return w

    def emission(self, s: words.Slices, table: np.ndarray) -> np.ndarray:
        return table[features(s)].sum(1, dtype=np.float64) + self.bias

    def score(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(most, total) @ self.scale, -50, 50)))


def peaks(p: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each chain's most toxic token, 0 if it has none, and its expected toxic tokens."""
    most = np.zeros(len(bounds) - 1)
    full = np.diff(bounds) > 0
    if full.any():
        most[full] = np.maximum.reduceat(p, bounds[:-1][full])
    total = np.concatenate([[0], np.cumsum(p)])
    return most, total[bounds[1:]] - total[bounds[:-1]]


def inputs(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Inputs of a document's score: 1, log-odds of its most toxic token, and the log of its expected toxic tokens."""
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(most)), np.log(most / (1 - most)) / 5, np.log1p(total)], 1)


def _tokens(shared_chosen):
    """The chosen features of each text as ``(place of the token, number of the feature)``, and its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared_chosen.value
        position = np.full((1 << TABLE_BITS) + 1, -1, np.int32)  # the last place is for features that a word lacks
        position[chosen] = np.arange(len(chosen))
        for batch in batches:
            n, sizes, at, of = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for _, _, s, bounds in _groups(batch.column(2).to_pylist()):
                f = position[features(s)]
                token, kind = np.nonzero(f >= 0)
                cut = np.searchsorted(token, bounds)
                n.extend(np.diff(bounds).tolist())
                sizes.extend(np.diff(cut).tolist())
                at.append((token - np.repeat(bounds[:-1], np.diff(cut))).astype(np.int32))
                of.append(f[token, kind])
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (at, of)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *lists], ["label_id", "toxic", "n", "at", "f"])

    return run


@dataclass
class Piece:
    """Some chains of the sample: bounds, the tokens and numbers of their chosen features, and token labels."""

    bounds: np.ndarray
    at: np.ndarray
    f: np.ndarray
    y: np.ndarray

    def emission(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.f], minlength=len(self.y)) + bias


def _pieces(n: np.ndarray, hits: np.ndarray, at: np.ndarray, f: np.ndarray, label: np.ndarray) -> list[Piece]:
    """All documents, in pieces of about ``CHAIN`` tokens; a document is never cut.

    ``n`` and ``hits`` are each document's tokens and chosen features, ``at`` counts from a document's start.
    """
    bounds, cuts = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(hits)])
    out, lo = [], 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHAIN, side="right")) - 1)
        part = slice(cuts[lo], cuts[hi])
        here = at[part] + np.repeat(bounds[lo:hi] - bounds[lo], hits[lo:hi])
        y = np.zeros(bounds[hi] - bounds[lo], bool)
        y[here[np.repeat(label[lo:hi] == 1, hits[lo:hi])]] = True
        out.append(Piece(bounds[lo : hi + 1] - bounds[lo], here, f[part], y))
        lo = hi
    return out


def _gradient(piece: Piece, params: list[np.ndarray]) -> list[np.ndarray]:
    """Gradient of one piece's log-likelihood; it holds messages of this piece only."""
    w, bias, trans, start = params
    first = np.zeros(len(piece.y), bool)
    first[piece.bounds[:-1][np.diff(piece.bounds) > 0]] = True
    inner = np.flatnonzero(~first)
    y = piece.y.astype(np.int64)
    seen = np.bincount(y[inner - 1] * 2 + y[inner], minlength=4).reshape(2, 2)
    e = piece.emission(w, bias[0])
    p, forward, back = marginals(e, trans, start, piece.bounds)
    d = y - p
    pair = forward[inner - 1][:, :, None] * np.exp(trans)[None] * (np.stack([np.ones(len(inner)), np.exp(np.clip(e[inner], -30, 30))], 1) * back[inner])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return [np.bincount(piece.f, weights=d[piece.at], minlength=len(w)), np.array([d.sum()]), seen - pair.sum(0), np.array([-d[first].sum(), d[first].sum()])]


def _fit_chain(pieces: list[Piece], size: int, rounds: int) -> list[np.ndarray]:
    """Maximum likelihood with a small quadratic penalty, by Adam, for ``size`` weights."""
    params = [np.zeros(size), np.array([-3.0]), np.zeros((2, 2)), np.zeros(2)]
    penalty = (0.1, 0.0, 0.1, 0.1)
    m1, m2 = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    n = max(sum(len(x.y) for x in pieces), 1)
    for step in range(1, rounds + 1):
        grads = [-c * x for c, x in zip(penalty, params, strict=True)]
        for piece in pieces:
            if len(piece.y):
                grads = [a + b for a, b in zip(grads, _gradient(piece, params), strict=True)]
        for k, g in enumerate(grads):
            g = g / n * 1000
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            params[k] = params[k] + 0.3 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return params


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * b)
    return b


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label may not be learned from; null ids count as held in, but never join a label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 40) -> Model:
    """Fit to the labelled rows that are not held out.

    Feature counts cover all of those rows, copies of a text with one label once. The chain is fitted on at most
    ``sample`` documents of each label, the first in an order by hash of those
    that are there with at most ``SAMPLE_CHARS`` characters; an id takes part
    once, with its shortest text. A label with longer documents only takes part
    with their first ``SAMPLE_CHARS`` characters. Null labels and null texts are left out.
    With no rows of one of the labels the model scores every text 0.
    """
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.where(~held_out("label_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").where("text is not null")
    usable = shared.table(usable, "labels")
    # so few labels are sent to the texts; more bring the texts to the labels, once
    known = F.broadcast(usable) if usable.count() <= BROADCAST_LABELS else usable
    # copies of a text with the same label count once, wherever they lie; each task drops its own before texts are moved
    rows = texts.join(known, "label_id").select("text", "toxic").distinct()
    counted = rows.mapInArrow(_count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = shared.table(counted, "features")
    totals = {r.feature: (r.toxic, r.clean) for r in counted.where("feature < 0").collect()}
    n1, n0 = totals.get(-1, (0, 0))
    empty = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, np.zeros((2, 2)), np.zeros(2), np.array([-50.0, 0, 0]))
    if not n1 or not n0:
        return empty
    odds = F.log((F.col("toxic") + 0.1) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 0.1) / F.lit(n0 + 1.0))
    expected = (F.col("toxic") + F.col("clean")) * (n1 / (n0 + n1))
    # at most one row for each place of the table
    chosen = counted.where((F.col("feature") >= 0) & (F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (F.col("toxic") - expected >= LEAST_SIGMA * F.sqrt(expected))).select("feature").toPandas()["feature"].to_numpy(np.int64)
    chosen = np.sort(chosen)
    # one row for each labelled document that is there: its label and its shortest text's length
    sized = shared.table(texts.join(known, "label_id").groupBy("label_id").agg(F.max("toxic").alias("toxic"), F.min(F.length("text")).alias("size")), "sized")
    ids = None
    for y in (0, 1):
        some = sized.where(F.col("toxic") == y)
        short = some.where(F.col("size") <= SAMPLE_CHARS)
        # long documents take part by their beginnings if a label has no others
        some = (some if short.isEmpty() else short).orderBy(F.xxhash64("label_id"), "label_id").limit(sample).select("label_id", "toxic")
        ids = some if ids is None else ids.unionByName(some)
    # at most `sample` ids of each label, and so many bounded texts
    shortest = F.min(F.struct(F.length("text").alias("size"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))).alias("x")
    picked = texts.join(F.broadcast(ids), "label_id").groupBy("label_id", "toxic").agg(shortest).select("label_id", "toxic", "x.text")
    # tasks read the texts; the driver gets the tokens with chosen features only
    sent = docs.sparkSession.sparkContext.broadcast(chosen)
    read = picked.mapInArrow(_tokens(sent), "label_id long, toxic int, n long, at array<int>, f array<int>").orderBy("label_id").toArrow().combine_chunks()
    n, label, at, f = (read.column(c).combine_chunks() for c in ("n", "toxic", "at", "f"))
    n, label, hits = n.to_numpy(), label.to_numpy(), at.value_lengths().to_numpy()
    pieces = _pieces(n, hits, at.flatten().to_numpy().astype(np.int64), f.flatten().to_numpy(), label)
    w, bias, trans, start = _fit_chain(pieces, len(chosen), rounds)
    x = np.concatenate([inputs(*peaks(marginals(p.emission(w, bias[0]), trans, start, p.bounds)[0], p.bounds)) for p in pieces])
    share = np.array([n0, n1]) / (n0 + n1) / np.maximum(np.bincount(label, minlength=2), 1)
    scale = _logistic(x, label, share[label] * len(label))
    return Model(chosen, w.astype(np.float32), float(bias[0]), trans, start, scale)


def _pad(model: Model) -> Model:
    if len(model.weight) < len(model.index):
        model.weight = np.append(model.weight, np.zeros(len(model.index) - len(model.weight), np.float32))
    return model


def _spans(s: words.Slices, p: np.ndarray, lo: int, hi: int, least: float) -> list[dict]:
    """Runs of tokens of probability ``least`` or more, as offsets in characters."""
    on = np.flatnonzero(p[lo:hi] >= least)
    if not len(on):
        return []
    breaks = np.flatnonzero(np.diff(on) > 1)
    begin, end = on[np.append(0, breaks + 1)], on[np.append(breaks, len(on) - 1)]
    base = int(s.starts[lo])
    return [{"start": int(s.starts[lo + a]) - base, "stop": int(s.ends[lo + b]) - base, "p": float(p[lo + a : lo + b + 1].max())} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _scored(model: Model, table: np.ndarray, texts: list, least: float | None = None) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text and, with ``least``, its spans."""
    most, total, spans = np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
    parts = list(_parts(texts))
    owner = np.array([k for k, _, _ in parts], np.int64)
    for first, count, s, bounds in _groups([part for _, _, part in parts]):
        p, _, _ = marginals(model.emission(s, table), model.trans, model.start, bounds)
        top, expected = peaks(p, bounds)
        np.maximum.at(most, owner[first : first + count], top)
        np.add.at(total, owner[first : first + count], expected)
        if least is not None:
            for i in np.unique(np.searchsorted(bounds, np.flatnonzero(p >= least), side="right") - 1).tolist():
                k, at, part = parts[first + i]
                found = _to_characters(part, _spans(s, p, int(bounds[i]), int(bounds[i + 1]), least))
                spans[k] += [x | {"start": x["start"] + at, "stop": x["stop"] + at} for x in found]
    return model.score(most, total), spans


def _apply(shared_model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model.value
        table = model.table()
        for batch in batches:
            score, spans = _scored(model, table, batch.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())])))],
                ["key", "score", "spans"],
            )

    return run


def _to_characters(text: str, spans: list[dict]) -> list[dict]:
    """Offsets relative to the first word's byte, as offsets of characters of ``text``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    begin = int(np.flatnonzero(words.ALNUM[data])[0])
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [x | {"start": int(before[begin + x["start"]]), "stop": int(before[begin + x["stop"]])} for x in spans]


def tag(docs: DataFrame, model: Model, least: float = 0.5, key: str = "doc_id") -> DataFrame:
    """``(key, score, spans)`` for each row: the toxicity of the whole text and its offending spans.

    ``spans`` are ranges of characters whose tokens are toxic with probability
    ``least`` or more. Null and empty texts have no spans and the score of a
    text without a toxic token. Repeated rows give a row each.
    """
    source = docs.select(F.col(key).alias("key"), F.col("text"))
    kind = source.schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(_pad(model))
    return source.mapInArrow(_apply(sent, least), f"key {kind}, score double, spans array<struct<start:long,stop:long,p:double>>")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` with a model fitted to ``labels``, a row for each row of ``docs``.

    Null and empty texts have the score of a text without a toxic token;
    ``predicted`` is 1 from a score of 0.5 on. Rows that repeat an id are scored
    each by its own text. Without labels of both kinds every score is about 0.
    Other columns are not read.
    """
    out = tag(docs, fit(docs, labels))
    return out.select(
        F.col("key").alias("doc_id"),
        held_out("key").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def _reject(shared_model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model.value
        table = model.table()
        for batch in batches:
            score, _ = _scored(model, table, batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(score < 0.5))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, with all their columns.

    Null and empty texts stay, repeated rows are judged each, and without
    labels of both kinds all rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_pad(fit(docs, labels)))
    return docs.mapInArrow(_reject(sent), docs.schema)
