"""N-gram Jaccard self-join by vertical partitioning.

The order of all shingles puts those that many documents share (of licence
lines, headings, passages) last and goes by 64-bit hashes otherwise. Which are
frequent is counted over all documents, in a table of fixed size. Cut into
ranges, the order gives every document its fragments; a comparison counts the
overlap of each fragment separately and sums the counts of the pair.

Only documents that share enough signatures are compared. Which ones are sent
depends on the rule, never on the data:

- Where linked sets differ in few shingles (up to a sixth of them), a set is cut
  into F fragments. Two sets that link differ in at most
  D = (n1 + n2)(q - p)/(q + p) shingles, so at least F - D fragments are equal in
  both; each fragment is a signature. F follows from the size of the set: sizes
  are cut into bands, and a set that can be similar to sets of the next band also
  sends that band's signatures. F exceeds D by the signatures that a pair must
  share at least, and by some empty fragments, which are not sent. Frequent
  shingles have a fragment of their own, which is never sent; a document with
  little but frequent shingles sends the fragments of the plain cut as well.
- Where they may differ in more, fragments would be small and many. Then the
  shingles at the front of the order are the signatures. A set of n shingles has
  ceil(p n / q) in common with any set that it links to, so the first
  n - ceil(p n / q) + s of each hold at least s common ones, and s grows with n.

Signatures that one set alone sent go, and so do sets that are left with fewer
than they need. Of what is left a set keeps the rarest, so many that a pair with
enough in common still meets in one.

Exact copies of a set are one node. Large groups are never expanded into all
pairs: each signature links its members to its least one, links that hold are
contracted, and only members that are then still apart are compared, those of
large signatures in blocks. A frequent shingle's members are dealt over many
keys first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import shared, words
from tidelog.llm.components import components

#: Places of the table in which shingles are counted, as a power of 2, and the share of documents, and their number, from which a place is frequent.
PLACE_BITS = 22
FREQUENT_SHARE = 0.001
FREQUENT_LEAST = 8
#: Members of the most frequent shingles are dealt over so many keys at most, as a power of 2.
MOST_SALTS = 12
#: Times that nodes with too few common shingles are taken out; more would only leave fewer to compare.
ROUNDS = 2
#: Up to so many nodes a table of bits tells tasks which documents' shingles are needed; more are joined.
FILTER_NODES = 1 << 19
#: Members of a signature up to which its pairs across components are counted one by one; of larger ones they are counted in blocks.
FEW = 32
#: Ranges of the shingle order in which overlaps are counted.
FRAGMENTS = 16
#: A block of the last comparison holds about so many sets and shingles at most.
BLOCK_SETS = 512
BLOCK_GRAMS = 1 << 20
#: Keys that the members of one group are dealt over when they look up its size.
GROUP_SALTS = 32


@dataclass(frozen=True)
class Rule:
    """``k`` words a shingle; linked when ``q * intersection >= p * union``."""

    k: int = 3
    p: int = 90
    q: int = 100

    def by_fragments(self) -> bool:
        """Whether signatures are fragments: linked sets differ in a sixth of their shingles at most."""
        return 6 * (self.q - self.p) <= self.q

    def bands(self) -> np.ndarray:
        """Lower ends of the bands of set sizes, the same for every document."""
        ends, x = [1], 1
        while x < 1 << 36:
            x = max(x + 1, -(-x * self.q**2 // self.p**2))
            ends.append(x)
        return np.array(ends, np.int64)

    def differ(self, largest: np.ndarray) -> np.ndarray:
        """Shingles in which linked sets of at most ``largest`` each differ at most."""
        return 2 * largest * (self.q - self.p) // (self.q + self.p)

    def shared(self, largest: np.ndarray) -> np.ndarray:
        """Signatures that linked sets share at least."""
        return 1 + self.differ(largest) // 12

    def cuts(self, largest: np.ndarray) -> np.ndarray:
        return -(-(self.differ(largest) + self.shared(largest) + 1) * 8 // 7)

    def blanks(self, largest: np.ndarray) -> np.ndarray:
        """Empty fragments that may be left out."""
        return self.cuts(largest) - self.differ(largest) - self.shared(largest)

    def needed(self, band: Column, n: Column) -> Column:
        """Signatures of a band that a set of ``n`` shingles shares with any set that it links to.

        Of the band's fragments those that differ go, as many as with the
        largest such set, and the empty ones that are left out.
        """
        top = self.bands()[1:] - 1
        kept = [int(x) for x in self.cuts(top) - self.blanks(top)]
        other = F.least(F.floor(n * self.q / self.p), F.element_at(F.lit([int(x) for x in top]), band + 1))
        return F.element_at(F.lit(kept), band + 1) - F.floor((n + other) * (self.q - self.p) / (self.q + self.p))

    def common(self, n: np.ndarray) -> np.ndarray:
        """Shingles that a set of ``n`` has in common at least with one that it links to."""
        return -(-n * self.p // self.q)

    def kept(self, n: np.ndarray) -> np.ndarray:
        """Of those, how many a set of ``n`` is to send at least."""
        return 1 + n * (self.q - self.p) // self.q // 2

    def sent(self, n: np.ndarray) -> np.ndarray:
        """Shingles that a set of ``n`` sends; none if it links to equal sets only."""
        alone = (self.common(n) == n) & (n * self.q // self.p == n)
        return np.where(alone, 0, n - self.common(n) + self.kept(n))

    def needed_at_front(self, n: Column) -> Column:
        """Sent shingles that a set of ``n`` shares with any set that it links to: what the least of them shares."""
        least = F.ceil(n * self.p / self.q)
        return 1 + F.floor(F.floor(least * (self.q - self.p) / self.q) / 2)

    def linked(self, both: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return self.q * both >= self.p * (n1 + n2 - both)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 between bounds, 0 for empty ones."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _nodes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, from two independent sums of hashes."""
    n = np.diff(bounds).astype(np.uint64)
    one = _sums(words.mix(h ^ np.uint64(0x5851F42D4C957F2D)), bounds)
    two = _sums(words.mix(h ^ np.uint64(0x14057B7EF767814F)), bounds)
    return words.mix(words.mix(one + n) ^ (two * np.uint64(0x2545F4914F6CDD1D)))


def _sets(texts: list, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, count, found, bounds in words.hashed(texts, words.NOT_SPACE):
        h, at = words.gram_sets(found, bounds, k)
        yield first, count, h, at, _nodes(h, at)


def _fingerprints(k: int):
    """Size and fingerprint of each document; after them, the frequent places of the task's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, docs = np.zeros(1 << PLACE_BITS, np.int32), 0
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, count, h, at, nodes in _sets(batch.column(1).to_pylist(), k):
                n[first : first + count] = np.diff(at)
                node[first : first + count] = nodes.view(np.int64)
                place, times = np.unique(_place(h), return_counts=True)
                often[place] += times.astype(np.int32)
            docs += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node), pa.nulls(len(n), pa.int32())], ["doc_id", "n", "node", "place"])
        hot = np.flatnonzero(often >= max(FREQUENT_LEAST, FREQUENT_SHARE * docs)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), pa.array(often[hot].astype(np.int64)), pa.nulls(len(hot), pa.int64()), pa.array(hot)], ["doc_id", "n", "node", "place"])

    return run


def _place(h: np.ndarray) -> np.ndarray:
    return (words.mix(h) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _signatures(rule: Rule, frequent):
    """``(sig, salt, node)`` for the fragments of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a set send it once a task
        level = np.frombuffer(frequent.value, np.uint8)
        ends = rule.bands()
        for batch in batches:
            for _, count, h, at, nodes in _sets(batch.column(0).to_pylist(), rule.k):
                n = np.diff(at)
                fresh = np.zeros(len(n), bool)
                for i, node in enumerate(nodes.tolist()):
                    if n[i] and node not in seen:
                        seen.add(node)
                        fresh[i] = True
                if not fresh.any():
                    continue
                band = np.searchsorted(ends, n, side="right") - 1
                owner = np.repeat(np.arange(count), n)
                rare = level[_place(h)] == 0
                out = []
                for up in (0, 1):
                    send = fresh & (band >= 0)
                    if up:
                        send &= rule.q * n >= rule.p * ends[band + 1]
                    largest = ends[band + up + 1] - 1
                    # sets that cannot differ at all are one node already
                    send &= rule.differ(largest) > 0
                    spare = rule.blanks(largest)
                    cut = rule.cuts(largest)
                    rows, blank = _fragments(h[rare], owner[rare], nodes, send, cut, band + up, 0, None)
                    out.append(rows)
                    out.append(_fragments(h, owner, nodes, send & (blank > spare), cut, band + up, 1, spare)[0])
                sig, node = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.zeros(len(sig), np.int32)), pa.array(node)], ["sig", "salt", "node"])

    return run


def _fragments(h, owner, nodes, send, cut, band, family: int, spare) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """``(signatures, nodes)`` of the fragments that are not empty, and each document's number of empty ones.

    With ``spare``, a document with more empty fragments than that sends them
    too. A signature's lowest seven bits are its band.
    """
    count = len(send)
    cuts = np.where(send, cut, 0)
    keep = send[owner]
    g, owner = h[keep], owner[keep]
    place = ((g >> np.uint64(32)) * cut[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    # fragments of one document follow one another, as its shingles are in order
    base = np.concatenate([[0], np.cumsum(cuts)])
    bounds = np.searchsorted(base[owner] + place, np.arange(base[-1] + 1))
    of = np.repeat(np.arange(count), cuts)
    place = np.arange(base[-1]) - base[of]
    filled = np.diff(bounds) > 0
    blank = np.bincount(of, weights=~filled, minlength=count)
    if spare is not None:
        filled |= (blank > spare)[of]
    sig = words.mix(_sums(words.mix(g), bounds) + words.mix(place.astype(np.uint64) * np.uint64(1 << 20) + (2 * band[of] + family).astype(np.uint64)))
    sig = sig & ~np.uint64(127) | band[of].astype(np.uint64)
    return (sig[filled].view(np.int64), nodes[of][filled].view(np.int64)), blank


def _front(rule: Rule, frequent):
    """``(sig, salt, node)`` for the shingles at the front of each set; those of frequent places are dealt over ``salt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a set send it once a task
        level = np.frombuffer(frequent.value, np.uint8)
        for batch in batches:
            for _, _, h, at, nodes in _sets(batch.column(0).to_pylist(), rule.k):
                n = np.diff(at)
                send = rule.sent(n)
                for i in np.flatnonzero(send):
                    if (node := int(nodes[i])) in seen:
                        send[i] = 0
                    else:
                        seen.add(node)
                keep = np.repeat(send > 0, n)
                if not keep.any():
                    continue
                n, send, nodes, h = n[send > 0], send[send > 0], nodes[send > 0], h[keep]
                bounds = np.concatenate([[0], np.cumsum(n)])
                owner = np.repeat(np.arange(len(n)), n)
                parts = level[_place(h)]
                rare = np.concatenate([[0], np.cumsum(parts == 0)])
                before = rare[:-1] - rare[bounds[:-1]][owner]
                place = np.where(parts == 0, before, np.diff(rare[bounds])[owner] + np.arange(len(h)) - bounds[:-1][owner] - before)
                keep = place < send[owner]
                node, parts = nodes[owner[keep]], parts[keep].astype(np.uint64)
                salt = node & ((np.uint64(1) << parts) - np.uint64(1))
                # frequent shingles have salts from 1 on
                salt = np.where(parts > 0, salt + np.uint64(1), np.uint64(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(salt), pa.array(node.view(np.int64))], ["sig", "salt", "node"])

    return run


def _levels(counts: pd.DataFrame, documents: int) -> bytes:
    """A byte for each place: 0, or the power of 2 that its shingles' members are dealt over."""
    out = np.zeros(1 << PLACE_BITS, np.uint8)
    share = counts["n"].to_numpy(np.float64) / max(FREQUENT_LEAST, FREQUENT_SHARE * documents)
    out[counts["place"].to_numpy(np.int64)] = np.clip(np.ceil(np.log2(np.maximum(share, 1))), 1, MOST_SALTS)
    return out.tobytes()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (sig, salt, node): those of each salted shingle and of each other one with several nodes, once each."""
    last, leader, alone = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, salt, node = (batch.column(i).to_numpy() for i in range(3))
        start = np.ones(len(sig), bool)
        start[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
        start[0] = last is None or (sig[0], salt[0]) != last[:2]
        again = np.zeros(len(sig), bool)
        again[1:] = ~start[1:] & (node[1:] == node[:-1])
        again[0] = not start[0] and node[0] == last[2]
        keep = ~again & ((salt > 0) | ~start)
        at = np.maximum.accumulate(np.where(start, np.arange(len(sig)), -1))
        follow = np.flatnonzero(keep & (salt == 0))
        # the first node of a shingle goes out with its second
        group, first = np.unique(at[follow], return_index=True)
        led = follow[first][(group >= 0) | alone]
        group = group[(group >= 0) | alone]
        lead = np.where(group >= 0, node[np.maximum(group, 0)], leader)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig[keep], sig[led]])), pa.array(np.concatenate([node[keep], lead.astype(np.int64)]))], ["sig", "node"])
        inside = at == at[-1]
        alone = not (keep & inside).any() and (alone or at[-1] >= 0)
        if at[-1] >= 0:
            leader = node[at[-1]]
        last = (sig[-1], salt[-1], node[-1])


def _gram_rows(k: int, wanted=None):
    """Shingles of each document by fragment of their order; of those whose node's bit is set, if bits are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.unpackbits(np.frombuffer(wanted.value, np.uint8)).view(bool)
        for batch in batches:
            for _, count, h, at, nodes in _sets(batch.column(0).to_pylist(), k):
                n = np.diff(at)
                if bits is not None:
                    keep = bits[(nodes >> np.uint64(64 - PLACE_BITS)).astype(np.int64)]
                    if not keep.any():
                        continue
                    h, nodes, n, count = h[np.repeat(keep, n)], nodes[keep], n[keep], int(keep.sum())
                owner = np.repeat(np.arange(count), n)
                slot = owner * FRAGMENTS + (h >> np.uint64(60)).astype(np.int64)
                bounds = np.searchsorted(slot, np.arange(count * FRAGMENTS + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes.view(np.int64), FRAGMENTS)), pa.array(np.repeat(n, FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), count)), lists],
                    ["node", "n", "fragment", "grams"],
                )

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``left`` with each of ``right``.

    The order of the shingles is cut into fragments; each adds the overlaps
    that it holds.
    """
    both = len(left)
    sets = [*left, *right]
    h = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    h, code = np.unique(h, return_inverse=True)
    use = (np.bincount(code[owner < both], minlength=len(h)) > 0) & (np.bincount(code[owner >= both], minlength=len(h)) > 0)
    column = np.cumsum(use) - 1
    keep = use[code]
    owner, code = owner[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, int(use.sum()), 4096):
        a, b = np.searchsorted(code, [start, start + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], code[a:b] - start] = 1
        total += m[:both] @ m[both:].T
    return total.astype(np.int64)


def _blocks(rule: Rule):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between different components of one pair of blocks, as a forest."""
        pdf = pdf.sort_values(["node", "fragment"])
        docs = pdf.drop_duplicates("node")
        grams = {node: np.concatenate([np.asarray(x, np.int64) for x in g]) for node, g in pdf.groupby("node", sort=False)["grams"]}
        x, y = docs[docs.part == docs.i], docs[docs.part == docs.j]
        both = _overlaps([grams[v] for v in x.node], [grams[v] for v in y.node])
        apart = x.component.to_numpy()[:, None] != y.component.to_numpy()[None, :]
        hit = rule.linked(both, x.n.to_numpy()[:, None], y.n.to_numpy()[None, :]) & apart & (both > 0)
        a, b = np.nonzero(hit)
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                v = root[v]
            return v

        found = []
        for u, v in zip(x.component.to_numpy()[a], y.component.to_numpy()[b], strict=True):
            u, v = find(int(u)), find(int(v))
            if u != v:
                root[max(u, v)] = min(u, v)
                found.append((max(u, v), min(u, v)))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def fingerprints(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, node, place)``: size and fingerprint of each document's set of shingles.

    Rows with a ``place`` are none of documents: they hold how many documents
    of a task have a shingle there, where that is frequent.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(_fingerprints(k), "doc_id long, n long, node long, place int")


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """``(doc_id, n_shingles, component_id)``, a row for each row of ``docs``.

    ``component_id`` is the least id that links of the rule reach. Words are
    runs of anything but ASCII white space, with A-Z lowered; a document of
    fewer than ``k`` words has its whole sequence as its one shingle. Null,
    empty and blank texts have no shingles and link with nothing. Documents
    without an id link with nothing, and their component is null. Rows that
    repeat an id give a row each. Other columns are not read. Sets are told
    apart by 64-bit fingerprints, and shingles by 64-bit hashes.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    both = shared.table(fingerprints(source, rule.k), "sets")
    prints = both.where("place is null").drop("place")
    sizes = prints.where("n > 0").groupBy("node").agg(F.max("n").alias("n"))
    documents = prints.count()
    # at most a byte for each place is broadcast
    often = both.where("place is not null").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") >= max(FREQUENT_LEAST, FREQUENT_SHARE / 2 * documents))
    sent = docs.sparkSession.sparkContext.broadcast(_levels(often.toPandas(), documents))
    usable = source.where("doc_id is not null and text is not null")

    # 1. Signatures of each set, and their members.
    cut = _signatures if rule.by_fragments() else _front
    rows = usable.select("text").mapInArrow(cut(rule, sent), "sig long, salt int, node long")
    member = rows.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "node").mapInArrow(_members, "sig long, node long")
    member = shared.table(member, "members")
    # a link takes several common signatures, of one band if they are fragments: nodes with fewer go, and signatures of one node
    band = F.col("sig").bitwiseAND(127).cast("int") if rule.by_fragments() else F.lit(0)
    needed = rule.needed(F.col("band"), F.col("n")) if rule.by_fragments() else rule.needed_at_front(F.col("n"))
    for _ in range(ROUNDS):
        left = member.select("sig", "node", band.alias("band"))
        enough = left.groupBy("node", "band").agg(F.count(F.lit(1)).alias("sigs")).join(sizes, "node").select("node", "band", (F.col("sigs") - needed).alias("spare")).where("spare >= 0")
        left = left.join(enough, ["node", "band"])
        left = left.join(left.groupBy("sig").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "sig")
        member = shared.replace(member, left, "members")
    # of a node's signatures those that it need not share suffice, and one more: the rarest
    order = Window.partitionBy("node", "band").orderBy("times", "sig")
    left = member.withColumn("place", F.row_number().over(order)).where("place <= spare + 1").select("sig", "node")
    member = shared.replace(member, left, "members")
    # what is one node's alone by now brings nobody together
    least = member.groupBy("sig").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("a")).where("times > 1").drop("times")
    member = shared.replace(member, member.join(least, "sig"), "members")
    stars = member.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    stars = shared.table(stars, "stars")

    # 2. The shingles of the nodes that may be linked, from one document of each.
    nodes = shared.table(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    kind = "node long, n long, fragment int, grams array<long>"
    if nodes.count() <= FILTER_NODES:
        bits = np.zeros(1 << PLACE_BITS, np.uint8)
        places = nodes.select(F.shiftrightunsigned("node", 64 - PLACE_BITS).alias("place")).distinct()
        bits[places.toPandas()["place"].to_numpy(np.int64)] = 1
        wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
        grams = usable.select("text").mapInArrow(_gram_rows(rule.k, wanted), kind)
    else:
        first = prints.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        chosen = first.join(nodes, "node", "left_semi").select("doc_id")
        grams = usable.join(chosen, "doc_id", "left_semi").select("text").mapInArrow(_gram_rows(rule.k), kind)
    # an id may stand on several texts, and a node on several documents: only nodes that were asked for, once each
    grams = grams.join(nodes, "node", "left_semi").dropDuplicates(["node", "fragment"])
    grams = shared.table(grams, "grams")
    shared.drop(nodes)

    # 3. Stars that hold.
    sizes = grams.where("fragment = 0").select("node", "n")
    links = shared.table(_verified(stars, grams, sizes, rule), "links")
    joined = components(links)
    shared.drop(links, stars)

    # 4. Signatures whose members are still apart: their pairs across components.
    label = joined.select("node", "component")
    held = member.select("sig", "node").join(label, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("c"))
    held = shared.replace(member, held, "held")
    still = held.groupBy("sig").agg(F.count(F.lit(1)).alias("times"), F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    few = held.join(still.where(F.col("times") <= FEW).select("sig"), "sig")
    pairs = few.select("sig", F.col("node").alias("a"), F.col("c").alias("c_a")).join(few.select("sig", F.col("node").alias("b"), F.col("c").alias("c_b")), "sig").where("a < b and c_a <> c_b")
    more = shared.table(_verified(pairs.select("a", "b"), grams, sizes, rule), "more")
    whole = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    # of larger signatures the members that are apart, in blocks
    many = shared.table(held.join(still.where(F.col("times") > FEW).select("sig", "least"), "sig").select("node", "c", "least").distinct(), "apart")
    shared.drop(held)
    if not many.isEmpty():
        blocks = _apart(many, grams, sizes, rule)
        last = components(whole.unionByName(blocks))
        shared.drop(blocks)
    else:
        last = components(whole)
    shared.drop(joined, more, many, grams)
    return _answer(prints, last)


def _verified(pairs: DataFrame, grams: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs (a, b)`` that link: overlaps by fragment, summed for each pair."""
    left = grams.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = grams.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b"))

    def sized(df: DataFrame) -> DataFrame:
        return df.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")

    likely = sized(pairs.distinct()).where(rule.q * F.least("n_a", "n_b") >= rule.p * F.greatest("n_a", "n_b")).select("a", "b")
    partial = likely.join(right, "b").join(left, ["a", "fragment"]).select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("both"))
    summed = sized(partial.groupBy("a", "b").agg(F.sum("both").alias("both")))
    return summed.where(rule.q * F.col("both") >= rule.p * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _apart(many: DataFrame, grams: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Links between components ``c`` of nodes that meet in a signature, given with its least component."""
    groups = components(many.where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b")))
    member = many.select("node", F.col("c").alias("component")).distinct()
    member = member.join(groups.select(F.col("node").alias("component"), F.col("component").alias("group")), "component").join(sizes, "node")
    spread = member.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("parts"))
    # a large group's members are dealt over many keys on their way to its number of parts
    salts = F.explode(F.sequence(F.lit(0), F.lit(GROUP_SALTS - 1)))
    member = member.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(0)), F.lit(GROUP_SALTS)).cast("int")).join(spread.withColumn("salt", salts), ["group", "salt"])
    member = member.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a pair of blocks (i <= j) gets the members of both
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    member = member.select("group", "node", "component", "part", F.explode(other).alias("o")).select("group", "node", "component", "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
    work = member.join(grams, "node")
    found = shared.table(work.groupBy("group", "i", "j").applyInPandas(_blocks(rule), "a long, b long").distinct(), "blocks")
    shared.drop(groups)
    return found


def _answer(prints: DataFrame, joined: DataFrame) -> DataFrame:
    """Components of nodes, as the least ids of their documents."""
    first = prints.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    least = joined.join(first, "node").groupBy("component").agg(F.min("first").alias("least"))
    label = first.join(joined, "node", "left").join(least, "component", "left").select("node", F.coalesce("least", "first").alias("component_id"))
    out = prints.where("doc_id is not null and n > 0").join(label, "node", "left")
    rest = prints.where("doc_id is null or n = 0").withColumn("component_id", F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(rest.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def first_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` whose id is the least of their component, with all their columns.

    Documents without shingles or without an id all stay. Rows that repeat a
    kept id stay as often as they are there.
    """
    gone = shared.unused(docs, "gone")
    copies = jaccard_components(docs, rule).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies, docs["doc_id"].cast("long") == F.col(gone), "left_anti").select(*docs.columns)
