"""SimHash near-duplicates (operator 9).

A fingerprint has one or more lanes of 64 bits. Deletion-variant signatures find those that are alike: the bits are cut into
segments, and for each segment and each of its bits, the segment with that bit struck out is a key. Two fingerprints that differ by at most
one bit in some segment share a key; all that share one are compared. With more than half as many segments as differing bits that are
allowed, no link can be missed (three segments for four bits, the default).

Keys of one segment are short, and a million fingerprints meet strangers at each. So beyond some millions, a key holds several of more segments,
by every choice of so many (two of five, three of six and so on): for four bits, one choice always differs by at most one, and the links are the same.

A group of near copies is written as a spanning forest, never as all its pairs. A key that more than ``run_cap`` fingerprints share (only
distinct fingerprints are indexed) is not cut short: its members are cut into blocks, and each pair of blocks is compared in a task of its own.

With ``similarity`` set, the fingerprints are those of the set of shingles, as repeats do not count in it either, and what is linked is a
set: only equal sets are one unchecked. The fingerprints' links only propose groups. Jaccard is not transitive, so within a
group every pair counts, whatever the group's size: the members' shingle sets meet in tasks of a bounded number of rows and shingles,
which count the shared shingles of each pair and give back a spanning forest of those that reach the similarity. A group of several blocks
meets its first block, as representatives, before anything else; only members that this leaves outside the largest component then meet all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import broadcast_if_few, give_back, materialize, ship, utf8

RUN_CAP = 4096
_CHUNK = 65536
_SMALL = 64
#: Rows (key, lanes) that one task sorts and compares.
ROWS_PER_TASK = 1_000_000
#: Bits of a segment, at most, whose keys are moved as one row.
PART_BITS = 8
#: Members, and shingles of theirs, in a block whose pairs one task verifies; a larger group has more blocks.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and which of these are linked."""

    shingle_words: int = 4
    lanes: int = 1
    max_bits: int = 4
    segments: int = 3  # in each lane
    similarity: float | None = None
    run_cap: int = RUN_CAP
    joined: int = 1  # segments in a key

    def __post_init__(self):
        if self.keys >= 4095:
            raise ValueError(f"{self.keys} keys a fingerprint; 4094 is the most that a key's number can tell apart")

    @property
    def keys(self) -> int:
        """Keys of a fingerprint: one for each bit of each choice of segments."""
        return 64 * self.lanes * math.comb(self.segments - 1, self.joined - 1)

    def widened(self, n: int) -> Scheme:
        """The scheme for ``n`` fingerprints: as complete, its keys long enough that a fingerprint has the fewest keys and strangers at them in all."""
        if not self.complete or self.lanes > 1 or self.joined > 1:
            return self
        longer = [(j, self.max_bits + j - 1) for j in range(2, 7)]
        known = [self, *[replace(self, joined=j, segments=s) for j, s in longer if s > j and 64 * math.comb(s - 1, j - 1) < 4095]]
        return min(known, key=lambda x: x.keys * (1 + n / 2 ** (64 * x.joined // x.segments - 1)))

    @property
    def node(self) -> str:
        """The column that names what is linked: a fingerprint, or (``node``, a hash) all lanes and the set of shingles."""
        return "fp" if self.similarity is None and self.lanes == 1 else "node"

    @property
    def complete(self) -> bool:
        """Whether the segments are enough to miss no link."""
        least = 2 * (self.segments - self.joined + 1)  # bits that leave no choice of segments with one or none
        if self.joined > 1:
            least = min(least, self.segments - self.joined + 2)
        return least * self.lanes > self.max_bits


#: Five-word shingles at a similarity of 0.8: such pairs differ by 29 of 192 bits on average, three standard deviations from 44.
NEAR_COPIES = Scheme(shingle_words=5, lanes=3, max_bits=44, segments=4, similarity=0.8)


def shingle_hashes(text: bytes | None, shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased (A-Z) word shingles, repeats included; of all words if there are fewer; none without a word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle_words + 1].tolist()
    del words
    return np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further hash lanes: the finalizer of SplitMix64 over the first."""
    if not lane:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """Signed 64-bit number of the bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        counts += np.unpackbits(h[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    value = int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big") if len(h) else 0
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes | None, shingle_words: int = 4) -> int:
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """(doc_id, text_key, fp, fp1, ..., shingles, node) for every row: a hash of the text, a column a lane, hashes of all shingles only with ``similarity``.

    Null texts count as empty.
    """
    ship(docs.sparkSession)
    lanes = lane_names(scheme)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            columns: list[list] = [[] for _ in lanes]
            sets = []
            for x in b.column(1):
                h = shingle_hashes(x.as_py(), scheme.shingle_words)
                if scheme.similarity is not None:
                    h = np.unique(h)
                for k, column in enumerate(columns):
                    column.append(majority(_mixed(h, k)))
                if scheme.similarity is not None:
                    sets.append(np.unique((h >> np.uint64(33)).astype(np.int32)))
            arrays = [b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in columns]]
            del columns
            if scheme.similarity is not None:
                arrays.append(pa.array(sets, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    hashed = ["shingles"] * (scheme.similarity is not None)
    names = ["doc_id", "text_key", *lanes, *hashed]
    schema = ", ".join(f"{c} {'array<int>' if c == 'shingles' else 'long'}" for c in names)
    rows = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text"), F.xxhash64("text").alias("text_key")).mapInArrow(run, schema)
    return rows if scheme.node == "fp" else rows.withColumn("node", F.xxhash64(*lanes, *hashed))


def lane_names(scheme: Scheme) -> list[str]:
    return ["fp", *[f"fp{k}" for k in range(1, scheme.lanes)]]


def choices(scheme: Scheme) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(lane, first, segments) for each choice of segments that are joined to a key: the number of its first bit, and (start, size, place in the key)."""
    cuts = [64 * k // scheme.segments for k in range(scheme.segments + 1)]
    first = 0
    for lane in range(scheme.lanes):
        for chosen in combinations(zip(cuts, cuts[1:], strict=False), scheme.joined):
            place, spans = 0, []
            for start, stop in chosen:
                spans.append((start, stop - start, place))
                place += stop - start
            yield lane, first, spans
            first += place


def segment_parts(scheme: Scheme) -> list[Column]:
    """(value, first, low, width) for each part of a choice of segments: their joined value, the number of the part's first bit, its place in the value."""
    parts, names = [], lane_names(scheme)
    for lane, first, spans in choices(scheme):
        taken = [F.shiftleft(F.shiftrightunsigned(names[lane], start).bitwiseAND(F.lit((1 << size) - 1).cast("long")), place) for start, size, place in spans]
        value, width = reduce(Column.bitwiseOR, taken), sum(size for _, size, _ in spans)
        count = math.ceil(width / PART_BITS)
        lows = [width * k // count for k in range(count + 1)]
        parts += [
            F.struct(value.alias("value"), *[F.lit(x).cast("smallint").alias(n) for n, x in (("first", first + low), ("low", low), ("width", high - low))])
            for low, high in zip(lows, lows[1:], strict=False)
        ]
    return parts


class Forest:
    """Union-find over what one task links; ``add`` says whether an edge joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose lanes are the last axis."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def first_shared(x: np.ndarray, y: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Number of the bit whose key is the first of those that each pair of fingerprints shares; 4095 if none."""
    z = x ^ y
    shared = np.full(z.shape[:-1], 4095, np.int64)
    for lane, first, spans in reversed(list(choices(scheme))):
        value = np.zeros(z.shape[:-1], np.uint64)
        for start, size, place in spans:
            value |= ((z[..., lane] >> np.uint64(start)) & np.uint64((1 << size) - 1)) << np.uint64(place)
        bit = first + np.bitwise_count(value - (value > 0)).astype(np.int64)  # of a power of two, its place
        shared = np.where(np.bitwise_count(value) <= 1, bit, shared)
    return shared


def _link_bits(x: np.ndarray, y: np.ndarray, key_bit: int, scheme: Scheme) -> np.ndarray:
    """Differing bits of the pairs that are linked and that this key is the first to hold; 4095 for the others.

    Each link is thus weighed at one key. Copies share many keys, and would otherwise be linked anew at each.
    """
    d = _apart(x, y)
    near = np.flatnonzero(d <= scheme.max_bits)
    out = np.full(len(d), 4095, np.int64)
    mine = near[first_shared(x[near] if x.ndim == 2 else x, y[near], scheme) == key_bit] if len(near) else near
    out[mine] = d[mine]
    return out


def spanning_links(codes: np.ndarray, key_bit: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of a least spanning forest of the links that a key is the first to hold (Prim)."""
    n, max_bits = len(codes), scheme.max_bits
    linked = np.zeros(n, bool)
    for i in range(0, n, 256):
        near = _apart(codes[i : i + 256, None], codes[None]) <= max_bits
        linked[i : i + 256] |= near.sum(1) > 1
    left = np.flatnonzero(linked)
    out_i, out_j = [], []
    nearest, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(left):
        if not len(best) or best.min() > max_bits:  # start a tree
            now, left = left[0], left[1:]
            best, nearest = _link_bits(codes[now], codes[left], key_bit, scheme), np.full(len(left), now)
            continue
        k = int(best.argmin())
        now = left[k]
        out_i.append(nearest[k])
        out_j.append(now)
        left, best, nearest = np.delete(left, k), np.delete(best, k), np.delete(nearest, k)
        d = _link_bits(codes[now], codes[left], key_bit, scheme)
        nearest, best = np.where(d < best, now, nearest), np.minimum(d, best)
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


def _runs(keys: np.ndarray, ids: np.ndarray, codes: np.ndarray, scheme: Scheme, forest: Forest) -> tuple[list[tuple[int, int]], list[int]]:
    """Links (a, b) within runs of equal keys that the forest does not imply yet; the keys whose runs are over the cap."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    of_row = np.repeat(sizes, sizes)
    small_k, small_i, small = keys[of_row <= _SMALL], ids[of_row <= _SMALL], codes[of_row <= _SMALL]
    found = []
    for d in range(1, min(_SMALL, len(small_k))):
        at = np.flatnonzero(small_k[d:] == small_k[:-d])
        if not len(at):
            break
        near = at[_apart(small[at], small[at + d]) <= scheme.max_bits]
        near = near[first_shared(small[near], small[near + d], scheme) == small_k[near] & 4095]
        found += zip(small_i[near].tolist(), small_i[near + d].tolist(), strict=True)
    for k in np.flatnonzero((sizes > _SMALL) & (sizes <= scheme.run_cap)):
        run = slice(starts[k], starts[k] + sizes[k])
        i, j = spanning_links(codes[run], int(keys[starts[k]]) & 4095, scheme)
        found += zip(ids[run][i].tolist(), ids[run][j].tolist(), strict=True)
    return [e for e in found if forest.add(*e)], keys[starts[sizes > scheme.run_cap]].tolist()


def _in_runs(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Streams rows (key, node, lanes) that are sorted by key; holds a batch, one run of up to the cap and the forest. Yields _FOUND: links, or an oversize key."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, scheme.lanes), np.uint64)
    over: int | None = None  # a run over the cap: its further rows are only passed by
    forest = Forest()

    def out(edges: list[tuple[int, int]], big: list[int]) -> pa.RecordBatch:
        rows = [*[(*e, None) for e in edges], *[(None, None, k) for k in big]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "big"])

    for b in batches:
        rows = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _codes(b, 2 - (scheme.node == "fp"), scheme)
        k, i, c = (np.concatenate(x) for x in zip(held, rows, strict=True))
        if over is not None:
            k, i, c = k[k != over], i[k != over], c[k != over]
        if not len(k):
            held = k, i, c
            continue
        cut = int(np.searchsorted(k, k[-1]))
        edges, big = _runs(k[:cut], i[:cut], c[:cut], scheme, forest) if cut else ([], [])
        held = k[cut:], i[cut:], c[cut:]
        if len(held[0]) > scheme.run_cap:
            over = int(held[0][0])
            big.append(over)
            held = k[:0], i[:0], c[:0]
        if edges or big:
            yield out(edges, big)
    if len(held[0]):
        edges, big = _runs(*held, scheme, forest)
        if edges or big:
            yield out(edges, big)


_FOUND = "a long, b long, big long"


def _codes(batch: pa.RecordBatch | pa.Table, first: int, scheme: Scheme) -> np.ndarray:
    """The lanes, which are the columns from ``first`` on."""
    return np.stack([np.asarray(batch.column(first + x)).view(np.uint64) for x in range(scheme.lanes)], 1)


def _columns(scheme: Scheme) -> list[str]:
    return list(dict.fromkeys([scheme.node, *lane_names(scheme)]))


def key_index(fps: DataFrame, scheme: Scheme, tasks: int | None = None) -> DataFrame:
    """(key, node, lanes) for each bit: its segment with that bit struck out, and the number of the bit.

    With ``tasks``, rows of equal keys share one of so many partitions. Keys that strike out bits of one part agree in the rest of the segment, so one
    row a part is moved and its keys are spelled out where it arrives.
    """
    rows = fps.select(F.explode(F.array(*segment_parts(scheme))).alias("part"), *_columns(scheme)).select("part.*", *_columns(scheme))
    if tasks:
        rows = rows.repartition(tasks, "first", F.expr("value & ~shiftleft(shiftleft(1L, width) - 1L, low)"))
    bits = rows.withColumn("bit", F.explode(F.array(*[F.lit(k) for k in range(PART_BITS)]))).where("bit < width")
    return bits.select(F.expr("shiftleft(value & ~shiftleft(1L, low + bit), 12) | (first + bit)").alias("key"), *_columns(scheme))


def _in_blocks(members: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows of ``members`` for each pair of blocks (key, i, j) that they are in. The number of blocks follows the key's count."""
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(scheme.run_cap / 2)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64(*_columns(scheme)), F.col("blocks")).cast("int"))
    rest = [c for c in members.columns if c != "key"]
    return dealt.select(
        "key", *rest,
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")))).alias("p"),
    ).select("key", "p.i", "p.j", *rest)


def _spanning(edges: DataFrame) -> DataFrame:
    """A spanning forest of the edges in each task of a stated number of them: a group of copies comes with links from every task that held a key of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            new = np.array([forest.add(*e) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], bool)
            yield b.filter(pa.array(new))
        give_back()

    return materialize(edges.repartition(max(1, math.ceil(edges.count() / ROWS_PER_TASK))).mapInArrow(run, "a long, b long"), "spanning")


def links(fps: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """Links (a, b) between nodes that span the components of distinct fingerprints."""
    lanes = lane_names(scheme)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_runs(batches, scheme)
        give_back()

    count = fps.count()
    scheme = scheme.widened(count)
    tasks = max(1, math.ceil(count * scheme.keys / ROWS_PER_TASK))
    found = materialize(key_index(fps, scheme, tasks).sortWithinPartitions("key").mapInArrow(run, _FOUND), "links")
    edges = _spanning(found.where("a is not null").select("a", "b"))
    big = found.where("big is not null").select(F.col("big").alias("key")).distinct()
    if big.isEmpty():
        return edges

    # The exact way for keys over the cap: block i meets block j in a task of its own.
    pairs = _in_blocks(materialize(key_index(fps, scheme).join(big, "key"), "members"), scheme)

    def compare(group: pa.Table) -> pa.Table:
        ids, codes = group.column(scheme.node).to_numpy(), np.stack([group.column(c).to_numpy() for c in lanes], 1)
        order = np.lexsort((ids, *codes.T))
        ids, codes = ids[order], codes[order].view(np.uint64)
        i, j = spanning_links(codes, group.column("key")[0].as_py() & 4095, scheme)
        return pa.table({"a": ids[i], "b": ids[j]})

    return edges.unionByName(pairs.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))


def shared_counts(values: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in ``of``: how many of its members each set holds. Set k is ``values[offsets[k] : offsets[k + 1]]``, without repeats."""
    n = len(offsets) - 1
    order = np.argsort(values, kind="stable")
    ranked, holders = values[order], np.repeat(np.arange(n), np.diff(offsets))[order]
    for x in of.tolist():
        own = values[offsets[x] : offsets[x + 1]]
        first = np.searchsorted(ranked, own, "left")
        many = np.searchsorted(ranked, own, "right") - first
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        yield x, np.bincount(holders[at], minlength=n)


def verified_links(group: pa.Table, similarity: float) -> tuple[list[int], list[int]]:
    """(a, b) of a spanning forest, beyond the roots they come with, of the pairs of a mover and any row that reach the similarity."""
    ids, roots = group.column("node").to_numpy(), group.column("root").to_numpy()
    sets = group.column("shingles").combine_chunks()
    offsets = sets.offsets.to_numpy().astype(np.int64)
    values, offsets = sets.flatten().to_numpy(), offsets - offsets[0]
    sizes = np.diff(offsets)
    forest, a, b = Forest(), [], []
    for node, root in zip(ids.tolist(), roots.tolist(), strict=True):
        forest.add(node, root)
    for x, shared in shared_counts(values, offsets, np.flatnonzero(group.column("mover").to_numpy(zero_copy_only=False))):
        node = int(ids[x])
        for y in ids[shared >= similarity * (sizes[x] + sizes - shared) - 1e-9].tolist():
            if forest.add(node, y):
                a.append(node)
                b.append(y)
    return a, b


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal (g, i, j), the first columns of sorted rows; holds one of them and a batch."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if held and now != tuple(keys[s]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            now = tuple(keys[s])
    if held:
        yield pa.Table.from_batches(held)


def _verified(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links that are found in the tasks (g, i, j) of the dealt members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_task(batches):
            a, b = verified_links(group, similarity)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    rows = dealt.select("g", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "mover", "root", "node", "shingles")
    return materialize(rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a long, b long"), "verified")


def _block_count() -> Column:
    return F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum(F.size("shingles")) / F.lit(BLOCK_SHINGLES))).cast("int")


def _tied_by_similarity(proposed: DataFrame, marked: DataFrame, scheme: Scheme) -> DataFrame:
    """Components of all pairs, within the groups (a, b) that fingerprints propose, whose shingle sets reach the similarity."""
    groups = proposed.select(F.col("a").alias("node"), F.col("b").alias("g")).unionByName(proposed.select(F.col("b").alias("node"), F.col("b").alias("g")).distinct())
    # only the sets of grouped nodes are moved, one each
    of_node = marked.select("node", "shingles").join(broadcast_if_few(materialize(groups, "groups")), "node")
    members = materialize(of_node.groupBy("node").agg(F.first("g").alias("g"), F.first("shingles").alias("shingles")), "members")
    large = materialize(members.groupBy("g").agg(_block_count().alias("blocks")).where("blocks > 1"), "large")
    few = broadcast_if_few(large)
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = members.join(few, "g", "left").withColumn("own", own)
    # the first block's members stand in every task of their group, as representatives
    tasks = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).otherwise(F.array("own"))
    dealt = dealt.withColumn("j", F.explode(tasks)).withColumns({"i": F.lit(0), "mover": F.col("own") == F.col("j"), "root": F.col("node")})
    first = _verified(dealt, scheme.similarity)
    tied = components(first)
    if large.isEmpty():
        return tied
    rooted = members.join(few, "g").join(tied.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "rooted")
    main = rooted.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    outside = materialize(rooted.join(broadcast_if_few(main), "g").where("root <> main").drop("main"), "outside")
    parts = broadcast_if_few(materialize(outside.groupBy("g").agg(_block_count().alias("parts")), "parts"))
    movers = outside.join(parts, "g").select("g", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("mover"), "root", "node", "shingles")
    others = rooted.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("mover"), "root", "node", "shingles")
    return components(first.unionByName(_verified(movers.unionByName(others), scheme.similarity)))


def _rooted(docs: DataFrame, scheme: Scheme, *more: str) -> DataFrame:
    """A row (doc_id, lanes, ``more`` of ``fingerprints``, root) for each row of ``docs``; ``root`` is the same within a component alone."""
    marked = materialize(fingerprints(docs, scheme), "fingerprints")
    lanes = lane_names(scheme)
    distinct = materialize(marked.select(*_columns(scheme)).dropDuplicates([scheme.node]), "distinct")
    tied = components(links(distinct, scheme))
    if scheme.similarity is not None:
        tied = _tied_by_similarity(tied, marked, scheme)
    tied = broadcast_if_few(tied.select(F.col("a").alias(scheme.node), F.col("b").alias("_root")))
    return materialize(marked.join(tied, scheme.node, "left").select("doc_id", *lanes, *more, F.coalesce("_root", scheme.node).alias("root")), "rooted")


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits a lane, and the smallest doc_id that links reach, itself included.

    A row for each row of ``docs``. A null or empty text has fingerprint zero and links like any other. A null doc_id
    takes part but is never the smallest, unless all of its component are null. An empty table gives no rows.
    """
    rooted = _rooted(docs, scheme)
    shared = materialize(rooted.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    digits = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in lane_names(scheme)])
    found = rooted.join(broadcast_if_few(shared), "root", "left")
    return found.select("doc_id", digits.alias("fingerprint"), F.when(F.col("n") > 1, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, scheme: Scheme = NEAR_COPIES) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all columns as they were, whatever their names.

    Of different texts that share this doc_id the one with the smallest hash stays, and of rows that repeat it one. Different texts of one
    doc_id in different components all stay, and so do rows without a doc_id.
    """
    rooted = _rooted(docs, scheme, "text_key").where("doc_id is not null").select("root", F.struct("doc_id", "text_key").alias("who"))
    shared = materialize(rooted.groupBy("root").agg(F.min("who").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    in_shared = materialize(rooted.join(broadcast_if_few(shared.select("root", "first")), "root"), "classes")
    gone = materialize(in_shared.where("who <> first").select("who.*").distinct(), "gone")
    repeated = materialize(in_shared.where("who = first").groupBy("who").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("who.*"), "repeated")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    who = ["doc_id", "text_key"]
    kept = keyed.join(broadcast_if_few(gone), who, "left_anti")
    if not repeated.isEmpty():
        few = broadcast_if_few(repeated)
        again = kept.join(few, who, "left_semi").groupBy(*who).agg(F.first("row").alias("row"))
        kept = kept.join(few, who, "left_anti").select("row").unionByName(again.select("row"))
    return kept.select("row.*")
