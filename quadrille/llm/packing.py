"""Best-fit packing (operator 2).

Documents are tokenised, ended by a separator, cut into pieces of at most the sequence length, and packed best-fit
decreasing: a segment tree over remaining capacities finds the tightest open sequence in logarithmic time.

The packing is one for the whole table. Best-fit decreasing depends on nothing but how many pieces there are of each length, so it runs on that
histogram, at most a number a length, and gives a short plan: which ranks of a length go to which run of sequences, and where in them. A piece finds its rank by
counting: within its task as it is tokenised, and by prefix sums of the tasks' counts. No key gathers rows, so equal rows and common lengths do no harm.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_few, give_back, materialize, ship

SEQUENCE_LENGTH = 1024
SEPARATOR = 2

#: Texts with a run of one kind of character longer than this go to ``tokenizers``, whose splitter does not backtrack over it.
_LONG_RUN = 20_000

_encoders: dict[str, Callable[[str], bytes]] = {}


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file as ranks, if its ids follow the order of its merges; else None."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    vocab, letters = model["vocab"], _byte_of_letter()
    joined = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if joined != sorted(set(joined)) or (joined and joined[0] < 256):
        return None
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if token not in special}
    return ranks if len(ranks) == 256 + len(joined) else None


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to the bytes of its unsigned little-endian 32-bit ids, as ``tokenizers`` gives them: spellings of added tokens get their own ids.

    ``path`` is a file of the ``tokenizers`` library. Where its ids follow its merges, ``tiktoken`` finds the same ids in a fifth of
    the time.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        by_tokenizers = lambda text: array("I", slow.encode(text, add_special_tokens=False).ids).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _as_ranks(spec)
        if ranks is None:
            _encoders[path] = by_tokenizers
        else:
            import tiktoken

            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            added = "".join(f"|{re.escape(t['content'])}" for t in spec.get("added_tokens", ()))
            special = re.compile(added[1:] or r"(?!)").search
            long_run = re.compile(rf"\s{{{_LONG_RUN}}}|[^\W\d_]{{{_LONG_RUN}}}|\d{{{_LONG_RUN}}}|[^\s\w]{{{_LONG_RUN}}}").search
            _encoders[path] = lambda text: by_tokenizers(text) if special(text) or len(text) >= _LONG_RUN and long_run(text) else array("I", fast(text)).tobytes()
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids; only the first may be shorter than ``size`` if there are several."""
    first = total % size or min(total, size)
    return [(0, first)] + [(s, size) for s in range(first, total, size)] if total else []


class CapacityTree:
    """Segment tree over remaining capacities 0..size: a node says how many runs of open sequences lie below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, run: tuple[int, int]) -> None:
        """Open a run (first sequence, how many) of this capacity."""
        self.runs[capacity].append(run)
        node = self.leaves + capacity
        while node:
            self.open[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that an open sequence has, or -1. O(log size)."""
        node = self.leaves + need
        if self.open[node]:
            return need
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not self.open[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return -1

    def take(self, capacity: int) -> tuple[int, int]:
        node = self.leaves + capacity
        while node:
            self.open[node] -= 1
            node >>= 1
        return self.runs[capacity].pop()


def pack_counts(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length, as rows (length, first, sequences, each, sequence, offset).

    The pieces of this length with ranks from ``first`` on fill as many ``sequences`` from number ``sequence`` on, ``each`` one after another from ``offset``. All pieces of a
    length that go to the tightest capacity do what they would do one by one: what is left of a sequence is tighter still, so it takes as many as fit before the next.
    The rows, and the work, follow the number of lengths and not the counts.
    """
    tree, plan, used = CapacityTree(size), [], 0
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity = size
                sequence, many = used, -(-left // (size // length))
                used += many
            else:
                sequence, many = tree.take(capacity)
            each = capacity // length
            for n, k in ((min(many, left // each), each), (1, left % each)):
                if not n or not k or not many or not left:
                    continue
                plan.append((length, first, n, k, sequence, size - capacity))
                if room := capacity - k * length:
                    tree.add(room, (sequence, n))
                first, left, sequence, many = first + n * k, left - n * k, sequence + n, many - n
            if many:
                tree.add(capacity, (sequence, many))
    return plan


class Plan:
    """The rows of ``pack_counts`` for look-up by (length, rank)."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]]):
        self.rows = np.array(rows, np.int64).reshape(-1, 6)
        lengths = self.rows[:, 0]
        self.of = {int(n): slice(*np.searchsorted(-lengths, [-n, -n + 1]).tolist()) for n in np.unique(lengths)}

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            _, first, _, each, sequence, offset = self.rows[self.of[n]].T
            row = np.searchsorted(first, ranks[at], "right") - 1
            nth = ranks[at] - first[row]
            sequences[at] = sequence[row] + nth // each[row]
            offsets[at] = offset[row] + nth % each[row] * n
        return sequences, offsets


def pack_lengths(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, for lengths that fall."""
    given = np.array(lengths, np.int64)
    seen: Counter[int] = Counter()
    ranks = np.zeros(len(given), np.int64)
    for i, n in enumerate(lengths):
        ranks[i], seen[n] = seen[n], seen[n] + 1
    sequences, offsets = Plan(pack_counts(seen, size)).places(given, ranks)
    return sequences.tolist(), offsets.tolist()


def tokenized_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE_LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (bytes of unsigned little-endian 32-bit numbers), and the task and the piece's rank among those of its length there.

    A null or empty text is the separator alone. Rows that repeat are separate documents; other columns are ignored.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    ship(docs.sparkSession)
    end = array("I", [separator]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64())])
        task, seen = TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows: list[tuple] = []
                b = whole.slice(at, 256)
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    for k, (s, n) in enumerate(cut_points(len(ids) // 4, size)):
                        rows.append((doc, k, s, n, ids[4 * s : 4 * (s + n)], task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task int, nth long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE_LENGTH, separator: int = SEPARATOR, with_ids: bool = True) -> DataFrame:
    """Pack whole documents into sequences of at most ``size`` token ids.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves
    as an array if ``with_ids``. An empty table gives no rows. Null texts count as empty; a repeated row is packed as often
    as it stands there. Pieces of one length go in the order of the table's tasks and rows.
    """
    import pyarrow as pa

    pieces = tokenized_pieces(docs, tokenizer or default_tokenizer(), size, separator)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    # written once: the ranks hold for these rows whatever is run again
    pieces = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).select(*kept, "task", "nth"), "pieces")
    counts = materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    # a row a length
    plan = Plan(pack_counts({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(broadcast_if_few(before), ["task", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("rank"))
    names = [*kept, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequences, offsets = plan.places(b.column(3).to_numpy(), b.column(len(kept)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(sequences), pa.array(offsets)], names=names)

    packed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")
    if not with_ids:
        return packed
    hexed = F.hex("ids")
    at = lambda i, k: F.conv(F.substring(hexed, i * 8 + 1 + 2 * k, 2), 16, 10).cast("int")
    one = lambda i: at(i, 0) + at(i, 1) * 256 + at(i, 2) * 65536 + at(i, 3) * 16777216
    return packed.withColumn("ids", F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), one))
