"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Which documents share a sequence depends on lengths alone, so the packing
itself is solved on a histogram of at most ``capacity`` counts. The reduction
fixes sets that dominate every alternative (a document too long to pair, a
pair that fills the sequence exactly, the best pair where only one more
document fits, and the two-document rules); best fit places the rest. The
plan is a list of patterns with multiplicities, and each piece finds its place
from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import small_batches, text_of, written

CAPACITY = 1024
END_ID = 2
#: Parts of texts whose ids a worker remembers, the first that it meets.
MEMO = 350_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


#: Which visible character stands for each byte of a byte-level tokenizer, in the order of the bytes it leaves as they are.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: how such a tokenizer divides a text before merging, where every number is a decimal digit.
DIVIDE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
#: Characters of which two pattern libraries may think differently; a text with one of them is encoded whole.
UNSURE = "[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0800-\u200f\u2028-\u202f\u205f-\u209f\u20c0-\U0010ffff]"


def byte_encoder(path: str) -> Callable[[str], bytes]:
    """Encodes a text with the tokenizer file at ``path`` to little-endian unsigned 32-bit ids.

    A byte-level tokenizer without prefix space or normalizer divides a text by a fixed pattern and merges each part on its own:
    here each distinct part goes through the tokenizer's model once while it is remembered. Other tokenizers, and texts that
    hold a special token or a character of an unsure class, are encoded whole. A process makes one encoder for a file and keeps it.
    """
    import json
    import re
    import struct
    import sys
    import types

    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("helixframe_kept", types.ModuleType("helixframe_kept")).__dict__.setdefault("encoders", {})
    if path in kept:
        return kept[path]
    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    before = spec.get("pre_tokenizer") or {}
    divides = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and spec.get("normalizer") is None
    whole = re.compile("|".join([UNSURE, *[re.escape(t["content"]) for t in spec["added_tokens"]]]))
    parts, merge = re.compile(DIVIDE).findall, tokenizer.model.tokenize
    signs = {b: chr(b) for b in VISIBLE}
    signs |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in signs)}

    class Memo(dict):
        def __missing__(self, part: str) -> bytes:
            seen = part if part.isascii() else part.encode().decode("latin-1")
            ids = [t.id for t in merge(seen.translate(signs))]
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(self) < MEMO:
                self[part] = packed
            return packed

    ids_of = Memo().__getitem__

    def encode(text: str) -> bytes:
        if not divides or whole.search(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(ids_of, parts(text)))

    kept[path] = encode
    return encode


def _tokenize(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), byte_encoder(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total, at, piece = len(ids) // 4, 0, 0
                while at < total:
                    size = min(total - at, capacity) if total <= capacity else (total % capacity or capacity) if at == 0 else capacity
                    for column, value in zip(out, (doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), int(seen[size])), strict=True):
                        column.append(value)
                    seen[size] += 1
                    at, piece = at + size, piece + 1
            n = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]], pa.array([part] * n, pa.int32()), pa.array(out[5], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns fixed by dominance, with multiplicities, and the counts that remain.

    For the longest length ``a`` left, with room ``capacity - a``: alone if
    nothing fits beside it; with an exact complement if there is one; with the
    longest that fits if two more never fit; where at most two more fit, with
    the longest single that is no shorter than any fitting pair.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*items: int) -> None:
        need = {n: items.count(n) for n in set(items)}
        times = min(left[n] // c for n, c in need.items())
        fixed.append((items, times))
        for n, c in need.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
                lengths.remove(n)

    def smallest(k: int, without: int) -> int | None:
        """Sum of the ``k`` shortest documents besides one of length ``without``; None if there are fewer."""
        total, need = 0, k
        for n in lengths:
            have = left[n] - (n == without)
            used = min(have, need)
            total, need = total + used * n, need - used
            if not need:
                return total
        return None

    skipped: set[int] = set()
    while candidates := [n for n in reversed(lengths) if n not in skipped]:
        a = candidates[0]
        room = capacity - a
        one = smallest(1, a)
        if one is None or one > room:
            take(a)
            continue
        best = lengths[bisect.bisect_right(lengths, room) - 1]
        if best == a and left[a] < 2:
            best = lengths[bisect.bisect_left(lengths, a) - 1]
        if best == room:
            take(a, best)
            continue
        two, three = smallest(2, a), smallest(3, a)
        if two is None or two > room:
            take(a, best)
            continue
        if three is None or three > room:
            pair = max((x + lengths[j] for x in lengths if (j := bisect.bisect_right(lengths, room - x) - 1) >= 0), default=0)
            if best >= pair:
                take(a, best)
                continue
        skipped.add(a)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on counts, longest first: each length goes to the fullest open sequences that it fits, else to new ones."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                pattern, times, room = (), -(-n // (capacity // length)), capacity
            else:
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            fit = room // length
            full = min(times, n // fit)
            put(pattern + (length,) * fit, full, room - fit * length)
            n, times = n - full * fit, times - full
            if n and times and n < fit:
                put(pattern + (length,) * n, 1, room - n * length)
                n, times = 0, times - 1
            if pattern:
                put(pattern, times, room)
    return [x for bins in open_.values() for x in bins]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Segments of the packing: pieces of ``length`` with ranks from ``first`` on fill ``per`` places a sequence from ``offset``, in ``times`` sequences from ``base``."""
    fixed, rest = reduce_dominated(counts, capacity)
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in fixed + best_fit(rest, capacity):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            per = pattern.count(length)
            rows.append((length, used.get(length, 0), per, base, offset))
            used[length] = used.get(length, 0) + per * times
            offset += per * length
        base += times
    rows.sort()
    names = ("length", "first", "per", "base", "offset")
    return {k: np.asarray([r[i] for r in rows], np.int64) for i, k in enumerate(names)} | {"sequences": np.asarray([base])}


def _place(segments: dict[str, np.ndarray], span: int):
    keys = segments["length"] * span + segments["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (3, 5))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            nth = rank - segments["first"][at]
            sequence = segments["base"][at] + nth // segments["per"][at]
            offset = segments["offset"][at] + nth % segments["per"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of each document with its sequence and place.

    A document is its token ids and ``end_id``. One longer than ``capacity`` is cut into
    pieces of that length, of which the first may be shorter. A null text is
    empty, so it is ``end_id`` alone; a null id stays null; a repeated row is packed
    as often as it stands there; an empty table gives no rows. Only the two named columns are read.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = written(rows.mapInArrow(_tokenize(tokenizer_path, capacity, end_id), PIECES), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    segments = plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    span = max(counts.values(), default=0) + 1
    return ranked.mapInArrow(_place(segments, span), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
