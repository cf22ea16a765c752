"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by MinHash banding.

Documents with the same n-gram set are one class representative. Band hashes
are the shuffle key that brings candidates together. A bucket names its least
member; representatives that lead to the same least one share a cell, and two
cells meet only where a bucket has members in both, so every pair that shares a
band is compared on full n-gram sets, and a chain of unlike texts costs what its
links cost. A cell over its bounds is cut, first along its buckets and then by hash. A task returns sums and a spanning
star, never pairs. N-grams are held as 64-bit hashes: two unlike sets agree
in an n-gram by accident about once in 10^19 pairs of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import lookup, small_batches, text_of, written
from helixframe.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
#: Chance that a pair right at the threshold shares a band, and hash functions at most.
RECALL, MAX_HASHES = 0.9999, 192
#: Members and n-grams of one cell.
CELL_DOCS, CELL_GRAMS = 256, 400_000
#: Words whose hashes a worker remembers.
MEMO = 200_000
#: n-grams hashed at once, columns of a dense block.
CHUNK, COLUMNS = 8192, 4096


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: of the row counts whose bands reach ``recall`` at ``threshold`` within ``max_hashes``, the most rows, which give the fewest false candidates."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def gram_set(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams; words are runs of non-space in lower case, and a text with fewer is one n-gram of all its words."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, np.uint64(n) * np.uint64(0x9E3779B97F4A7C15 % 2**62))
    for i in range(n):
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - n + 1 + i]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0x94D049BB133111EB)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def band_hashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """MinHash values under the functions a * x + b (32 bits), hashed by band."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), CHUNK):
        part = x[start : start + CHUNK]
        for i in range(0, len(a), 32):
            low[i : i + 32] = np.minimum(low[i : i + 32], (a[i : i + 32, None] * part[None, :] + b[i : i + 32, None]).min(1))
    rows = low.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows.shape[1]):
        out = (out ^ rows[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _sign(words: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(seed)
        a = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        hashes = WordHashes()
        for batch in batches:
            prints, sizes, signed = [], [], []
            for text in batch.column(2):
                grams = gram_set(text.as_py(), hashes, words)
                prints.append(xxhash.xxh3_128_hexdigest(grams.tobytes()))
                sizes.append(len(grams))
                signed.append(band_hashes(grams, a, b, bands) if len(grams) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.string()), pa.array(sizes, pa.int64()), pa.array(signed, pa.list_(pa.int64()))], names=["id", "th", "fp", "grams", "bands"])

    return run


def _sets(words: int):
    """Turns (fp, copies, grams, task, text) into the n-gram set; a row with the same id but another text is none of the representative's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            keep, sets = [], []
            for i, (fp, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3), strict=True)):
                raw = gram_set(text.as_py(), hashes, words).tobytes()
                if xxhash.xxh3_128_hexdigest(raw) == fp:
                    keep.append(i)
                    sets.append(raw)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sets, pa.binary())], names=["fp", "copies", "tasks", "grams"])

    return run


def links_within(sets: list[np.ndarray], sides: list[int], threshold: float) -> np.ndarray:
    """Which sets are linked: a boolean matrix. Sides 1 and 2 are compared with each other only, 0 with all."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = np.zeros((n, n), np.float64)
    if n == 2:
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), sizes.astype(np.int64))
        grams, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        wanted = counts > 1
        number = np.cumsum(wanted) - 1
        use = wanted[at]
        at, owner, width = number[at[use]], owner[use], int(wanted.sum())
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        for start in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            x = np.zeros((n, min(COLUMNS, width - start)), np.float32)
            x[owner[lo:hi], at[lo:hi] - start] = 1
            shared += x @ x.T
    linked = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    side = np.array(sides)
    linked &= ~((side[:, None] == side[None, :]) & (side[:, None] > 0))
    np.fill_diagonal(linked, False)
    return linked


def _verify(threshold: float):
    def solved(members: dict[str, tuple[int, int, bytes]]) -> Iterator[tuple[str, int, str]]:
        names = sorted(members)
        if len(names) < 2:
            return
        linked = links_within([np.frombuffer(members[x][2], np.uint64) for x in names], [members[x][1] for x in names], threshold)
        copies = np.array([members[x][0] for x in names], np.int64)
        root = np.arange(len(names))
        while True:  # labels of the least linked member, with pointer jumping
            least = np.minimum(root, np.where(linked, root[None, :], len(names)).min(1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        for i in np.nonzero(linked.any(1))[0]:
            yield names[i], int(copies[linked[i]].sum()), names[root[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["fp", "links", "root"])

        now, members = None, {}
        for batch in batches:
            for task, fp, side, copies, grams in zip(*[c.to_pylist() for c in batch.columns[:4]], batch.column(4), strict=True):
                if task != now:
                    for row in solved(members):
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                    now, members = task, {}
                    if len(out[0]) >= 5000:
                        yield made()
                        out = ([], [], [])
                members[fp] = (copies, side, grams.as_py())
        for row in solved(members):
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield made()

    return run


def _led(pairs: DataFrame) -> DataFrame:
    """(fh, lead) with each lead replaced by its own lead: a pointer jump. Keys are derived anew, so that a lead with very many followers can be split."""
    further = pairs.select(F.bitwise_not("fh").alias("met"), F.col("lead").alias("next"))
    return pairs.withColumn("to", F.bitwise_not("lead")).join(further, F.col("to") == F.col("met")).select("fh", F.col("next").alias("lead"))


def _cells(reps: DataFrame, bucketed: DataFrame, cell_docs: int, cell_grams: int) -> DataFrame:
    """Representatives that share a bucket with another (fp, fh, copies, pick), each with its ``cell``.

    The cell is where two jumps along least members lead, if that many fit in a cell; else where one does; else a part of that by hash.
    """
    near = written(bucketed.groupBy("fh").agg(F.min("least").alias("lead")), "join-leads")
    wide = _led(_led(near)).withColumnRenamed("lead", "wide")
    led = near.withColumnRenamed("lead", "near").join(wide, "fh")
    members = written(reps.select("fp", F.xxhash64("fp").alias("fh"), "copies", "pick", "grams").join(led, "fh"), "join-led")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(cell_docs)), F.ceil(F.sum("grams") / F.lit(cell_grams))).cast("long")
    sized = written(members.groupBy("wide").agg(F.count("*").alias("w_docs"), parts.alias("w_parts")), "join-wide")
    placed = written(lookup(members, sized, "wide", "w_docs").withColumn("near", F.xxhash64("wide", F.when(F.col("w_parts") > 1, F.col("near")))), "join-near")
    sized = written(placed.groupBy("near").agg(F.count("*").alias("n_docs"), parts.alias("n_parts")), "join-sizes")
    cut = lookup(placed.select("fp", "fh", "copies", "pick", "near"), sized, "near", "n_docs")
    return written(cut.select("fp", "fh", "copies", "pick", F.xxhash64("near", F.pmod(F.xxhash64("fp"), "n_parts")).alias("cell")), "join-members")


def _tasks(members: DataFrame, bucketed: DataFrame) -> DataFrame:
    """``members`` with ``tasks``: the (task, side) in which each takes part. A cell is a task, and so are two cells that a bucket joins."""
    meet = bucketed.select("fh", "key").join(members.select("fh", "cell"), "fh").groupBy("key").agg(F.collect_set("cell").alias("cells")).filter(F.size("cells") > 1)
    pairs = meet.select("cells", F.explode("cells").alias("a")).select("a", F.explode(F.filter("cells", lambda c: c > F.col("a"))).alias("b")).distinct()
    pairs = written(pairs, "join-cells")
    cross = F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"))
    own = members.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell", F.col("cell").cast("string").alias("task"), F.lit(0).alias("side"))
    either = own.union(pairs.select(F.col("a").alias("cell"), cross.alias("task"), F.lit(1).alias("side"))).union(pairs.select(F.col("b").alias("cell"), cross.alias("task"), F.lit(2).alias("side")))
    return members.join(either.groupBy("cell").agg(F.collect_list(F.struct("task", "side")).alias("tasks")), "cell")


def _solve(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, recall: float, cell_docs: int, cell_grams: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) of each row, and (fp, copies, class_id, class_size, links, kept) of each distinct n-gram set; ``kept`` is (null id, id, text hash) of its class's first row."""
    bands, rows = band_shape(threshold, recall)
    source = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("th"), "text")
    signed = written(source.mapInArrow(_sign(words, bands, rows, 7), "id long, th long, fp string, grams long, bands array<long>"), "join-signed")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "th")).alias("pick")
    reps = written(signed.groupBy("fp").agg(first, F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")), "join-reps")
    keys = reps.select(F.xxhash64("fp").alias("fh"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("fh").alias("least"), F.max("fh").alias("most")).filter("least <> most")
    shared = shared.select(F.bitwise_not("key").alias("met"), "least")  # a key of its own, so that a bucket with very many members can be split
    bucketed = written(keys.join(shared, F.bitwise_not("key") == F.col("met")).select("fh", "key", "least"), "join-buckets")
    members = _cells(reps, bucketed, cell_docs, cell_grams)
    tasks = _tasks(members, bucketed).select("fp", "copies", F.col("pick.id").alias("p_id"), F.col("pick.th").alias("p_th"), "tasks")
    # one text for each id and text hash: repeated rows, and null ids with one text, are brought together before they meet
    texts = source.groupBy("id", "th").agg(F.first("text").alias("text"))
    texts = tasks.join(texts, F.col("p_id").eqNullSafe(F.col("id")) & (F.col("p_th") == F.col("th"))).select("fp", "copies", "tasks", "text")
    sets = texts.mapInArrow(_sets(words), "fp string, copies long, tasks array<struct<task:string,side:int>>, grams binary")
    work = sets.withColumn("t", F.explode("tasks")).select(F.col("t.task").alias("task"), "fp", F.col("t.side").alias("side"), "copies", "grams")
    found = work.repartition("task").sortWithinPartitions("task").mapInArrow(_verify(threshold), "fp string, links long, root string")
    found = written(found, "join-links")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")), "join-classes")
    classed = reps.select("fp", "rep", "pick", "copies").join(links, "fp", "left").join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    classed = classed.withColumn("root", F.coalesce("root", "fp")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    classed = written(classed, "join-classed")
    whole = written(classed.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("pick").alias("kept"), F.sum("copies").alias("class_size"), F.count("*").alias("members")), "join-whole")
    return signed.select("id", "th", "fp"), written(lookup(classed, whole, "root", "members").select("fp", "copies", "class_id", "class_size", "links", "kept"), "join-done")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, cell_docs: int = CELL_DOCS, cell_grams: int = CELL_GRAMS) -> DataFrame:
    """One row for each document: id, ``class_id`` (least id of its class), ``class_size`` and ``n_links``.

    Two documents are linked if their n-gram sets have a Jaccard similarity of at least ``threshold``;
    a class is what links connect, and ``n_links`` counts the other rows linked to this one, copies included.
    Texts with no words (null, empty, white space) are copies of each other and like nothing else. Repeated rows are copies.
    A row with a null id has a class like any other; ``class_id`` is null only if all its ids are. Whole texts
    count, however long. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows, done = _solve(docs, id_col, text_col, words, threshold, recall, cell_docs, cell_grams)
    out = lookup(rows, done.select("fp", "copies", "class_id", "class_size", "links"), "fp", "copies")
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay, with all columns of ``docs``: one row of each class, the one with the least id, and of rows with null ids, which come after the others, the one with the least text hash.

    Of rows that agree in id and text any one stays. Null and empty texts are one class; an empty table gives no rows; column names are free.
    """
    rows, done = _solve(docs, id_col, text_col, words, threshold, RECALL, CELL_DOCS, CELL_GRAMS)
    marked = lookup(rows, done.filter("class_size > 1").select("fp", "copies", "kept"), "fp", "copies").filter("kept is not null")
    first = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("th") == F.col("kept.th"))
    drop = written(marked.groupBy("id", "th").agg(F.count("*").alias("n"), F.first(~first).alias("gone")).filter("gone or n > 1"), "join-gone")

    def same(some: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(some["id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == some["th"])

    once = docs.join(drop, same(drop), "left_anti")
    repeated = drop.filter("not gone")
    if not repeated.take(1):
        return once
    again = docs.join(repeated, same(repeated), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = again.groupBy(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_of(text_col)).alias("__th")).agg(F.first(row).alias("__row"))
    return once.unionByName(again.select("__row.*"))
