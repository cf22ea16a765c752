"""Mixing sources to target weights, in DataFrame functions only.

A source's share of all tokens is raised to an exponent between 1 (as found)
and 0 (uniform) and normalised. The exponent is bisected to meet a target
entropy or a limit on repetition: a pass over the table of sources evaluates
many exponents at once, so a bracket shrinks by their number each time. A
source's budget is then realised by permutations of its blocks of documents:
whole epochs, each in a new order of the blocks, and of the last epoch the
longest run of documents that fits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import MAX_HEAVY, lookup, text_of, written

#: Exponents evaluated in a pass, and passes: 33 ** 8 parts of the first bracket.
POINTS, PASSES = 32, 8
#: Tokens of a block, and blocks of a source at most; beyond that blocks grow.
BLOCK_TOKENS, MAX_BLOCKS = 1 << 18, 1 << 16
SEED = 20_240_601


@dataclass(frozen=True)
class Solution:
    """The exponent, the sum of tempered shares, and the sums that the weights come from."""

    exponent: float
    norm: float
    total: int
    sources: int
    entropy: float
    budget: int


def tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")).cast("long")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with ``__src`` (a text that also stands for a null source) and ``__key`` (its place in every order)."""
    src = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    return docs.withColumn("__src", src).withColumn("__key", F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)))


def _evaluate(totals: DataFrame, total: int, budget: float, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: the norm, the entropy in nats, and the most often that a source is repeated."""
    share = F.col("tokens") / F.lit(float(total))
    columns = []
    for i, e in enumerate(exponents):
        powered = F.pow(share, F.lit(e))
        columns += [F.sum(powered).alias(f"z{i}"), F.sum(powered * F.ln(share)).alias(f"a{i}"), F.max(powered / share).alias(f"r{i}")]
    row = totals.filter("tokens > 0").agg(*columns).first()
    return [(row[f"z{i}"], math.log(row[f"z{i}"]) - e * row[f"a{i}"] / row[f"z{i}"], row[f"r{i}"] / row[f"z{i}"] * budget / total) for i, e in enumerate(exponents)]


def solve(totals: DataFrame, target_entropy: float | None = None, entropy_share: float | None = None, max_epochs: float | None = None, budget: int | None = None) -> Solution | None:
    """The exponent for ``totals`` (one row a source, with ``tokens``); None if there are no tokens.

    ``entropy_share`` sets the target that far from the entropy as found to the
    uniform one. The largest exponent that reaches the target is taken, or the smallest
    under which no source is repeated over ``max_epochs`` times, whichever is larger.
    A budget of more than ``max_epochs`` times all tokens is cut to that, since any mixture of more repeats some source more often.
    """
    found = totals.filter("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    total, n = int(found[0] or 0), int(found[1])
    if not total:
        return None
    budget = total if budget is None else budget
    if max_epochs is not None:
        budget = min(budget, int(max_epochs * total))
    (_, as_found, _), (_, uniform, _) = _evaluate(totals, total, budget, [1.0, 0.0])
    if entropy_share is not None:
        target_entropy = as_found + entropy_share * (uniform - as_found)

    def bisect(enough) -> float:
        """The bracket's end that holds, where ``enough`` is true below one exponent and false above it."""
        low, high = 0.0, 1.0
        if enough(*_evaluate(totals, total, budget, [high])[0]):
            return high
        for _ in range(PASSES):
            points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
            held = [enough(*x) for x in _evaluate(totals, total, budget, points)]
            last = held.index(False) if False in held else POINTS
            low, high = ([low, *points][last], [*points, high][last])
        return low

    exponent = 1.0 if target_entropy is None else bisect(lambda z, h, r: h >= target_entropy)
    if max_epochs is not None and _evaluate(totals, total, budget, [exponent])[0][2] > max_epochs:
        over = bisect(lambda z, h, r: r > max_epochs)  # the last exponent that still repeats too much
        exponent = max(exponent, min(1.0, over + 33.0**-PASSES))
    norm, entropy, _ = _evaluate(totals, total, budget, [exponent])[0]
    return Solution(exponent, norm, total, n, entropy, budget)


def decisions(rows: DataFrame, totals: DataFrame, solution: Solution, block_tokens: int, seed: int) -> DataFrame:
    """For each source its weight, whole epochs, number of blocks, and where the last epoch ends: in block order ``cut_block``, and inside that block ``cut_key``."""
    share = F.col("tokens") / F.lit(float(solution.total))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(solution.exponent)) / F.lit(solution.norm)).otherwise(F.lit(0.0))
    epochs = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(float(solution.budget)) / F.col("tokens")).otherwise(F.lit(1.0))
    blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / F.lit(block_tokens)))).cast("long")
    plan = totals.withColumn("weight", weight).withColumn("__epochs", epochs).withColumn("blocks", blocks)
    plan = plan.withColumn("epochs", F.floor("__epochs").cast("int")).withColumn("rest", F.floor((F.col("__epochs") - F.floor("__epochs")) * F.col("tokens") + 1e-6).cast("long")).drop("__epochs")
    plan = written(plan, "mixing-plan")
    placed = _with(rows, plan.select("__src", "blocks", "epochs", "rest", "n_docs"), plan).withColumn("block", F.pmod("__key", "blocks"))
    placed = placed.filter("rest > 0").withColumn("block_key", _block_key(F.col("epochs"), seed))
    sums = written(placed.groupBy("__src", "rest", "block", "block_key").agg(F.sum("tokens").alias("tokens")), "mixing-blocks")
    order = Window.partitionBy("__src").orderBy("block_key", "block")
    upto = sums.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = upto.filter("upto > rest").groupBy("__src").agg(F.min(F.struct("block_key", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))).alias("cut"))
    cut = written(over.select("__src", F.col("cut.block_key").alias("cut_block"), F.col("cut.block").alias("block"), F.col("cut.room").alias("room")), "mixing-cuts")
    inside = _with(rows, plan.select("__src", "blocks", "n_docs"), plan).withColumn("block", F.pmod("__key", "blocks"))
    inside = inside.join(F.broadcast(cut) if _few(plan) else cut, ["__src", "block"])
    within = Window.partitionBy("__src").orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.sum("tokens").over(within)).filter("upto <= room").groupBy("__src").agg(F.max("__key").alias("cut_key"))
    out = plan.join(cut.select("__src", "cut_block", F.col("block").alias("cut_no")), "__src", "left").join(last, "__src", "left")
    return written(out.select("__src", "weight", "epochs", "rest", "blocks", "n_docs", "cut_block", "cut_no", "cut_key"), "mixing-decisions")


def _block_key(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), F.col("__src"), F.col("block"), epoch.cast("int"))


def _few(sources: DataFrame) -> bool:
    """Whether the table of sources is small enough to broadcast: MAX_HEAVY rows of under 200 bytes."""
    return sources.limit(MAX_HEAVY + 1).count() <= MAX_HEAVY


def _with(rows: DataFrame, values: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's ``values``: broadcast where the sources are few, else heavy sources alone."""
    if _few(sources):
        return rows.join(F.broadcast(values.drop("n_docs")), "__src")
    return lookup(rows, values, "__src", "n_docs").drop("n_docs")


def mix(
    docs: DataFrame, target_entropy: float | None = None, entropy_share: float | None = None, max_epochs: float | None = None, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", places: bool = True,
) -> DataFrame:
    """``docs`` in the drawn proportions: each row as often as it is drawn, with ``__epoch``, ``__block_key`` and ``__key`` unless ``places`` is false.

    A source's stream is its rows in the order of those three. ``budget`` (tokens) is all tokens found unless given, and at most ``max_epochs``
    times that; a source never gets more than its share of it, and none is drawn more than ``max_epochs`` times. Null sources are one source, null texts are empty,
    whole texts count, however long, and a source without any token is passed through once. Repeated rows tie and are drawn together.
    An empty table gives no rows. Further columns pass through, whatever their names; where one has the name of a place, the place's gets a further underscore.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    column = {name: own[docs.columns.index(name)] for name in (id_col, text_col, source_col)}
    extra = []
    for name in ("__epoch", "__block_key", "__key"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        extra.append(name)
    marked = measured(docs.toDF(*own), column[id_col], column[text_col], column[source_col], seed)
    rows = written(marked.select("__src", "__key", tokens(text_of(column[text_col])).alias("tokens")), "mixing-rows")
    totals = written(rows.groupBy("__src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "mixing-sources")
    solution = solve(totals, target_entropy, entropy_share, max_epochs, budget)
    if solution is None:
        out = marked.withColumn("__epoch", F.lit(0)).withColumn("__block_key", F.lit(0).cast("long"))
    else:
        plan = decisions(rows, totals, solution, block_tokens, seed)
        chosen = plan.select("__src", F.col("epochs").alias("__epochs"), F.col("blocks").alias("__blocks"), F.col("rest").alias("__rest"), F.col("cut_block").alias("__cut"), F.col("cut_no").alias("__cut_no"), F.col("cut_key").alias("__cut_key"), "n_docs")
        drawn = _with(marked, chosen, plan)
        number = F.pmod("__key", "__blocks")
        key = F.xxhash64(F.lit(seed + 1), F.col("__src"), number, F.col("__epochs").cast("int"))
        before = F.col("__cut").isNull() | (key < F.col("__cut")) | ((key == F.col("__cut")) & (number < F.col("__cut_no")))
        inside = (key == F.col("__cut")) & (number == F.col("__cut_no")) & (F.col("__key") <= F.col("__cut_key"))
        more = F.when((F.col("__rest") > 0) & (before | F.coalesce(inside, F.lit(False))), 1).otherwise(0)
        times = (F.col("__epochs") + more).cast("int")
        out = drawn.withColumn("__times", times).filter("__times > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
        out = out.withColumn("__block_key", F.xxhash64(F.lit(seed + 1), F.col("__src"), F.pmod("__key", "__blocks"), F.col("__epoch").cast("int")))
    kept = [F.col(c).alias(name) for c, name in zip(own, docs.columns, strict=True)]
    return out.select(*kept, *([F.col(c).alias(name) for c, name in zip(("__epoch", "__block_key", "__key"), extra, strict=True)] if places else []))
