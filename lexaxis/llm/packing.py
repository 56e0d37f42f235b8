"""Packing documents into fixed contexts by a configuration linear program over the length histogram.

A document longer than the context fills whole contexts and leaves a rest. The
rests' lengths make a histogram, bounded by the context however many documents
there are. A *configuration* is a multiset of lengths that fits a context. The
linear program - cover each length's count with as few configurations as
possible - is solved by multiplicative weights: each length has a price that
falls by a factor as the length is covered. A knapsack dynamic program finds the
greatest price that a context can hold; the configurations that reach it, at most
one for each length, are taken a whole number of times each. The prices over that
greatest price are a feasible dual solution, so that every round bounds the number
of contexts from below. At first a length's price is its share of a context,
which is the optimum wherever contexts can be filled; if the contexts then exceed
the bound, the prices are sought by rounds that cover lengths in fractions.

What the rounds leave is rounded: context by context, the longest length left
and the bounded knapsack over the rest's supplies that fills the context best,
or best fit decreasing where that needs fewer contexts for what is left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaxis.llm.common import bounded, id_and_text, numbered, settled

CONTEXT = 2048
#: Rounds of multiplicative weights; the program ends before that when a round places less than LEAST of what is left.
ROUNDS = 300
LEAST = 0.0005
#: Share of a length's open count that one round may place.
STEP = 0.5
#: Logarithm of the factor between the price of a length that is open and one that is covered, while contexts are placed:
#: the first keeps to full contexts, the second may waste room.
RATES = (0.003, 1.0)
#: The same for a length covered once, while prices are sought.
SEARCH = 0.1
#: Share of the greatest price by which a configuration may fall short of it.
SHORT = 0.002
#: Parts that ranks are counted in; bounds the offset tables, not the rows.
PARTS = 32
#: The same for documents of whole contexts, which have but one rank.
WHOLE_PARTS = 4096

Config = tuple[tuple[int, int], ...]


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, choice) by capacity: the greatest price that fits it, and a length that reaches it (0: none of its own).

    `prices` is dense by length, -inf where a length isn't there; a length may
    be taken any number of times; ties go to greater lengths.
    """
    context = len(prices) - 1
    value, choice, down = np.zeros(context + 1), np.zeros(context + 1, np.int64), prices[:0:-1].copy()
    for c in range(1, context + 1):
        gain = value[:c] + down[context - c :]
        k = int(gain.argmax())
        value[c], choice[c] = (gain[k], c - k) if gain[k] > value[c - 1] else (value[c - 1], 0)
    return value, choice


def _chosen(choice: np.ndarray, capacity: int) -> Counter[int]:
    found: Counter[int] = Counter()
    while capacity > 0:
        length = int(choice[capacity])
        found[length] += length > 0
        capacity -= length or 1
    return +found


def dual_prices(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(prices by length, dual bound) of the best of `rounds` rounds, each of which covers the best configuration's lengths a little more."""
    lengths, own = np.arange(len(counts)), counts > 0
    covered, best, bound = np.zeros(len(counts)), lengths.astype(float), 0.0
    for _ in range(rounds):
        price = np.where(own, lengths * np.exp(-(covered - covered[own].min())), -np.inf)
        value, choice = knapsack(price)
        reached = float(counts[own] @ price[own] / value[-1])
        if reached > bound:
            best, bound = np.where(own, price, 0.0), reached
        config = _chosen(choice, len(counts) - 1)
        share = {k: n / int(counts[k]) for k, n in config.items()}
        for k, x in share.items():
            covered[k] += SEARCH * x / max(share.values())
    return best, bound


def program(counts: np.ndarray, prices: np.ndarray | None = None, rate: float = RATES[0], rounds: int = ROUNDS) -> tuple[Counter[Config], np.ndarray, float]:
    """(contexts by configuration, counts left, dual bound): an approximate solution of the linear program in whole numbers.

    `counts` and `prices` (by default the lengths) are dense by length; no length is covered more often than it occurs.
    """
    first = np.arange(len(counts)) if prices is None else prices
    lengths, left, plan, bound = np.arange(len(counts)), counts.copy(), Counter(), 0.0
    for _ in range(rounds):
        own = left > 0
        if not own.any():
            break
        price = first * np.exp(rate * (left / np.maximum(counts, 1) - 1))
        value, choice = knapsack(np.where(own, price, -np.inf))
        if own.sum() == (counts > 0).sum():  # a price for each length: a dual solution
            bound = max(bound, float(counts @ price / value[-1]))
        open_ = np.minimum(np.ceil(STEP * left).astype(np.int64), left)
        placed = 0
        for length in np.flatnonzero(own)[::-1].tolist():
            if not open_[length] or price[length] + value[len(counts) - 1 - length] < (1 - SHORT) * value[-1]:
                continue
            config = _chosen(choice, len(counts) - 1 - length)
            config[length] += 1
            many = min(int(open_[k]) // n for k, n in config.items())
            if many:
                for k, n in config.items():
                    open_[k] -= n * many
                    left[k] -= n * many
                plan[tuple(sorted(config.items()))] += many
                placed += many
        if placed * (len(counts) - 1) < LEAST * (lengths @ left):
            break
    return plan, left, bound


def fill(counts: np.ndarray) -> Counter[Config]:
    """Contexts by configuration for all of `counts`: each has the longest length left, and with it is as full as can be.

    The bounded knapsack is over bits, a bit for a sum, with supplies cut in
    powers of two; of the ways to the best sum it takes the one of longest pieces.
    """
    plan, left, context = Counter(), counts.copy(), len(counts) - 1
    while left.any():
        own = np.flatnonzero(left).tolist()
        room = context - own[-1]
        left[own[-1]] -= 1
        pieces, sums, mask = [], [1], (1 << (room + 1)) - 1
        for length in own:
            many, n = min(int(left[length]), room // length), 1
            while many > 0:
                n = min(n, many)
                pieces.append((length, n))
                sums.append((sums[-1] | sums[-1] << length * n) & mask)
                many, n = many - n, 2 * n
        left[own[-1]] += 1
        config, total = Counter({own[-1]: 1}), sums[-1].bit_length() - 1
        for i in range(len(pieces) - 1, -1, -1):
            length, n = pieces[i]
            if total >= length * n and sums[i] >> (total - length * n) & 1:
                config[length] += n
                total -= length * n
        many = min(int(left[k]) // n for k, n in config.items())
        plan[tuple(sorted(config.items()))] += many
        for k, n in config.items():
            left[k] -= n * many
    return plan


def best_fit_decreasing(lengths: np.ndarray, counts: np.ndarray, context: int) -> list[tuple[Config, int]]:
    """Best fit decreasing on a histogram: equal contexts move together, so the time doesn't depend on the counts."""
    room: dict[int, dict[Config, int]] = {}
    for k in np.argsort(-lengths):
        size, n = int(lengths[k]), int(counts[k])
        while n:
            fit = min((r for r in room if r >= size), default=None)
            if fit is None:
                each = context // size
                whole, rest = divmod(n, each)
                for config, many in ((((size, each),), whole), (((size, rest),), int(rest > 0))):
                    if many:
                        at = room.setdefault(context - size * config[0][1], {})
                        at[config] = at.get(config, 0) + many
                break
            config, have = room[fit].popitem()
            move = min(have, n)
            n -= move
            if have > move:
                room[fit][config] = have - move
            if not room[fit]:
                del room[fit]
            grown = Counter(dict(config))
            grown[size] += 1
            at = room.setdefault(fit - size, {})
            key = tuple(sorted(grown.items()))
            at[key] = at.get(key, 0) + move
    return [(config, many) for group in room.values() for config, many in group.items()]


def solve(histogram: dict[int, int], context: int, rounds: int = ROUNDS) -> tuple[list[tuple[Config, int]], float]:
    """([(configuration, number of contexts)], dual bound): every length in `histogram` is placed exactly as often as it occurs.

    The contexts that the program places all stand; only what it leaves is rounded.
    """
    if not histogram:
        return [], 0.0
    if min(histogram) < 1 or max(histogram) > context:
        raise ValueError("lengths lie between 1 and the context")
    counts = np.zeros(context + 1, np.int64)
    counts[list(histogram)] = list(histogram.values())
    best, bound, prices = None, 0.0, None
    for rate in (*RATES, None):
        if rate is None:
            prices, dual = dual_prices(counts, rounds)
            bound = max(bound, dual)
        plan, left, dual = program(counts, prices, rate or RATES[0], rounds)
        bound = max(bound, dual)
        own = np.flatnonzero(left)
        rests = (fill(left), Counter(dict(best_fit_decreasing(own, left[own], context))))
        plan = plan + min(rests, key=lambda rest: rest.total())
        if best is None or plan.total() < best.total():
            best = plan
        if best.total() <= np.ceil(bound - 1e-6) + 1:
            break
    return list(best.items()), bound


def slots(plan: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that one configuration takes: (length, first rank, first pack, copies a pack)."""
    taken: Counter[int] = Counter()
    rows, pack = [], 0
    for config, many in plan:
        for length, copies in config:
            rows.append((length, taken[length], pack, copies))
            taken[length] += copies * many
        pack += many
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "pack": table[:, 2], "copies": table[:, 3], "packs": np.array(pack)}


def _placed(table: dict[str, np.ndarray]):
    span = np.int64(1 << 44)
    key = table["length"] * span + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            at = np.searchsorted(key, length * span + rank, side="right") - 1
            pack = table["pack"][at] + (rank - table["rank"][at]) // table["copies"][at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(pack)], ["rid", "doc_id", "first_token", "tokens", "pack_id"])

    return run


def _ranked(df: DataFrame, by: list[str], amount) -> DataFrame:
    """`df` (rid, part, ...) with `rank`: the sum of `amount` over earlier rows (by part and rid) among equals in `by`.

    Two levels: sums by part are few and summed up first, so that no window takes all rows of a key.
    """
    sums = df.groupBy(*by, "part").agg(F.sum(amount).alias("n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settled(sums.select(*by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    own = Window.partitionBy(*by, "part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("inside", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return inside.join(bounded(offsets, offsets.count(), 48), [*by, "part"]).withColumn("rank", F.col("offset") + F.col("inside")).drop("offset", "inside")


def pack(docs: DataFrame, context: int = CONTEXT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed context: (pack_id, tokens, pieces: [{doc_id, first_token, tokens}]).

    A token is a word between white space. Every token of every document is in
    exactly one piece, pieces of one context are in file order, and no context
    holds more than `context` tokens.

    * null, empty or blank text: no tokens, hence no piece;
    * very long text: whole contexts of its own, then a rest;
    * repeated rows and null doc_ids: pieces of their own, like any row;
    * ties: equal lengths are placed in an order fixed by their place in the files;
    * empty table: an empty result; other columns, of any name, are not read.
    """
    table, rid = numbered(docs)
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    sized = settled(id_and_text(table, rid, id_col, text_col).select("rid", "doc_id", words.cast("long").alias("tokens"), F.pmod(F.xxhash64("rid"), F.lit(WHOLE_PARTS)).cast("int").alias("part")).where("tokens > 0"))
    rest = sized.select("rid", "doc_id", F.expr(f"tokens - tokens % {context}").alias("first_token"), F.expr(f"tokens % {context}").alias("tokens"), (F.col("part") % PARTS).alias("part")).where("tokens > 0")
    histogram = {r.tokens: r.n for r in rest.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # below `context` rows
    run = slots(solve(histogram, context, rounds)[0])
    pieces = _ranked(rest, ["tokens"], F.lit(1)).select("rid", "doc_id", "first_token", "tokens", "rank").mapInArrow(_placed(run), "rid long, doc_id long, first_token long, tokens long, pack_id long")
    whole = sized.select("rid", "doc_id", "part", F.expr(f"tokens div {context}").alias("n")).where("n > 0")
    whole = _ranked(whole, [], F.col("n")).select("rid", "doc_id", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    whole = whole.select("rid", "doc_id", (F.col("k") * context).alias("first_token"), F.lit(context).cast("long").alias("tokens"), (F.col("rank") + F.col("k") + int(run["packs"])).alias("pack_id"))
    piece = F.struct("rid", "first_token", "doc_id", "tokens")
    packed = pieces.unionByName(whole).groupBy("pack_id").agg(F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return packed.select("pack_id", "tokens", F.transform("pieces", lambda p: F.struct(p.doc_id.alias("doc_id"), p.first_token.alias("first_token"), p.tokens.alias("tokens"))).alias("pieces"))
