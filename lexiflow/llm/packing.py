"""Fill containers of fixed capacity with items, leaving as little unused space as possible.

Items of equal length are interchangeable, so the packing is planned on the histogram of lengths, which has at most
``capacity`` entries however many items there are. Each step is a minimum-bin-slack step: the longest remaining length
opens a container, a subset-sum dynamic programme over a bitset of reachable sums picks the multiset of remaining lengths
that comes closest to the capacity, and backtracking gives the count of each length in it. The pattern is then used as
often as the counts allow, so the number of steps depends on the number of distinct lengths, not on the number of items.

Items get their containers by their rank among the items of equal length. A length has a hashed bucket for each ``RANKED``
items, with offsets between them, so one that a third of all items share is ranked in as many tasks as it needs.

An item longer than the capacity is cut into pieces of just the capacity and a rest; no other item is split. An item of
length 0 takes no room and is put into container 0. Null lengths count as 0. Capacities below 1 or null are left out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import cut

#: Items of one length that are ranked together, about.
RANKED = 250_000


def fill(counts: dict[int, int], room: int) -> Counter:
    """The multiset of lengths, no more of each than ``counts`` has, whose sum is the largest that ``room`` takes."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    goal = 1 << room
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            use = min(chunk, left)
            steps.append((length, use, reach))
            reach |= reach << length * use & mask
            left -= use
            chunk *= 2
            if reach & goal:
                left = 0
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, Counter()
    for length, use, before in reversed(steps):
        if not before >> at & 1:
            out[length] += use
            at -= length * use
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(how many items of each length a container holds, how many such containers) until the histogram is used up."""
    counts = {x: n for x, n in histogram.items() if 0 < x <= capacity and n > 0}
    out = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = fill({x: n for x, n in counts.items() if n > 0}, capacity - seed)
        counts[seed] += 1
        chosen[seed] += 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((dict(chosen), times))
    return out


def ranges(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first container, items a container): where the items of a length go, from that rank on."""
    rank, base, out = Counter(), 0, []
    for chosen, times in patterns:
        for length, n in chosen.items():
            out.append((length, rank[length], base, n))
            rank[length] += n * times
        base += times
    return sorted(out)


def pieces(df: DataFrame, key: str, length: str, specs: dict[int, int]) -> DataFrame:
    """(spec_id, k, piece, size): each item under each capacity, cut only where it is longer than that."""
    cap = F.create_map(*(F.lit(int(x)) for kv in sorted(specs.items()) for x in kv))
    each = df.select(F.col(key).alias("k"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"), F.explode(F.array(*(F.lit(int(s)) for s in sorted(specs)))).alias("spec_id"))
    each = each.withColumn("cap", cap[F.col("spec_id")].cast("long"))
    count = F.greatest(F.expr("(n + cap - 1) div cap"), F.lit(1))
    cutup = each.select("spec_id", "k", "n", "cap", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    return cutup.select("spec_id", "k", "piece", F.least("cap", F.expr("n - piece * cap")).alias("size"))


def pack(df: DataFrame, key: str, length: str, specs: dict[int, int]) -> DataFrame:
    """(spec_id, key, piece, size, container): every item, or piece of one, with its container. ``specs``: capacity by id."""
    specs = {int(s): int(c) for s, c in specs.items() if s is not None and c is not None and c > 0}
    spark = df.sparkSession
    if not specs:
        return spark.createDataFrame([], f"spec_id int, `{key}` long, piece long, size long, container long")
    items = pieces(df, key, length, specs)
    histogram: dict[int, dict[int, int]] = {s: {} for s in specs}
    for r in items.where("size > 0").groupBy("spec_id", "size").agg(F.count("*").alias("n")).collect():  # at most the sum of the capacities
        histogram[r["spec_id"]][r["size"]] = r["n"]
    most = max((n for h in histogram.values() for n in h.values()), default=0)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("k", "piece"), F.lit(most // RANKED + 1)).cast("int"))
    step = max(specs.values()) + 1
    number = {s: i for i, s in enumerate(sorted(specs))}
    rows = sorted((number[s] * step + x, first, base, n) for s, c in specs.items() for x, first, base, n in ranges(plan(histogram[s], c)))
    shared = spark.sparkContext.broadcast(np.array(rows, dtype=np.int64).reshape(-1, 4))

    @F.pandas_udf("long")
    def place(slot, rank):
        import pandas as pd

        at = shared.value
        slot, rank = slot.to_numpy(), rank.to_numpy()
        out = np.zeros(len(slot), dtype=np.int64)
        # Questions and ranges in one order: the range of a question is the last one before it.
        asked = np.flatnonzero(rank >= 0)
        order = np.lexsort((np.repeat([0, 1], [len(at), len(asked)]), np.concatenate([at[:, 1], rank[asked]]), np.concatenate([at[:, 0], slot[asked]])))
        is_range = order < len(at)
        found = np.maximum.accumulate(np.where(is_range, order, -1))
        i, mine = found[~is_range], asked[order[~is_range] - len(at)]
        out[mine] = at[i, 2] + (rank[mine] - at[i, 1]) // at[i, 3]
        return pd.Series(out)

    before = Window.partitionBy("spec_id", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tally = items.where("size > 0").groupBy("spec_id", "size", "bucket").agg(F.count("*").alias("n"))
    offsets = tally.select("spec_id", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("spec_id", "size", "bucket").orderBy("k", "piece")
    ranked = items.where("size > 0").withColumn("own", F.row_number().over(own) - 1).join(offsets, ["spec_id", "size", "bucket"])
    ranked = ranked.select("spec_id", "k", "piece", "size", (F.col("own") + F.col("offset")).alias("rank"))
    ranked = ranked.unionByName(items.where("size = 0").select("spec_id", "k", "piece", "size", F.lit(-1).cast("long").alias("rank")))
    order = F.create_map(*(F.lit(x) for s in sorted(specs) for x in (s, number[s])))
    slot = (order[F.col("spec_id")] * step + F.col("size")).cast("long")
    return ranked.select("spec_id", F.col("k").alias(key), "piece", "size", place(slot, "rank").alias("container"))


def pack_documents(docs: DataFrame, key: str, text: str, specs: DataFrame, file: str) -> DataFrame:
    """Documents measured in tokens of a public tokenizer, packed for each row of ``specs`` (spec_id, capacity).

    The measures are written once, as they are read twice. The specifications are a list for people, not data; they are
    read by the driver.
    """
    from lexiflow.llm.bpe import token_counts

    sizes = cut(token_counts(docs, key, text, file))
    wanted = {r["spec_id"]: r["capacity"] for r in specs.select("spec_id", "capacity").distinct().collect()}
    return pack(sizes, key, "tokens", wanted)


def summary(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, containers, tokens, unused): how well each capacity is used."""
    return (
        packed.groupBy("spec_id").agg((F.max("container") + 1).alias("containers"), F.sum("size").alias("tokens"))
        .join(specs.select("spec_id", F.col("capacity").cast("long").alias("capacity")).distinct(), "spec_id")
        .select("spec_id", "capacity", "containers", "tokens", (F.col("capacity") * F.col("containers") - F.col("tokens")).alias("unused"))
    )
