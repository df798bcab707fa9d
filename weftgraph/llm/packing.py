"""Filling containers of fixed capacity: best fit, then a local search by moves and swaps.

The search takes underfull bins from the fullest down and fills their gaps from the emptiest: it moves a text, exchanges
one for one, or two for one, whenever the fuller bin gains. Each step raises the sum of squared fills, so fill gathers
in few bins and the emptiest run dry.

Texts are packed in groups of bounded size; the bins that stay underfull in all groups are packed once more among
themselves, round by round, until one group holds them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.workspace import Workspace

#: Texts packed together at most on average; bounds a task's memory and time.
GROUP = 4000
#: Bins whose pairs are tried for a two-for-one exchange with one other bin.
DONORS = 24
#: A bin filled to this share takes no part in later rounds.
FULL = 0.995


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions; the largest first, each into the fullest bin that holds it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # free space and bin, ascending
    for i in order:
        s = sizes[i]
        at = bisect_left(gaps, (s, -1))
        if at == len(gaps):
            bins.append([i])
            insort(gaps, (capacity - s, len(bins) - 1))
        else:
            free, b = gaps.pop(at)
            bins[b].append(i)
            insort(gaps, (free - s, b))
    return bins


def improve(sizes: list[int], bins: list[list[int]], capacity: int, passes: int = 3) -> list[list[int]]:
    """Local search over underfull bins."""
    for _ in range(passes):
        load = [sum(sizes[i] for i in b) for b in bins]
        under = sorted((b for b in range(len(bins)) if load[b] < capacity), key=lambda b: load[b])
        if len(under) < 2:
            break
        changed = False
        donors = set(under[: max(1, min(DONORS, len(under) // 2))])
        pool = sorted((sizes[i], i, b) for b in donors for i in bins[b])
        pairs = None
        for b in sorted((x for x in under if x not in donors), key=lambda x: -load[x]):
            gap = capacity - load[b]
            while gap > 0 and pool:  # moves
                at = bisect_right(pool, (gap, len(sizes), 0)) - 1
                while at >= 0 and pool[at][0] == 0:
                    at = -1
                if at < 0:
                    break
                s, i, d = pool.pop(at)
                bins[d].remove(i)
                bins[b].append(i)
                load[d] -= s
                load[b] += s
                gap -= s
                changed, pairs = True, None
            if gap <= 0:
                continue
            # one for one: the exchange that fills the gap most
            best = (0, -1, -1)
            for y in bins[b]:
                at = bisect_right(pool, (sizes[y] + gap, len(sizes), 0)) - 1
                if at >= 0 and pool[at][0] - sizes[y] > best[0]:
                    best = (pool[at][0] - sizes[y], y, at)
                    if best[0] == gap:
                        break
            if best[0] < gap:  # two for one
                if pairs is None:
                    pairs = []
                    for d in donors:
                        items = sorted(bins[d], key=lambda i: sizes[i])[-12:]
                        pairs += [(sizes[p] + sizes[q], p, q, d) for k, p in enumerate(items) for q in items[k + 1 :]]
                    pairs.sort()
                two = (best[0], -1, None)
                for y in bins[b]:
                    at = bisect_right(pairs, (sizes[y] + gap, len(sizes), 0, 0)) - 1
                    if at >= 0 and pairs[at][0] - sizes[y] > two[0]:
                        two = (pairs[at][0] - sizes[y], y, pairs[at])
                if two[2] is not None:
                    gain, y, (_, p, q, d) = two
                    for i in (p, q):
                        bins[d].remove(i)
                        pool.remove((sizes[i], i, d))
                    bins[b].remove(y)
                    bins[b] += [p, q]
                    bins[d].append(y)
                    insort(pool, (sizes[y], y, d))
                    load[b] += gain
                    load[d] -= gain
                    changed, pairs = True, None
                    continue
            if best[0] > 0:
                gain, y, at = best
                s, x, d = pool.pop(at)
                bins[d].remove(x)
                bins[b].remove(y)
                bins[b].append(x)
                bins[d].append(y)
                insort(pool, (sizes[y], y, d))
                load[b] += gain
                load[d] -= gain
                changed, pairs = True, None
        bins = [b for b in bins if b]
        if not changed:
            break
        # what the emptiest hold may now go elsewhere as a whole
        load = [sum(sizes[i] for i in b) for b in bins]
        order = sorted(range(len(bins)), key=lambda b: load[b])
        rest = [i for b in order[: min(DONORS, len(order))] if load[b] < capacity for i in bins[b]]
        gone = set(rest)
        if rest:
            fresh = best_fit([sizes[i] for i in rest], capacity)
            old = [b for b in bins if gone.intersection(b)]
            if len(fresh) < len(old):
                bins = [b for b in bins if not gone.intersection(b)] + [[rest[k] for k in f] for f in fresh]
    return bins


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    return improve(sizes, best_fit(sizes, capacity), capacity)


_ITEM = "plan_id int, capacity bigint, doc_id bigint, piece int, tokens bigint"
_PACKED = _ITEM + ", container string, fill bigint"


def _packer(number: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        sizes = group["tokens"].astype(int).tolist()
        capacity = int(group["capacity"].iloc[0])
        names, fills = [""] * len(sizes), [0] * len(sizes)
        for n, b in enumerate(pack(sizes, capacity)):
            fill = sum(sizes[i] for i in b)
            for i in b:
                names[i], fills[i] = f"{number}-{key[1]}-{n}", fill
        return group[["plan_id", "capacity", "doc_id", "piece", "tokens"]].assign(container=names, fill=fills)

    return run


def pieces(tokens: DataFrame, plans: list[dict]) -> DataFrame:
    """plan_id, capacity, doc_id, piece, tokens. A text above the capacity is split into full pieces and a rest; a text
    without tokens is one piece of 0. A plan without a positive capacity takes no texts. Repeated doc_ids stay apart by
    their piece numbers only if their rows differ; exact repetitions are packed as often as they occur."""
    fitting = [p for p in plans if p["capacity_tokens"] and p["capacity_tokens"] > 0]
    if not fitting:
        return tokens.sparkSession.createDataFrame([], _ITEM)
    listed = F.array(*[F.struct(F.lit(int(p["plan_id"])).cast("int").alias("plan_id"), F.lit(int(p["capacity_tokens"])).cast("bigint").alias("capacity"), F.lit(p["doc_source"]).cast("string").alias("source")) for p in fitting])
    mine = F.filter(listed, lambda p: p["source"].isNull() | (p["source"] == F.col("source")))
    rows = tokens.where("doc_id is not null").select("doc_id", "tokens", F.explode(mine).alias("p")).select("p.plan_id", "p.capacity", "doc_id", "tokens")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")) - 1, F.lit(0))
    cut = rows.select("plan_id", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return cut.select("plan_id", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.col("tokens") - F.col("piece") * F.col("capacity"), F.col("capacity")).alias("tokens"))


def fill_containers(spark: SparkSession, work: Workspace, items: DataFrame, group: int = GROUP, rounds: int = 6) -> DataFrame:
    """plan_id, container, doc_id, piece, tokens of every item. Container names are unique within a plan."""
    items = work.save(items, "items")
    whole = F.col("tokens") == F.col("capacity")
    out = items.where(whole).select("plan_id", F.concat_ws("-", F.lit("whole"), "doc_id", "piece").alias("container"), "doc_id", "piece", "tokens")
    rest = items.where(~whole)
    for number in range(1, rounds + 1):
        # a row for each plan
        counts = {r["plan_id"]: r["n"] for r in rest.groupBy("plan_id").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        groups = {p: max(1, -(-n // group)) for p, n in counts.items()}
        of = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
        last = number == rounds or all(n == 1 for n in groups.values())
        keyed = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), of[F.col("plan_id")]))
        packed = keyed.groupBy("plan_id", "part").applyInPandas(_packer(number), _PACKED)
        packed = work.save(packed, f"round={number}")
        done = F.lit(True) if last else F.col("fill") >= FULL * F.col("capacity")
        out = out.unionByName(packed.where(done).select("plan_id", "container", "doc_id", "piece", "tokens"))
        if last:
            break
        rest = packed.where(~done).select("plan_id", "capacity", "doc_id", "piece", "tokens")
    return out
