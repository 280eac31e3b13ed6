"""Problem 9: filling containers of fixed capacity, by hierarchical residual packing.

Items go to groups; each group is packed by itself, best fit, longest item first.  Bins that are nearly full are
done, the others go on as items of the next level, where groups are fewer and mixed anew, until one group is left.  A
group has about GROUP items on every level: where more bins are open than one group may hold, they go on in several,
until a level saves hardly a bin.  A bin travels with the list of its pieces, which its capacity bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

#: A bin with at most this share of unused room is done; items of a group; groups that merge.
NEARLY, GROUP, FAN_IN = 0.002, 20_000, 8
#: Several groups go on as long as the last level saved this share of its bins.
SAVED = 0.001


class Residuals:
    """Bins by unused room; ``best`` finds the least room that is enough through two levels of bitmaps."""

    def __init__(self, capacity: int) -> None:
        self.bins: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def put(self, room: int, b: int) -> None:
        own = self.bins.setdefault(room, [])
        if not own:
            w = room >> 10
            self.words[w] = self.words.get(w, 0) | 1 << (room & 1023)
            self.top |= 1 << w
        own.append(b)

    def best(self, size: int) -> tuple[int, int] | None:
        """Takes a bin out: (room, bin) with the least room >= size."""
        w = size >> 10
        x = self.words.get(w, 0) >> (size & 1023) << (size & 1023)
        if not x:
            above = self.top >> (w + 1)
            if not above:
                return None
            w += (above & -above).bit_length()
            x = self.words[w]
        room = w << 10 | (x & -x).bit_length() - 1
        own = self.bins[room]
        b = own.pop()
        if not own:
            self.words[w] ^= 1 << (room & 1023)
            if not self.words[w]:
                self.top ^= 1 << w
        return room, b


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item, longest first."""
    rooms, to, n = Residuals(capacity), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = rooms.best(sizes[i])
        if got is None:
            got, n = (capacity, n), n + 1
        to[i] = got[1]
        if got[0] > sizes[i]:
            rooms.put(got[0] - sizes[i], got[1])
    return to


SCHEMA = "container string, capacity bigint, grp bigint, used bigint, piece_ids array<bigint>, done boolean"


def _pack(key: tuple, pdf: pd.DataFrame, last: bool, nearly: float) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["used", "first"], ascending=[False, True], kind="stable")
    sizes = [int(x) for x in pdf["used"]]
    used: dict[int, int] = {}
    pieces: dict[int, list] = {}
    for b, s, p in zip(best_fit(sizes, capacity), sizes, pdf["piece_ids"], strict=True):
        used[b] = used.get(b, 0) + s
        pieces.setdefault(b, []).extend(p)
    out = pd.DataFrame({"used": list(used.values()), "piece_ids": list(pieces.values())})
    out["done"] = last | (out["used"] >= capacity * (1 - nearly))
    out["container"], out["capacity"], out["grp"] = pdf["container"].iloc[0], capacity, key[1]
    return out[["container", "capacity", "grp", "used", "piece_ids", "done"]]


def _packer(last: bool, nearly: float):
    return lambda key, pdf: _pack(key, pdf, last, nearly)


def pack(items: DataFrame, limits: DataFrame, key: str = "doc_id", size: str = "tokens", container: str = "container", capacity: str = "capacity_tokens", group: int = GROUP, nearly: float = NEARLY) -> DataFrame:
    """container, bin, key, piece_no, piece_start, piece_size: one row per item, or piece of a too long item, and container.

    Null, zero and negative sizes need no room and give no row.  An item is split only if it exceeds the
    capacity: into full pieces and the rest.  Containers without a positive capacity, and null keys, are left
    out; equal rows of ``limits`` count once.  Repeated keys are items of their own.  Which bin an item
    comes into is not fixed, what bins hold is; equal sizes are packed in the order of their arrival.
    """
    spark = items.sparkSession
    lim = limits.select(F.col(container).alias("container"), F.col(capacity).cast("bigint").alias("capacity")).filter("capacity > 0").distinct()
    caps = [(r["container"], r["capacity"]) for r in lim.collect()]  # one row per kind of container
    base = items.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")).filter("size > 0 and key is not null")
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("bigint").alias("capacity")) for c, n in caps])) if caps else None
    out_schema = f"container string, bin bigint, {key} {dict(base.dtypes)['key']}, piece_no int, piece_start bigint, piece_size bigint"
    if kinds is None:
        return spark.createDataFrame([], out_schema)
    each = base.select("key", "size", kinds.alias("k")).select("key", "size", "k.*")
    starts = F.expr("explode(sequence(0L, size - 1, capacity))")
    piece = each.select("container", "capacity", "key", "size", starts.alias("start")).withColumn("used", F.least(F.col("capacity"), F.col("size") - F.col("start")))
    piece = cut(piece.withColumn("pid", F.monotonically_increasing_id()))
    counts = {r["container"]: r["n"] for r in piece.groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = max([1, *((n + group - 1) // group for n in counts.values())])
    # full pieces are bins already
    level = piece.filter("used < capacity").select("container", "capacity", F.pmod(F.xxhash64("pid"), F.lit(groups)).alias("grp"), "used", F.array("pid").alias("piece_ids"))
    done = [piece.filter("used = capacity").select(F.array("pid").alias("piece_ids"))]
    went_in, n_level = max(counts.values(), default=0), 0
    while True:
        last = groups == 1
        packed = cut(
            level.withColumn("first", F.col("piece_ids")[0])
            .groupBy("container", "grp")
            .applyInPandas(_packer(last, nearly), SCHEMA)
        )
        done.append(packed.filter("done").select("piece_ids"))
        if last:
            break
        sizes = [(r["open"], r["n"]) for r in packed.groupBy("container").agg(F.count_if(~F.col("done")).alias("open"), F.count(F.lit(1)).alias("n")).collect()]
        still, n_level = max((o for o, _ in sizes), default=0), n_level + 1
        needed = -(-still // group)
        if needed > 1 and n_level > 1 and max((n for _, n in sizes), default=0) > (1 - SAVED) * went_in:
            done.append(packed.filter("not done").select("piece_ids"))  # what is open does not fit together
            break
        groups, went_in = max((groups + FAN_IN - 1) // FAN_IN, min(needed, groups)), still
        level = packed.filter("not done").select("container", "capacity", F.pmod(F.xxhash64(F.col("piece_ids")[0], F.lit(n_level)), F.lit(groups)).alias("grp"), "used", "piece_ids")
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    where = bins.select(F.array_min("piece_ids").alias("bin"), F.explode("piece_ids").alias("pid"))
    number = (F.col("start") / F.col("capacity")).cast("int").alias("piece_no")
    return piece.join(where, "pid").select("container", "bin", F.col("key").alias(key), number, F.col("start").alias("piece_start"), F.col("used").alias("piece_size"))


def waste(packed: DataFrame, limits: DataFrame, container: str = "container", capacity: str = "capacity_tokens") -> DataFrame:
    """container, bins, tokens, least (bins that the tokens need at least), above (bins beyond that), unused (share of
    the bins' room), overfull (bins beyond the capacity): what a packing is worth."""
    lim = limits.select(F.col(container).alias("container"), F.col(capacity).cast("bigint").alias("capacity")).filter("capacity > 0").distinct()
    fill = packed.groupBy("container", "bin").agg(F.sum("piece_size").alias("used")).join(lim, "container")
    out = fill.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return out.select("container", "bins", "tokens", least.alias("least"), (F.col("bins") - least).alias("above"), (1 - F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("unused"), "overfull")
