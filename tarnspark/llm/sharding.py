"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are the rows with equal keys (equal texts, say).  Best-fit decreasing needs only their sizes and how many
groups have each, so a histogram of sizes is what the driver packs, not the groups: sizes, largest first, enter the
tightest bin that still holds them, found in a balanced tree of remaining capacities, as many of a size as
the bin takes.  The capacity is the least for which so many bins suffice (binary search, as in MULTIFIT).  Each size then
has a quota of groups for each shard, and the groups of a size are numbered to fill it.

Sizes are told apart to 13 significant bits (``size_class``, rounded up), so the histogram has about 200,000 rows at most, whatever the data.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.llm._scratch import free_names, save

#: Significant bits of a size.
BITS = 13
#: A group with at least this part of all bytes, or of all rows, is placed by a broadcast row of its own, so that no shuffle holds its rows together.
HEAVY = 512
CELLS = 4096


class CapacityTree:
    """A treap of (remaining capacity, bin), balanced in expectation, with a search for the tightest fit."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.random = random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            node[3] = left
            return node, right
        left, right = self._split(node[2], key)
        node[2] = right
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.random.random(), None, None]), right)

    def remove(self, key: tuple[int, int]) -> None:
        left, rest = self._split(self.root, key)
        _, right = self._split(rest, (key[0], key[1] + 1))
        self.root = self._merge(left, right)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (remaining, bin) with remaining >= size."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


def best_fit_decreasing(sizes: Sequence[int], counts: Sequence[int], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each size, largest first, the (bin, number of items) that its ``counts`` items go to; None if that needs more than ``most`` bins.

    ``sizes`` descend.  Of equal items each goes to the tightest bin that holds it, which is then the tightest again while it
    holds another; so they go in runs.  An item above the capacity gets a bin of its own.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size, count in zip(sizes, counts, strict=True):
        runs = []
        while count:
            found = tree.tightest(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                left, place = max(capacity, size), bins
                bins += 1
            else:
                tree.remove(found)
                left, place = found
            n = min(count, left // size)
            tree.insert((left - n * size, place))
            runs.append((place, n))
            count -= n
        out.append(runs)
    return out


def pack_into(sizes: Sequence[int], counts: Sequence[int], shards: int) -> list[list[tuple[int, int]]]:
    """Best-fit decreasing with the least capacity, by search from the even share on, that needs ``shards`` bins at most.

    Items above the capacity have bins of their own, and the others share what is left evenly.
    """
    if not sizes:
        return []
    total, bins, k = sum(s * n for s, n in zip(sizes, counts, strict=True)), shards, 0
    while k < len(sizes) and counts[k] < bins and sizes[k] * bins > total:
        total, bins, k = total - sizes[k] * counts[k], bins - counts[k], k + 1
    low = max(1, -(-total // bins))
    step, high = 1, low
    while (best := best_fit_decreasing(sizes, counts, high, shards)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        capacity = (low + high) // 2
        tried = best_fit_decreasing(sizes, counts, capacity, shards)
        if tried is None:
            low = capacity + 1
        else:
            best, high = tried, capacity
    return best


def size_class(size: Column) -> Column:
    """``size`` rounded up to ``BITS`` significant bits."""
    unit = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - (BITS - 1), F.lit(0))
    scale = F.pow(F.lit(2.0), unit).cast("long")
    return (F.ceil(size / scale) * scale).cast("long")


def assign_shards(rows: DataFrame, group: str, size: str, shards: int, cells: int = CELLS) -> DataFrame:
    """``rows``, a saved table, with a column ``shard``; rows of equal ``group`` (a long, not null) share it.

    Sizes are positive.  An empty table stays empty.  Every row keeps its place in
    exactly one shard, and the shards' sizes differ by little unless a group is larger
    than a shard's share.  Only the histogram of sizes and, for sizes that go to several shards, counts of hash cells reach the driver.
    """
    spark = rows.sparkSession
    groups = save(rows.groupBy(F.col(group).alias("_g")).agg(F.sum(size).alias("_s"), F.count("*").alias("_c")).withColumn("_k", size_class(F.col("_s"))), "shard-groups")
    histogram = groups.groupBy("_k").count().orderBy(F.desc("_k")).collect()
    placed = pack_into([r["_k"] for r in histogram], [r["count"] for r in histogram], shards)
    quotas, split = [], []
    for r, runs in zip(histogram, placed, strict=True):
        at, ends = 0, []
        for _, n in runs:
            at += n
            ends.append(at)
        quotas.append((r["_k"], ends, [b for b, _ in runs]))
        if len({b for b, _ in runs}) > 1:
            split.append((r["_k"],))
    quota = F.broadcast(spark.createDataFrame(quotas, "_k long, _ends array<long>, _bins array<int>"))  # a row for each size
    several = F.broadcast(spark.createDataFrame(split, "_k long"))
    cell = F.pmod(F.xxhash64("_g"), F.lit(cells)).cast("int")
    divided = groups.join(several, "_k", "left_semi").withColumn("_cell", cell)
    starts, at = [], {}
    for k, c, n in divided.groupBy("_k", "_cell").count().orderBy("_k", "_cell").collect():
        starts.append((k, c, at.get(k, 0)))
        at[k] = at.get(k, 0) + n
    offsets = F.broadcast(spark.createDataFrame(starts, "_k long, _cell int, _o long"))
    number = F.row_number().over(Window.partitionBy("_k", "_cell").orderBy("_g")) - 1
    numbered = divided.withColumn("_n", number).join(offsets, ["_k", "_cell"]).select("_g", "_s", "_c", "_k", (F.col("_o") + F.col("_n")).alias("_n"))
    whole = groups.join(several, "_k", "left_anti").select("_g", "_s", "_c", "_k", F.lit(0).cast("long").alias("_n"))
    place = F.element_at("_bins", F.size(F.filter("_ends", lambda e: e <= F.col("_n"))) + 1)
    homes = save(numbered.unionByName(whole).join(quota, "_k").select("_g", "_s", "_c", place.alias("_home")), "shard-homes")
    total, n = homes.agg(F.sum("_s"), F.sum("_c")).first()
    heavy = homes.where((F.col("_s") * HEAVY >= (total or 0)) | (F.col("_c") * HEAVY >= (n or 0)))  # 2 * HEAVY rows at most
    g, home = free_names(rows, "_g", "_home")
    named = lambda df: df.select(F.col("_g").alias(g), F.col("_home").alias(home))
    some = rows.join(F.broadcast(named(heavy)), F.col(group) == F.col(g), "left")
    done = some.where(F.col(home).isNotNull()).withColumn("shard", F.col(home)).drop(g, home)
    rest = some.where(F.col(home).isNull()).drop(g, home).join(named(homes), F.col(group) == F.col(g)).withColumn("shard", F.col(home)).drop(g, home)
    return done.unionByName(rest)


def number_slots(rows: DataFrame, shard: str, row: str, cells: int = CELLS) -> DataFrame:
    """``rows``, a saved table with numbers ``row`` of their own, with ``slot``: gapless from 0 within each shard.

    Rows are ordered within hash cells of ``row`` only; the cells' counts, a number fixed
    by parameters, give the offsets, so no task orders a whole shard.
    """
    spark = rows.sparkSession
    celled = rows.withColumn("_cell", F.pmod(F.xxhash64(row), F.lit(cells)).cast("int"))
    counts = celled.groupBy(shard, "_cell").count().orderBy(shard, "_cell").collect()
    starts, at = [], {}
    for s, c, n in counts:
        starts.append((s, c, at.get(s, 0)))
        at[s] = at.get(s, 0) + n
    offsets = spark.createDataFrame(starts, "_s int, _c int, _o long")
    within = F.row_number().over(Window.partitionBy(shard, "_cell").orderBy(row))
    return (
        celled.withColumn("_n", within)
        .join(F.broadcast(offsets), (F.col(shard) == F.col("_s")) & (F.col("_cell") == F.col("_c")))
        .withColumn("slot", F.col("_o") + F.col("_n") - 1)
        .drop("_cell", "_s", "_c", "_o", "_n")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All documents in ``shards`` shards of near-equal bytes; equal texts stay together.

    Size: UTF-8 bytes of the text, null counting as none, plus 1.  Repeated rows are rows of
    their own with slots of their own.  A null doc_id is kept.  Other columns are ignored.  Null and empty texts are one group.
    Groups are told apart by a 64-bit hash of the text; a collision would only keep two groups together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_group"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = save(assign_shards(save(slim, "shard-rows"), "_group", "size", shards), "sharded-rows")
    return number_slots(placed, "shard", "_row").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
