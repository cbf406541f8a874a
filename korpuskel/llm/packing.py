"""Filling fixed-capacity containers with items.

Best-two-fit: a container is filled greedily with the largest items that fit;
then its smallest item is replaced by two unpacked items that fit the gap so
expanded more tightly, as long as such a pair exists.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ITEMS_PER_SHARD = 50_000


class _Stock:
    """Unpacked items by size; sets of sizes are bits of integers, which makes each look-up one step."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity = capacity
        order = np.argsort(sizes, kind="stable")
        self.left: dict[int, list[int]] = {}
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(order)]):
            if b > a:
                self.left[int(sizes[order[a]])] = order[a:b][::-1].tolist()  # the first item goes out first
        self.has = sum(1 << s for s in self.left)
        self.mirror = sum(1 << (capacity - s) for s in self.left)

    def largest(self, room: int) -> int:
        """The largest size that fits, 0 if none does."""
        return max(0, (self.has & ((1 << (room + 1)) - 1)).bit_length() - 1)

    def take(self, size: int) -> int:
        items = self.left[size]
        item = items.pop()
        if not items:
            del self.left[size]
            self.has ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)
        return item

    def put(self, size: int, item: int) -> None:
        if size not in self.left:
            self.left[size] = []
            self.has ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)
        self.left[size].append(item)

    def pair(self, above: int, most: int) -> tuple[int, int] | None:
        """Two sizes with the largest sum in (above, most]."""
        for total in range(most, above, -1):
            both = self.has & (self.mirror >> (self.capacity - total))
            if total % 2 == 0 and both >> (total // 2) & 1 and len(self.left[total // 2]) < 2:
                both ^= 1 << (total // 2)
            if both:
                a = both.bit_length() - 1
                return a, total - a
        return None


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of the items in each container; every size is between 1 and ``capacity``."""
    stock, full = _Stock(sizes, capacity), []
    while stock.has:
        inside: list[tuple[int, int]] = []
        room = capacity
        while size := stock.largest(room):
            inside.append((size, stock.take(size)))
            room -= size
        while room:
            smallest, item = min(inside)
            two = stock.pair(smallest, room + smallest)
            if not two:
                break
            inside.remove((smallest, item))
            inside += [(s, stock.take(s)) for s in two]
            stock.put(smallest, item)
            room += smallest - sum(two)
        full.append([i for _, i in inside])
    return full


def pack_items(items: DataFrame, ident: str, size: str, capacity: int, total_rows: int, per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """Containers of ``capacity`` with every item of a positive size, whole unless it is larger than the capacity.

    A larger item is cut into full containers of its own and a rest that is
    packed as an item. Result: ``container_id`` (unique, the same on every run),
    arrays ``ids``, ``starts`` (first unit of the piece in its item) and
    ``sizes``, ``used`` and ``unused``. Repeated rows are packed each; items of
    size 0 or null need no room and are in no container.

    Items go by a hash of identifier, size and repeat number into shards of about
    ``per_shard``, packed independently, each losing at most about one container's
    room. Repeats are counted before they are numbered, so an identifier that a
    third of the rows share is in no task as a whole.
    """
    shards = max(1, -(-total_rows // per_shard))
    counted = items.where(F.col(size) > 0).groupBy(F.col(ident).alias("_id"), F.col(size).cast("long").alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.select("_id", "_size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_repeat"))
    shard = F.when(F.col("_repeat") == 1, F.pmod(F.xxhash64("_id"), F.lit(shards))).otherwise(F.pmod(F.xxhash64("_id", "_size", "_repeat"), F.lit(shards))).cast("int")
    kept = numbered.select(shard.alias("_shard"), "_id", "_size")
    ident_type = kept.schema["_id"].dataType
    fields = [("container_id", T.LongType()), ("ids", T.ArrayType(ident_type)), ("starts", T.ArrayType(T.LongType())), ("sizes", T.ArrayType(T.LongType())), ("used", T.LongType()), ("unused", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    arrow = to_arrow_schema(schema)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending"), ("_size", "ascending")])
        size_of, base = table["_size"].to_numpy(), table["_shard"][0].as_py() << 40
        whole, rest = size_of // capacity, size_of % capacity
        packed = np.flatnonzero(rest)
        bins = [packed[b] for b in pack(rest[packed], capacity)]
        owners = np.repeat(np.arange(len(size_of)), whole)
        ordinal = np.arange(len(owners)) - np.repeat(np.cumsum(whole) - whole, whole)
        rows = np.concatenate([owners, *bins]).astype(np.int64)
        starts = np.concatenate([ordinal * capacity, *[whole[b] * capacity for b in bins]]).astype(np.int64)
        sizes = np.concatenate([np.full(len(owners), capacity), *[rest[b] for b in bins]]).astype(np.int64)
        ends = np.concatenate([np.arange(len(owners) + 1), len(owners) + np.cumsum([len(b) for b in bins], dtype=np.int64)])
        used = np.add.reduceat(sizes, ends[:-1])
        ids = pa.concat_arrays(table["_id"].take(pa.array(rows)).chunks)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (ids, pa.array(starts), pa.array(sizes))]
        out = [pa.array(base + np.arange(len(used))), *lists, pa.array(used), pa.array(capacity - used)]
        return pa.Table.from_arrays(out, names=schema.names).cast(arrow)

    return kept.groupBy("_shard").applyInArrow(fill, schema)
