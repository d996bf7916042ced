"""Sharding: whole groups of equal texts by best-fit-decreasing bin packing into fixed shards.

Law `bytes`: the shards' sizes are near equal. Groups sorted by size enter the tightest bin that
has room, found in a balanced tree of remaining capacities; the capacity is the smallest, found
by bisection, with which the wanted number of shards suffices.

The driver plans over the histogram of the groups' sizes: exact up to 2**BITS bytes, beyond that with BITS
leading bits, so it has some ten thousand entries at most for any corpus. Groups of one size are alike:
the tightest bin with room stays the tightest until it is full for their size, so they enter it all
at once, as they would one after the other. A group takes the shard that holds its rank within its
size; its rows join it. A group larger than an even share of all bytes (there are fewer of them than
shards) cannot stay whole under the law: its rows are items of their own.

Null text: a group of its own with 0 bytes (size 1). Null ids and repeated rows keep one slot each, told
apart by a salt. Ties of groups go by a hash of the text. Very long texts are hashed in the JVM, one at a
time. Empty table: no rows. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import dropped, ranked, stored

#: Leading bits of a size that name its class.
BITS = 10

Node = tuple  # (left, key, right, height)


def _height(t: Node | None) -> int:
    return t[3] if t else 0


def _node(left: Node | None, key: tuple, right: Node | None) -> Node:
    """A node whose subtrees differ in height by at most one, from some that differ by at most two."""
    lean = _height(left) - _height(right)
    if lean > 1:
        a, k, b, _ = left
        if _height(a) >= _height(b):
            return _node(a, k, _node(b, key, right))
        return _node(_node(a, k, b[0]), b[1], _node(b[2], key, right))
    if lean < -1:
        a, k, b, _ = right
        if _height(b) >= _height(a):
            return _node(_node(left, key, a), k, b)
        return _node(_node(left, key, a[0]), a[1], _node(a[2], k, b))
    return (left, key, right, 1 + max(_height(left), _height(right)))


class CapacityTree:
    """Bins in an AVL tree by (room, number): insertion, and removal of the tightest bin with room, in O(log n)."""

    def __init__(self) -> None:
        self.top: Node | None = None

    def insert(self, room: float, number: int) -> None:
        def put(t: Node | None, key: tuple) -> Node:
            if not t:
                return (None, key, None, 1)
            return _node(put(t[0], key), t[1], t[2]) if key < t[1] else _node(t[0], t[1], put(t[2], key))

        self.top = put(self.top, (room, number))

    def take(self, size: float) -> tuple[float, int] | None:
        """Remove and return the tightest bin with room for size."""
        best, t = None, self.top
        while t:
            if t[1][0] >= size:
                best, t = t[1], t[0]
            else:
                t = t[2]
        if best:
            self.top = self._without(self.top, best)
        return best

    def _without(self, t: Node, key: tuple) -> Node | None:
        if key < t[1]:
            return _node(self._without(t[0], key), t[1], t[2])
        if key > t[1]:
            return _node(t[0], t[1], self._without(t[2], key))
        if not t[0] or not t[2]:
            return t[0] or t[2]
        least = t[2]
        while least[0]:
            least = least[0]
        return _node(t[0], least[1], self._without(t[2], least[1]))

    def __iter__(self) -> Iterator[tuple[float, int]]:
        def walk(t: Node | None) -> Iterator[tuple[float, int]]:
            if t:
                yield from walk(t[0])
                yield t[1]
                yield from walk(t[2])

        return walk(self.top)


def best_fit_decreasing(sizes: list[tuple[int, int, float]], capacity: float) -> tuple[list[tuple[int, int, int, int]], int]:
    """Slots (class, first rank, end rank, bin) and the number of bins, for (class, count, size) by falling size; what exceeds the capacity gets a bin of its own."""
    out, tree, bins = [], CapacityTree(), 0
    for name, count, size in sizes:
        done = 0
        while done < count:
            found = tree.take(size)
            room, b = found if found else (capacity, bins)
            bins += not found
            some = min(count - done, max(1, int(room // size)))
            out.append((name, done, done + some, b))
            done += some
            tree.insert(room - some * size, b)
    return out, bins


def fewest_capacity(sizes: list[tuple[int, int, float]], shards: int) -> tuple[list[tuple[int, int, int, int]], float]:
    """Slots by the smallest capacity, to a 10,000th, with which best-fit-decreasing needs at most `shards` bins."""
    total, most = sum(n * s for _, n, s in sizes), max((s for _, _, s in sizes), default=1)
    low, high = max(most, total / shards), max(most, 2 * total / shards) + 1
    while best_fit_decreasing(sizes, high)[1] > shards:
        high *= 2
    while high - low > max(1, total / shards / 10000):
        mid = (low + high) / 2
        low, high = (low, mid) if best_fit_decreasing(sizes, mid)[1] <= shards else (mid, high)
    return best_fit_decreasing(sizes, high)[0], high


def size_class(size: Column) -> Column:
    """A size with all but its BITS leading bits cleared."""
    drop = F.greatest(F.floor(F.log2(size.cast("double")) + 1e-12).cast("int") - (BITS - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and group (SHA-256 of the text) for every row."""
    spark, raw = docs.sparkSession, F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"null")).alias("group"))
    rows = stored(rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(61)).cast("int")), "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"))
    groups = stored(groups.withColumn("class", size_class(F.col("bytes"))), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = -(-total // shards)
    whole = groups.filter(F.col("bytes") <= share)
    # by size classes, of which there are some ten thousand at most
    counts = {r["class"]: [r["n"], r["bytes"]] for r in whole.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()}
    loose = []  # groups over an even share: fewer than shards
    for r in groups.filter(F.col("bytes") > share).select("group", "bytes", "rows", "size", size_class(F.col("size")).alias("each")).orderBy("group").collect():
        c = counts.setdefault(r["each"], [0, 0])
        loose.append((bytes(r["group"]), r["each"], c[0]))
        c[0] += r["rows"]
        c[1] += r["bytes"]
    sizes = sorted(((c, n, b / n) for c, (n, b) in counts.items()), key=lambda x: (-x[2], x[0]))
    slots, _ = fewest_capacity(sizes, shards)
    plan = F.broadcast(spark.createDataFrame(slots, "class long, first long, end long, shard int"))  # some slots a class
    own = ranked(whole.select("group", "class"), ["class"], [F.col("group")], "rank", lanes=32).join(plan, "class").filter("rank >= first and rank < end").select("group", "shard")
    some = spark.createDataFrame(loose, "group binary, class long, base long")
    single = ranked(rows.join(F.broadcast(some), "group"), ["group"], [F.col(id_col), F.col("salt")], "rank", lanes=256).withColumn("rank", F.col("rank") + F.col("base"))
    single = single.join(plan, "class").filter("rank >= first and rank < end")
    cols = [id_col, "size", "text_crc32", "group", "salt", "shard"]
    out = stored(rows.join(own, "group").select(cols).unionByName(single.select(cols)), "shard-placed")
    dropped(rows, groups)
    out = ranked(out, ["shard"], [F.col(id_col), F.col("group"), F.col("salt")], "slot", lanes=256)
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", "group")
