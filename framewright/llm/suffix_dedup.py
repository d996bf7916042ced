"""Suffix-array dedup of exact repeats, by blockwise construction with a difference cover.

A byte is removed when some string of `width` bytes that covers it also starts anywhere else (the
same text included); strings never cross texts.

Suffixes are sorted bucket by bucket. The bucket of a suffix is the smallest hash among the
`SEED`-byte strings within its first `width` bytes (of equal ones the first), so suffixes that
share `width` bytes share a bucket. Neighbouring suffixes mostly have the same smallest string:
they are kept as one stretch of text, about one for every 68 bytes.

1. Stretches are listed with the hash of their bucket and of their own bytes. A bucket with one
   stretch holds no repeat. Equal stretches of a bucket are counted, not compared.
2. A bucket of more than HOT bytes of different stretches (a common line in many contexts) is split
   by a second string: the smallest hash of those that do not overlap the first; what is still larger
   by the first and last SEED bytes. Suffixes that share `width` bytes share these, too, so no repeat
   is lost; the parts' marks are carried back to the stretches that they came from.
3. Buckets with different stretches are sorted, some at a time in a block of bounded size: by the
   first COVER bytes of each suffix, and where these tie, by the ranks of the difference-cover
   sample, at the distance at which both suffixes have a sample position. Sample ranks come from
   doubling within the sample (COVER divides the step, so a sample position leads to another).
   Neighbours in suffix order that share `width` bytes mark each other, by comparison of the bytes.
4. The marked suffixes are joined back to the stretches' places, and each text loses their bytes.

Hot strings: copies of a stretch meet only in a count, which is combined before the shuffle, and
in joins that AQE can split. A bucket of one repeated run (a long line of one letter) has equal
stretches, too. A block keeps whole buckets. Stretches are equal if both their bucket's hash and their
own agree (128 bits from two kinds of hash).

Null and empty: no bytes. Texts under `width` bytes keep all. Repeated rows are repeats of each other;
rows of one id are told apart by number. Ties of hashes go to the first place. Very long texts are
read in segments. Empty table: no rows. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import common
from framewright.llm.common import dropped, stored

SEED, COVER, WORK = 64, 64, 2 << 20
#: Bytes of different stretches beyond which a bucket is split, and bytes of a text read at once.
HOT, SEGMENT = 4 << 20, 1 << 26
#: Low bits of a comparison key that hold the place.
PLACE = np.uint64((1 << 28) - 1)


@functools.cache
def difference_cover(v: int = COVER) -> tuple[np.ndarray, np.ndarray]:
    """A set D with every difference modulo v, greedily, and delta[i, j] with i + delta and j + delta in D."""
    d, have = [0], {0}
    while len(have) < v:
        best = max((x for x in range(v) if x not in d), key=lambda x: (len({s for y in d for s in ((x - y) % v, (y - x) % v)} - have), -x))
        have |= {s for y in d for s in ((best - y) % v, (y - best) % v)}
        d.append(best)
    member = np.zeros(v, bool)
    member[d] = True
    delta = np.zeros((v, v), np.int64)
    for i in range(v):
        for j in range(v):
            delta[i, j] = next(x for x in range(v) if member[(i + x) % v] and member[(j + x) % v])
    return member, delta


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the rows of several key columns, equal rows equal."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Block:
    """Suffix order within one block of text (zero bytes follow it)."""

    def __init__(self, text: np.ndarray, width: int):
        self.n, self.width = len(text), width
        deep = COVER
        while deep < width:
            deep *= 2
        padded = np.concatenate([text, np.zeros(deep + 2 * COVER + width + 8, np.uint8)])
        # the eight bytes from each place, as one big-endian number
        self.key = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,)).astype(np.uint64)
        member, self.delta = difference_cover()
        size = self.n + deep + 2 * COVER
        places = np.flatnonzero(np.resize(member, size))
        rank = np.zeros(size + deep, np.int64)
        inside = places[places < self.n + COVER]
        rank[inside] = _dense(*[self.key[inside + 8 * j] for j in range(COVER // 8)]) + 1
        step = COVER
        while step < deep:  # rank over 2 * step bytes, from two ranks over step bytes
            both = _dense(rank[inside], rank[inside + step])
            rank[inside] = both + 1
            step *= 2
        self.rank = rank

    def order(self, suffix: np.ndarray) -> np.ndarray:
        """The suffixes, sorted."""
        keys = [self.key[suffix + 8 * j] for j in range(COVER // 8)]
        first = _dense(*keys)
        at = np.argsort(first, kind="stable")
        suffix, group = suffix[at], first[at]
        open_ = np.zeros(len(suffix), bool)
        same = group[1:] == group[:-1]
        open_[1:] |= same
        open_[:-1] |= same
        # ties: each group is split by its middle suffix into less, equal and greater, all groups at once
        idx = np.flatnonzero(open_)
        part = group.astype(np.int64) * 1
        lower = np.zeros(len(suffix), np.int64)
        while len(idx):
            g = part[idx]
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            count = np.diff(np.concatenate([start, [len(g)]]))
            pivot = np.repeat(suffix[idx[start + count // 2]], count)
            own = suffix[idx]
            d = self.delta[own % COVER, pivot % COVER]
            sign = np.sign(self.rank[own + d] - self.rank[pivot + d])
            again = np.lexsort((sign, np.repeat(np.arange(len(start)), count)))
            suffix[idx] = own[again]
            sign, block = sign[again], np.repeat(np.arange(len(start)), count)
            # new groups are numbered by the place of their first suffix
            cut = np.concatenate([[True], (block[1:] != block[:-1]) | (sign[1:] != sign[:-1])])
            first_at = np.flatnonzero(cut)
            number = idx[first_at][np.cumsum(cut) - 1]
            part[idx] = number - len(suffix) - 1
            lower[idx] = sign
            size = np.diff(np.concatenate([first_at, [len(idx)]]))[np.cumsum(cut) - 1]
            idx = idx[(sign != 0) & (size > 1)]
        return suffix

    def repeated(self, suffix: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For sorted suffixes, whether a neighbour shares `width` bytes; limit: bytes up to the end of the stretch."""
        same = np.minimum(limit[1:], limit[:-1]) >= self.width
        a, b = suffix[1:][same], suffix[:-1][same]
        equal = np.ones(len(a), bool)
        whole, rest = divmod(self.width, 8)
        for j in [8 * x for x in range(whole)] + ([self.width - 8] if rest else []):
            equal &= self.key[a + j] == self.key[b + j]
        hit = np.zeros(len(suffix) - 1, bool)
        hit[np.flatnonzero(same)] = equal
        out = np.zeros(len(suffix), bool)
        out[1:] |= hit
        out[:-1] |= hit
        return out


def _floor_windows(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every w consecutive keys."""
    m, have = key, 1
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(key) - w + 1], m[w - have :]) if w > have else m


def stretches(docs: DataFrame, width: int) -> DataFrame:
    """row, bucket, own (hash of the stretch), start (first suffix), n (number of suffixes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = width - SEED + 1
        for part, whole, off in common.blocks(batches):
            for at in range(0, len(whole), SEGMENT):
                buf = whole[at : at + SEGMENT + width - 1]
                if len(buf) < width:
                    continue
                prefix = common.Prefix(buf)
                seed = prefix.all(SEED)
                key = seed & ~PLACE | np.arange(len(seed), dtype=np.uint64)
                anchor = (_floor_windows(key, w) & PLACE).astype(np.int64)
                doc = np.searchsorted(off, np.arange(at, at + len(buf)), "right").astype(np.int32) - 1
                s = np.flatnonzero(doc[: len(anchor)] == doc[width - 1 :])
                if not len(s):
                    continue
                a = anchor[s]
                cut = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1) | (doc[s[1:]] != doc[s[:-1]])])
                i = np.flatnonzero(cut)
                count = np.diff(np.concatenate([i, [len(s)]]))
                start = s[i]
                end = start + count - 1 + width
                row = part.column(0).take(pa.array(doc[start]))
                yield pa.record_batch([row, pa.array(seed[a[i]].view(np.int64)), pa.array(prefix.of(start, end).view(np.int64)), pa.array((start + at - off[doc[start]]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["row", "bucket", "own", "start", "n"])

    return docs.select("row", "text").mapInArrow(common.trimmed(run), "row long, bucket long, own long, start int, n int")


class Minima:
    """Smallest key of any range of up to 255 keys."""

    def __init__(self, key: np.ndarray):
        self.top, self.rows = np.uint64((1 << 64) - 1), [key]
        for j in range(7):
            m, have = self.rows[-1], 1 << j
            self.rows.append(np.minimum(m, np.append(m[have:], np.full(min(have, len(m)), self.top))))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over [lo, hi]; the greatest number where that is empty."""
        out = np.full(len(lo), self.top)
        size = hi - lo + 1
        for j, m in enumerate(self.rows):
            at = np.flatnonzero((size >= 1 << j) & (size < 2 << j))
            out[at] = np.minimum(m[lo[at]], m[hi[at] - (1 << j) + 1])
        return out


def split(pieces: DataFrame, width: int, level: int) -> DataFrame:
    """Stretches (bucket, own, n, text, row, start) of hot buckets in parts: bucket, own of the part, its shift, row, start and n, and pbucket, pown.

    Level 1: the part's bucket is also named by the smallest hash that does not overlap the first; level 2: by
    the hashes of the first and the last bytes, each suffix apart.
    """

    def parts(rows: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size, n = np.array([len(r[3]) for r in rows]), np.array([r[2] for r in rows])
        base = np.cumsum(size) - size
        which = np.repeat(np.arange(len(rows)), n)
        first = np.cumsum(n) - n
        s = np.arange(n.sum()) - first[which] + base[which]
        prefix = common.Prefix(text)
        seed = prefix.all(SEED)
        last = width - SEED
        old = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        if level == 1:
            low = Minima(seed & ~PLACE | np.arange(len(seed), dtype=np.uint64))
            a = (low.of(base, base + last) & PLACE).astype(np.int64)[which]
            b = (np.minimum(low.of(s, a - SEED), low.of(a + SEED, s + last)) & PLACE).astype(np.int64)
            name = common.mix(seed[b] + common.mix((b - a).view(np.uint64)))
        else:
            name = common.mix(seed[s] + common.mix(seed[s + last]))
        cut = np.concatenate([[True], (name[1:] != name[:-1]) | (which[1:] != which[:-1])]) if level == 1 else np.ones(len(s), bool)
        i = np.flatnonzero(cut)
        count, k = np.diff(np.append(i, len(s))), which[i]
        col = lambda j: np.array([r[j] for r in rows], np.int64)[k]
        shift = s[i] - base[k]
        own = prefix.of(s[i], s[i] + count - 1 + width)
        return pa.record_batch([pa.array(c) for c in (common.mix(old[k] + name[i]).view(np.int64), own.view(np.int64), shift, col(4), (col(5) + shift), count, col(0), col(1))], names=["bucket", "own", "shift", "row", "start", "n", "pbucket", "pown"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(r)
                held += len(r[3])
                if held > common.BLOCK // 4:
                    yield parts(rows)
                    rows, held = [], 0
        if rows:
            yield parts(rows)

    return pieces.select("bucket", "own", "n", "text", "row", "start").mapInArrow(common.trimmed(run), "bucket long, own long, shift long, row long, start long, n long, pbucket long, pown long")


def sorted_buckets(pieces: DataFrame, width: int) -> DataFrame:
    """bucket, own, n and the marked suffixes as runs (lo, hi) for pieces (bucket, own, n, text)."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = np.array([len(r[3]) for r in rows])
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = np.array([r[2] for r in rows])
        which = np.repeat(np.arange(len(rows)), n)
        suffix = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[which]
        block = Block(text, width)
        s = block.order(suffix)
        owner = np.searchsorted(base, s, "right") - 1
        mark = np.zeros(len(text) + 1, bool)
        mark[s[block.repeated(s, base[owner] + size[owner] - s)]] = True
        hit = mark[suffix]
        edge = np.concatenate([[True], which[1:] != which[:-1]])
        begin = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
        last = np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]]))
        own = which[begin]
        lo, hi = suffix[begin] - base[own], suffix[last] - base[own]
        yield pa.record_batch([pa.array([rows[k][0] for k in own], pa.int64()), pa.array([rows[k][1] for k in own], pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["bucket", "own", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held > WORK and r[0] != rows[-1][0]:
                    yield from flush(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[3])
        if rows:
            yield from flush(rows)

    dealt = pieces.select("bucket", "own", "n", "text").repartition("bucket").sortWithinPartitions("bucket", "own")
    return dealt.mapInArrow(common.trimmed(run), "bucket long, own long, lo int, hi int")


def _cut(found: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """bucket, own, n, text, row and start of stretches (row, bucket, own, start, n), with their bytes."""
    lists = found.groupBy("row").agg(F.collect_list(F.struct("bucket", "own", "start", "n")).alias("want"))
    both = docs.select("row", "text").join(lists, "row").select("row", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                out = []
                for row, t, want in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    raw = t.encode()
                    out += [(x["bucket"], x["own"], x["n"], raw[x["start"] : x["start"] + x["n"] - 1 + width], row, x["start"]) for x in want]
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32()], strict=True)], names=["bucket", "own", "n", "text", "row", "start"])

    return both.mapInArrow(common.trimmed(run), "bucket long, own long, n int, text binary, row long, start int")


def marks(kinds: DataFrame, docs: DataFrame, width: int, level: int = 0) -> DataFrame:
    """bucket, own, lo, hi: suffixes of the stretches (bucket, own, c, row, start, n) that occur again; stored.

    kinds: the different stretches, each with one of its c places.
    """
    # a stretch that occurs more than once is repeated as a whole
    out = kinds.filter("c > 1").select("bucket", "own", F.lit(0).alias("lo"), (F.col("n") - 1).cast("int").alias("hi"))
    weights = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") + (width - 1)).alias("bytes")).filter("kinds > 1")
    weights = stored(weights.select("bucket", (F.col("bytes") > HOT).alias("hot")), "stretch-buckets")
    some = stored(kinds.join(weights, "bucket"), "stretch-kinds")
    hot = level < 2 and weights.filter("hot").limit(1).count() > 0
    dropped(weights)
    cold = some.filter("not hot") if hot else some
    out = stored(out.unionByName(sorted_buckets(_cut(cold, docs, width), width)), "stretch-marks")
    if not hot:
        dropped(some)
        return out
    texts = stored(_cut(some.filter("hot"), docs, width), "stretch-texts")
    parts = stored(split(texts, width, level + 1), "stretch-parts")
    dropped(texts)
    inner = parts.groupBy("bucket", "own").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start", "n")).alias("x")).select("bucket", "own", "c", "x.*")
    inner = stored(inner, "stretch-kinds")
    found = marks(inner, docs, width, level + 1)
    back = parts.select("bucket", "own", "shift", "pbucket", "pown").join(found, ["bucket", "own"])
    back = back.select(F.col("pbucket").alias("bucket"), F.col("pown").alias("own"), (F.col("lo") + F.col("shift")).cast("int").alias("lo"), (F.col("hi") + F.col("shift")).cast("int").alias("hi"))
    whole = stored(out.unionByName(back), "stretch-marks")
    dropped(out, parts, inner, found, some)
    return whole


def repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """row and its removed runs of suffixes (lo, hi), sorted, for rows (row long, text) with unique row."""
    all_ = stored(stretches(docs, width), "stretches")
    kinds = all_.groupBy("bucket", "own").agg(F.count(F.lit(1)).alias("c"))
    more = F.when(F.col("c") > 1, F.col("own"))
    buckets = kinds.groupBy("bucket").agg(F.sum("c").alias("c"), (F.min("own") != F.max("own")).alias("several"), F.max_by(more, F.when(F.col("c") > 1, F.col("c"))).alias("top"), F.min(more).alias("low"), F.max(more).alias("high"))
    # up to three stretches of a bucket are known here to occur again, the most frequent one among them: their places need no mark
    buckets = stored(buckets.filter("c > 1").drop("c"), "stretch-buckets")
    found = all_.join(buckets, "bucket").withColumn("known", F.expr("not several or coalesce(own in (top, low, high), false)"))
    found = stored(found.drop("top", "low", "high"), "repeated-stretches")
    dropped(all_, buckets)
    whole = found.filter("known").select("row", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).alias("hi"))
    several = found.filter("several")
    kinds = several.groupBy("bucket", "own").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start", "n")).alias("x")).select("bucket", "own", "c", "x.*")
    kinds = stored(kinds, "stretch-kinds")
    again = marks(kinds, docs, width)
    some = several.filter("not known").join(again.withColumnsRenamed({"lo": "mlo", "hi": "mhi"}), ["bucket", "own"]).select("row", (F.col("start") + F.col("mlo")).alias("lo"), (F.col("start") + F.col("mhi")).alias("hi"))
    spans = whole.unionByName(some).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("marks"))
    spans = stored(spans, "repeats")
    dropped(found, kinds, again)
    return spans


def dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, row_col: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, on request `kept` (binary), and with row_col (unique longs) `row`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    if not row_col:
        rows, _ = common.numbered(rows)
    spans = repeats(rows.filter(F.octet_length("text") >= width), width)
    both = rows.join(spans, "row", "left").select("doc_id", "text", "marks", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b, out = batch.slice(i, 256), []
                for key, t, own, row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    raw = (t or "").encode()
                    kept, at, end, removed, n = [], 0, 0, 0, 0
                    for m in own or ():
                        lo, hi = m["lo"], m["hi"] + width
                        if lo > end or n == 0:
                            kept.append(raw[end:lo])
                            n, removed, end = n + 1, removed + hi - lo, hi
                        elif hi > end:
                            removed, end = removed + hi - end, hi
                    kept.append(raw[end:])
                    rest = b"".join(kept)
                    out.append((key, len(raw), removed, n, hashlib.sha256(rest).hexdigest(), rest if keep_text else None, row))
                cols = list(zip(*out, strict=True)) or [()] * 7
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = both.mapInArrow(common.trimmed(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, row long")
    return out.drop(*([] if keep_text else ["kept"]), *([] if row_col else ["row"]))
