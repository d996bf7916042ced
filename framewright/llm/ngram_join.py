"""N-gram Jaccard join by grouped prefixes: exact, with the components of its links.

A text's set holds its distinct shingles of `k` words (A-Z lower-cased); two sets link when their
Jaccard similarity is at least 3/4. Under one global order of shingles, linked sets share a
shingle in the first n - ceil(3n/4) + 1 of both, and if K is the smaller of the two last prefix
keys, their overlap is at most the shared prefix keys plus the rest of the set whose prefix ends
at K. The order puts frequent shingles last, by classes of a count sketch over all texts (of fixed
size; a miscount costs time, never a link), then goes by hash.

1. Equal sets become one node (smallest id); nodes of equal size and prefix become one group.
2. Groups post their prefixes. Groups that share a shingle are paired with one leader of their
   size band, not with each other; frequent shingles lead by lanes, then among lane leaders.
   Pairs that share enough shingles are verified on the whole sets.
3. Components of the verified links. Then leaders are drawn anew, TURNS of them for the shingles of
   a text, and only texts of other components are paired with them; again while many pairs link.
   Families of near copies, loose ones too, so join by a few links for each text.
4. What the leaders cannot show: all pairs of groups that share a shingle, hold different
   components and pass the size, position and overlap bounds, expanded to members and verified.
   They are made in lots. First only DRAWN groups of each component, drawn by hash, are paired (all
   of a smaller one), then MORE times as many, until all are drawn: a text that links to a share of
   a large family finds it early, and is never paired with the rest. This step makes the result
   exact; the earlier ones leave it little to do.

Of the links that a task verifies it hands on those that join what it has seen (a forest), and a
pair that these join already is not verified, so links grow with the texts and not with the pairs.

Null, empty and wordless texts: the empty set, their own component. Fewer than k words: one
shingle of all. Repeated ids: each row counts by its own text; rows without an id belong to components
like others (component_id: the smallest id in it, null if it has none). Ties: the order of shingles is
total. Empty table: no rows. Other columns, whatever their names, do not matter. Very long texts: a
worker holds one block, or one longer text. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import common
from framewright.llm.common import components, dropped, released, small_batches, stored

SKETCH, SLICE = 1 << 23, 1 << 16
#: Classes of the sketch up to which a shingle has one lane (some hundred postings).
PLAIN = 6
#: Frequent prefix keys up to which a posting carries its text's list of them.
WIDE = 256
#: Leaders drawn for the shingles of a text, rounds of them at most, groups drawn of a component in the first lot, and times as many in the next.
TURNS, ROUNDS, DRAWN, MORE = 8, 6, 64, 16


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, block by block."""
    for part, buf, off in common.blocks(batches):
        prefix = common.Prefix(buf, fold=True)
        start, end, first = common.words(buf, off)
        word = prefix.of(start, end)
        yield part, [np.unique(common.shingles(word[i:j], k)) for i, j in zip(first[:-1], first[1:], strict=True)]


def count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Class of each of SKETCH buckets: 0 for common counts, then the power of two over them.

    One table of 16-bit counts for each task, summed and classed slice by slice in the executors; the
    driver gets one byte for a bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint16)
        for _, sets in _sets(batches, k):
            at, n = np.unique((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int32), return_counts=True)
            total[at] += np.minimum(n, 65535 - total[at]).astype(np.uint16)
        for i, c in enumerate(total.reshape(-1, SLICE)):
            if c.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([c.astype("<u2").tobytes()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(c.as_buffer(), "<u2").astype(np.int64)
                sums[i] = sums[i] + x if i in sums else x
        for i, x in sums.items():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([int(x.sum())], pa.int64()), pa.array([np.minimum(x, (1 << 31) - 1).astype("<i4").tobytes()], pa.binary())], names=["slice", "total", "counts"])

    with small_batches(docs.sparkSession, 2000):
        sums = stored(docs.select("text").mapInArrow(common.trimmed(count), "slice int, counts binary").repartition(16, "slice").mapInArrow(common.trimmed(add), "slice int, total long, counts binary"), "shingle-counts")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / SKETCH
    usual = mean + 6 * mean**0.5 + 6

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [(np.log2(np.maximum(np.frombuffer(c.as_buffer(), "<i4"), 1) / usual) // 1 + 1).clip(0, 30).astype(np.uint8).tobytes() for c in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(x, pa.binary())], names=["slice", "classes"])

    out = np.zeros(SKETCH, np.uint8)
    for r in sums.select("slice", "counts").mapInArrow(common.trimmed(classed), "slice int, classes binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["classes"], np.uint8)
    dropped(sums)
    return out


def signatures(docs: DataFrame, k: int, classes: np.ndarray) -> DataFrame:
    """row, doc_id, n, f1, f2 (128 bits that name the set), ph (hash of the prefix), keys (the prefix, in order); stored."""
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = held.value
        for part, sets in _sets(batches, k):
            n, f1, f2, ph, prefixes = [], [], [], [], []
            for s in sets:
                size = len(s)
                n.append(size)
                f1.append(int(common.mix(s).sum(dtype=np.uint64)) if size else 0)
                f2.append(int(common.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if size else 0)
                key = np.sort((rank[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (common.mix(s) >> np.uint64(6)))
                key = key[: size - (3 * size + 3) // 4 + 1] if size else key
                ph.append(int(common.mix(key).sum(dtype=np.uint64)) if size else 0)
                prefixes.append(key)
            off = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)))
            yield pa.record_batch([*part.columns[:2], pa.array(n, pa.int64()), long(f1), long(f2), long(ph), keys], names=["row", "doc_id", "n", "f1", "f2", "ph", "keys"])

    out = stored(docs.select("row", "doc_id", "text").mapInArrow(common.trimmed(run), "row long, doc_id long, n long, f1 long, f2 long, ph long, keys array<long>"), "jaccard-prefixes")
    held.destroy()
    return out


def _whole_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, keys (binary: sorted hashes) of the texts of some nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            yield pa.record_batch([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "keys"])

    own = docs.join(nodes.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select("row", "text")
    return own.mapInArrow(common.trimmed(run), "node long, keys binary")


def verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Of the pairs (a, b) of nodes those that link, by their whole sets; of each task's a forest. Stored."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = stored(_whole_sets(docs, nodes, k), "jaccard-sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("keys").alias("k" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = common.Forest()
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                link = False
                if not own.joined(a, b):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.searchsorted(x, y)
                    same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                    link = 100 * same >= 75 * (len(x) + len(y) - same)
                    if link:
                        own.join(a, b)
                keep.append(link)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with small_batches(docs.sparkSession):
        out = stored(both.select("a", "b", "ka", "kb").mapInArrow(common.trimmed(run), "a long, b long"), "jaccard-links")
    dropped(sets)
    return out


class Labels:
    """The component of every node, from the links given so far."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, k: int):
        self.nodes, self.docs, self.k, self.star, self.table = nodes, docs, k, None, None

    def add(self, pairs: DataFrame) -> tuple[int, int]:
        """Verify pairs (a, b) of nodes, join components; numbers of pairs and of links handed on."""
        pairs = stored(pairs, "jaccard-pairs")
        tried = pairs.count()
        links, made = None, 0
        if tried:
            links = verified(pairs, self.docs, self.k)
            made = links.count()
        dropped(pairs)
        if made or self.table is None:
            own = links if links is not None else self.nodes.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
            star = components(own if self.star is None else own.union(self.star.select("node", "root")))
            table = stored(self.nodes.select("node", "gid").join(star, "node", "left").select("node", "gid", F.coalesce("root", "node").alias("comp")), "jaccard-labels")
            dropped(self.star, self.table)
            self.star, self.table = star, table
        dropped(links)
        return tried, made

    def members(self, near: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes of different components, for pairs of groups."""
        side = lambda g, x: self.table.select(F.col("gid").alias(g), F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
        pairs = near.join(side("a", "x"), "a").join(side("b", "y"), "b").filter("cx <> cy and (a <> b or x < y)")
        return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))

    def ranges(self) -> DataFrame:
        """gid, and its smallest and largest component."""
        return self.table.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))


#: Groups a and b hold more than one component.
APART = "not (la = ua and lb = ub and la = lb)"
SIZED = "4 * least(na, nb) >= 3 * greatest(na, nb)"
PLACED = "7 * (least(pa, pb) + least(na - pa, nb - pb)) >= 3 * (na + nb)"


def _lane(turn: int) -> Column:
    """Lane of a posting: several for a frequent shingle, so that a task holds a share of its texts."""
    rank = F.shiftrightunsigned("tok", 58)
    return F.when(rank > PLAIN, F.pmod(F.xxhash64("gid", F.lit(turn)), F.expr(f"shiftleft(1, cast(least(shiftrightunsigned(tok, 58) - {PLAIN}, 16) as int))"))).otherwise(0).cast("int")


def first_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a: leader, b) by the smallest group of each lane, and of the lanes' leaders."""

    def led(posts: DataFrame, by: list[str]) -> DataFrame:
        p = posts.withColumn("lead", F.min(F.struct("gid", "n")).over(Window.partitionBy("tok", *by))).filter("lead.gid <> gid")
        return p.select(F.col("lead.gid").alias("a"), F.col("lead.n").alias("na"), F.col("gid").alias("b"), F.col("n").alias("nb"))

    tops = shared.filter(f"shiftrightunsigned(tok, 58) > {PLAIN}").groupBy("tok", "lane", "band").agg(F.min(F.struct("gid", "n")).alias("x")).select("tok", "band", "x.gid", "x.n")
    pairs = led(shared, ["lane", "band"]).union(led(tops, ["band"])).filter(SIZED)
    # a leader leads most of the shared shingles, so pairs under few of them are left to the later steps
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb")).filter("20 * c >= least(na, nb)").select("a", "b")


def drawn_pairs(shared: DataFrame, ranges: DataFrame, turn: int) -> DataFrame:
    """Pairs (a: leader, b) of different components; a text's shingles fall into TURNS parts, each with its own order of leaders.

    Of linked texts a part's shingles agree mostly, so a pair under less than about a quarter of them is left out.
    """
    p = shared.withColumn("lane", _lane(turn)).withColumn("part", F.pmod(F.xxhash64("tok", F.lit(turn)), F.lit(TURNS))).join(ranges, "gid")
    p = p.withColumn("lead", F.min(F.struct(F.xxhash64("gid", "part", F.lit(turn)).alias("o"), "gid", "n", "pos", "lo", "hi")).over(Window.partitionBy("tok", "lane", "band")))
    p = p.select(*[F.col(f"lead.{c}").alias(x) for c, x in (("gid", "a"), ("n", "na"), ("pos", "pa"), ("lo", "la"), ("hi", "ua"))], *[F.col(c).alias(x) for c, x in (("gid", "b"), ("n", "nb"), ("pos", "pb"), ("lo", "lb"), ("hi", "ub"))], "part")
    p = p.filter(f"a <> b and {APART} and {SIZED} and {PLACED}")
    p = p.groupBy("a", "b", "part").agg(F.count(F.lit(1)).alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return p.filter(f"{16 * TURNS} * c >= least(na, nb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def drawn_groups(ranges: DataFrame, last: DataFrame | None, limit: int) -> DataFrame:
    """ranges with `drawn`, for all groups of a component of at most `limit`, about so many of a larger one and those of the last lot, and `before`, for the latter. Stored."""
    large = ranges.groupBy("lo").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > limit)
    place = F.pmod(F.xxhash64("gid", F.lit(-1)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("size")
    before = ranges.withColumn("before", F.lit(False)) if last is None else ranges.join(last.select("gid", F.col("drawn").alias("before")), "gid")
    return stored(before.join(large, "lo", "left").select("gid", "lo", "hi", "before", (F.col("before") | F.coalesce(place < limit, F.lit(True))).alias("drawn")), "jaccard-drawn")


def all_pairs(shared: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every pair (a, b) of drawn groups, not both drawn before, that share a prefix shingle, hold different components and pass the bounds. Stored.

    Frequent keys would make a pair again and again: their postings carry the text's list of them, so
    a pair is made under the first common one alone, with the number of all. A list of more than WIDE
    keys is not repeated in every row; such texts are counted key by key. Groups of the component that
    has most of a key's postings do not meet each other there. The numbers of shared keys
    (m, of them h frequent) bound the overlap before anything is made.
    """
    p = shared.join(chosen.filter("drawn").drop("drawn"), "gid")
    mixed = p.groupBy("tok").agg(F.min("lo").alias("tlo"), F.max("hi").alias("thi"), F.bool_and("before").alias("done"), F.mode("lo").alias("most")).filter("tlo <> thi and not done").select("tok", "most")
    left = stored(p.join(mixed, "tok").withColumn("few", F.expr("not (lo = hi and lo = most)")).drop("most"), "jaccard-mixed")
    hot = F.shiftrightunsigned("tok", 58) > 0
    keys = left.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.count_if(hot).alias("h"), F.sort_array(F.collect_list(F.when(hot, F.col("tok")))).alias("toks"))
    keys = keys.withColumn("toks", F.when(F.size("toks").between(1, WIDE), F.col("toks")))
    whole = stored(left.join(keys, "gid").withColumn("toks", F.when(hot, F.col("toks"))), "jaccard-mixed")
    dropped(left)
    names = {"gid": "", "n": "n", "pos": "p", "end": "e", "lo": "l", "hi": "u", "toks": "t", "m": "m", "h": "h", "before": "d", "few": "f"}
    side = lambda z, tok: whole.select(F.col("tok").alias(tok), *[F.col(c).alias(v + z) for c, v in names.items()])
    prefix = lambda n: f"({n} - floor((3 * {n} + 3) / 4) + 1)"
    enough = lambda c: f"7 * ({c} + case when ea <= eb then na - {prefix('na')} else nb - {prefix('nb')} end) >= 3 * (na + nb)"
    once = f"try_element_at(array_intersect(ta, tb), 1) = tok and {enough('size(array_intersect(ta, tb)) + least(ma - ha, mb - hb)')}"
    near = side("a", "tok").filter("fa").join(side("b", "tok2"), F.expr(f"tok = tok2 and a <> b and (a < b or not fb) and not (da and db) and {SIZED} and {APART} and {PLACED} and {enough('least(ma, mb)')} and (ta is null or tb is null or ({once}))"))
    near = near.withColumn("c", F.expr("case when ta is null or tb is null then 1 else size(array_intersect(ta, tb)) end"))
    turned = [F.when(F.col("a") < F.col("b"), F.col(x + "a")).otherwise(F.col(x + "b")).alias(x + "a") for x in ("n", "e")] + [F.when(F.col("a") < F.col("b"), F.col(x + "b")).otherwise(F.col(x + "a")).alias(x + "b") for x in ("n", "e")]
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c", *turned)
    near = near.groupBy("a", "b").agg(F.sum("c").alias("c"), *[F.max(c).alias(c) for c in ("na", "nb", "ea", "eb")])
    out = stored(near.filter(enough("c")).select("a", "b"), "jaccard-near")
    dropped(whole)
    return out


def join(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; ids must be integers. With row_col (unique longs) also row and head, the smallest row of its component."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    unique = False
    if not row_col:
        docs, unique = common.numbered(docs)
    sig = signatures(docs, k, count_sketch(docs, k))
    some = sig.filter("n > 0")
    nodes = some.groupBy("n", "f1", "f2", "ph").agg(F.min("row").alias("node"))
    groups = nodes.groupBy("n", "ph").agg(F.min("node").alias("gid"), F.count(F.lit(1)).alias("members"))
    nodes = stored(nodes.join(groups, ["n", "ph"]).select("node", "gid", "n", "f1", "f2", "members"), "jaccard-nodes")
    posts = some.join(nodes.filter("node = gid").select("gid"), F.col("row") == F.col("gid"))
    posts = posts.select("gid", "n", F.element_at("keys", -1).alias("end"), F.posexplode("keys").alias("pos", "tok"))
    posts = posts.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / np.log(1.15)).cast("int")).withColumn("lane", _lane(0))
    at = Window.partitionBy("tok", "lane")
    shared = posts.withColumn("here", F.count(F.lit(1)).over(at)).filter(f"here > 1 or shiftrightunsigned(tok, 58) > {PLAIN}").drop("here")
    shared = stored(shared, "jaccard-postings")
    sizes = stored(sig.drop("keys", "ph"), "jaccard-sizes")
    dropped(sig)
    released(docs.sparkSession)
    labels = Labels(nodes, docs, k)
    inner = nodes.filter("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    labels.add(first_pairs(shared).union(inner))
    for turn in range(1, ROUNDS + 1):
        tried, made = labels.add(drawn_pairs(shared, labels.ranges(), turn))
        if 50 * made < tried or not made:
            break
    # groups of one prefix and size pair their own members too
    own = nodes.filter("members > 1 and node = gid").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    chosen, limit = None, DRAWN
    while chosen is None or chosen.filter("not drawn").limit(1).count():
        last, chosen = chosen, drawn_groups(labels.ranges(), chosen, limit)
        near = all_pairs(shared, chosen)
        labels.add(labels.members(near.union(own) if last is None else near))
        dropped(near, last)
        limit *= MORE
    dropped(shared, chosen)
    comp = nodes.select("node", "n", "f1", "f2").join(labels.table.select("node", "comp"), "node").select("n", "f1", "f2", "comp")
    out = sizes.join(comp, ["n", "f1", "f2"], "left")
    if unique:
        out = out.withColumn("component_id", F.coalesce("comp", "doc_id"))
    else:  # nodes are numbers of rows then
        least = out.groupBy("comp").agg(F.min("doc_id").alias("least")).filter("comp is not null")
        out = out.join(least, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    more = [F.col("row"), F.coalesce("comp", "row").alias("head")] if row_col else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
