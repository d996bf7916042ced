"""Quality classifier by co-training of two views.

The content view sees the text alone: style measures (shares and means, no length) and the strongest
word evidence, in quantile bins. The metadata view sees source, language and length. Both are
logistic regressions, trained on a bounded sample of labelled rows (SAMPLE, drawn by a hash of the
id). In each of ROUNDS rounds both views score every unlabelled row in the executors, and a view
hands the HANDED rows of each class of which it is surest (calibrated to at least SURE; found by
ranks in tasks, then over all) to the other as labels. Word evidence of a training row comes from other
rows (cross-fitted). At the end each view is calibrated on a labelled fold that trained neither, and a small regression on the two calibrated logits gives p_quality. Every
document is scored; `keep` is p_quality >= 0.5.

The sample's word evidence is fitted in one executor task; the driver fits two regressions on the
sample's bins (some 30 bytes a row) and sees at most 4 * HANDED rows of the corpus a round.

A document is good when its quality label is 1 and its toxic label is 0 (a null label counts as
missing; of several labels for an id the worst holds).

Null or empty text: style measures of no words. Null metadata: a category of its own. Null ids: never
labelled. Very long texts: a worker holds one block, or one longer text. Repeated rows and rows whose
views agree are one row of the exchange, and each is scored. Ties in confidence go by a hash
of the views. Empty table: no rows. If the sample lacks one of the classes, all get the share of
good ones (1 without labels). Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewright.llm import common
from framewright.llm.common import dropped, stored

#: Labelled rows at most, rounds, rows handed over a round and class, calibrated confidence.
SAMPLE, ROUNDS, HANDED, SURE = 16000, 4, 200, 0.98
WORDS_BITS, BINS, META = 18, 24, 1024
STYLE, FIELDS = 8, 4
SCORES = ("p_content", "p_meta", "p_quality", "keep")


def style(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Style measures of each text; hashes of the block's letter runs, index of each text's first one."""
    n = len(off) - 1
    start, end, first = common.words(buf, off)
    prefix = common.Prefix(buf, fold=True)
    h = prefix.of(start, end)
    size = np.diff(off).astype(float)
    count = np.diff(first).astype(float)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off[1:]] - c[off[:-1]]) / np.maximum(of, 1)

    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    mark = (buf > 32) & (buf < 127) & ~upper & ~lower & ~((buf >= 48) & (buf <= 57))
    plain = (buf == 46) | (buf == 44)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = False
    c = np.concatenate([[0], np.cumsum(again)])
    last = buf[end - 1] if len(end) else np.zeros(0, np.uint8)
    odd = np.concatenate([[0], np.cumsum((last > 32) & (last < 48) & (last != 46) & (last != 44))])
    distinct = np.array([len(np.unique(h[i:j])) for i, j in zip(first[:-1], first[1:], strict=True)], float)
    out = np.empty((n, STYLE))
    out[:, 0] = share(mark & ~plain, size)
    out[:, 1] = share(upper, share(upper | lower, np.ones(n)))
    out[:, 2] = (c[first[1:]] - c[first[:-1]]) / np.maximum(count, 1)
    out[:, 3] = distinct / np.maximum(count, 1)
    out[:, 4] = size / np.maximum(count, 1)
    out[:, 5] = share((buf >= 48) & (buf <= 57), size)
    out[:, 6] = (odd[first[1:]] - odd[first[:-1]]) / np.maximum(count, 1)
    out[:, 7] = share(plain, count)
    # letters, including all bytes of other scripts; punctuation at a word is no evidence
    letter = np.concatenate([[0], ((buf | 32) >= 97) & ((buf | 32) <= 122) | (buf >= 128), [0]]).astype(np.int8)
    letter[1:-1][off[:-1][size > 0]] *= 2  # a text's first byte begins a run
    start = np.flatnonzero((letter[1:-1] > 0) & ((letter[:-2] == 0) | (letter[1:-1] == 2)))
    end = np.flatnonzero((letter[1:-1] > 0) & ((letter[2:] == 0) | (letter[2:] == 2))) + 1
    return out, prefix.of(start, end), np.searchsorted(start, off)


def metadata(source: list, lang: list, size: np.ndarray) -> np.ndarray:
    """Four hashed categories for each row."""
    out = np.empty((len(source), FIELDS), np.int64)
    for i, (s, g, z) in enumerate(zip(source, lang, np.log2(np.maximum(size, 1)).astype(int), strict=True)):
        out[i] = [zlib.crc32(f"{k}={v}".encode()) % META for k, v in (("s", s), ("g", g), ("z", z), ("gz", (g, int(z))))]
    return out


def fit(rows: np.ndarray, y: np.ndarray, size: int, weight: np.ndarray, steps: int = 400, decay: float = 2e-4) -> np.ndarray:
    """Logistic regression on rows of category numbers (the bias last), by Adam."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    weight = weight / weight.sum()
    flat = rows.ravel()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(w[rows].sum(1) + w[-1])))
        d = (p - y) * weight
        g = np.bincount(flat, np.repeat(d, rows.shape[1]), size + 1)
        g[-1] = d.sum()
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and shift of the logits, by Newton steps with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, x = np.array([1.0, 0.0]), np.stack([np.clip(z, -20, 20), np.ones(len(z))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * np.array([w[0], 0]))
        w -= np.clip(step, -1, 1)
    return max(0.0, float(w[0])), float(w[1])


@dataclass
class Model:
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((2, 1 << WORDS_BITS), np.float32))
    edges: np.ndarray | None = None
    content: np.ndarray | None = None
    meta: np.ndarray | None = None
    scale: tuple = ((1.0, 0.0), (1.0, 0.0))
    mixed: np.ndarray | None = None
    share: float = 1.0

    def lexical(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each text's words the strongest log odds, their mean, and the strongest deviation."""
        at = (words & np.uint64((1 << WORDS_BITS) - 1)).astype(np.int64)
        some, begin = first[1:] > first[:-1], np.minimum(first[:-1], len(at))
        e = [np.append(t[at], np.float32(0)).astype(float) for t in self.evidence]
        top = [np.where(some, np.maximum.reduceat(x, begin), 0) for x in e]
        c = np.concatenate([[0], np.cumsum(e[0])])
        return np.stack([top[0], (c[first[1:]] - c[first[:-1]]) / np.maximum(first[1:] - first[:-1], 1), top[1]], 1)

    def binned(self, dense: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], dense[:, j], "right") + j * BINS for j in range(dense.shape[1])], 1)

    def logits(self, content: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        """Of both views, calibrated."""
        z = [w[x].sum(1) + w[-1] for w, x in ((self.content, content), (self.meta, meta))]
        return [a * np.clip(x, -20, 20) + b for x, (a, b) in zip(z, self.scale, strict=True)]

    def scores(self, dense: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.content is None:
            x = np.full(len(dense), self.share)
            return x, x, x
        z = np.stack(self.logits(self.binned(dense), meta), 1)
        return *(1 / (1 + np.exp(-z.T))), 1 / (1 + np.exp(-(z @ self.mixed[:2] + self.mixed[2])))


@dataclass
class Sample:
    """Labelled rows as bins and categories, with their fold: the last one calibrates, the others train."""

    content: np.ndarray
    meta: np.ndarray
    y: np.ndarray
    fold: np.ndarray


def prepared(dense: np.ndarray, words: list[np.ndarray], meta: np.ndarray, y: np.ndarray) -> tuple[Model, Sample | None]:
    """Word evidence and bins from labelled rows (y 0 or 1; words: distinct hash buckets of each row)."""
    model = Model(share=float(y.mean()) if len(y) else 1.0)
    if min((y == 0).sum(), (y == 1).sum()) < 10:
        return model, None
    # three folds train, each by the word evidence of the other two; the fourth calibrates, by that of all three
    fold = np.zeros(len(y), int)
    for v in (0, 1):
        own = np.flatnonzero(y == v)
        fold[own] = np.arange(len(own)) % 4
    count = np.zeros((3, 2, 1 << WORDS_BITS))
    for i in np.flatnonzero(fold < 3):
        count[fold[i], y[i], words[i]] += 1
    base = 1 - model.share

    def evidence(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        rate = (bad + 5 * base) / (bad + good + 5)
        deviation = (bad - (bad + good) * base) / np.sqrt((bad + good) * base * (1 - base) + 1)
        return np.stack([np.log(rate / (1 - rate)) - np.log(base / (1 - base)), deviation]).astype(np.float32)

    told = np.zeros((len(y), 3))
    for f in range(4):
        model.evidence = evidence(*count[[k for k in range(3) if k != f]].sum(0))
        rows = np.flatnonzero(fold == f)
        for at in range(0, len(rows), 500):
            p = [words[i] for i in rows[at : at + 500]]
            told[rows[at : at + 500]] = model.lexical(np.concatenate(p).astype(np.uint64), np.cumsum([0, *map(len, p)]))
    dense = np.hstack([dense, told])  # the evidence of all three folds stays in the model
    model.edges = np.quantile(dense[fold < 3], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    return model, Sample(model.binned(dense), meta, y, fold)


#: For a model and the rows already given to each view: view that is sure, label, and the views of the rows it is surest of.
Surest = Callable[[Model, list[set]], list[tuple[int, int, bytes, bytes]]]


def surest_of(content: np.ndarray, meta: np.ndarray, model: Model, given: list[set], handed: int, sure: float) -> list[tuple[int, int, float, int]]:
    """view, label, confidence and number of the rows of which each view is surest, those given to the other view left out."""
    out = []
    names = [(c.tobytes(), m.tobytes()) for c, m in zip(content.astype("<i2"), meta.astype("<i2"), strict=True)]
    for view, z in enumerate(model.logits(content, meta)):
        fresh = np.array([n not in given[1 - view] for n in names], bool)
        for label, p in ((1, 1 / (1 + np.exp(-z))), (0, 1 / (1 + np.exp(z)))):
            at = np.flatnonzero((p >= sure) & fresh)
            if len(at) > 4 * handed:
                at = at[p[at] >= np.partition(p[at], len(at) - handed)[len(at) - handed]]
            out += [(view, label, float(p[i]), int(i)) for i in at]
    return out


def cotrain(model: Model, sample: Sample | None, surest: Surest, rounds: int = ROUNDS) -> Model:
    """Train both views, exchanging what `surest` finds among the unlabelled rows."""
    if sample is None:
        return model
    train, held, y = np.flatnonzero(sample.fold < 3), np.flatnonzero(sample.fold == 3), sample.y
    own, sizes = [sample.content, sample.meta], [BINS * sample.content.shape[1], META]
    extra: list[dict[tuple[bytes, bytes], int]] = [{}, {}]
    for turn in range(rounds + 1):
        fitted = []
        for k in (0, 1):
            rows = np.vstack([own[k][train], *(np.frombuffer(x[k], "<i2").astype(np.int64)[None] for x in extra[k])])
            target = np.concatenate([y[train], np.fromiter(extra[k].values(), float, len(extra[k]))])
            fitted.append(fit(rows, target, sizes[k], np.concatenate([np.ones(len(train)), np.full(len(extra[k]), 0.5)])))
        model.content, model.meta = fitted
        model.scale = ((1.0, 0.0), (1.0, 0.0))
        z = [w[x[held]].sum(1) + w[-1] for w, x in zip(fitted, own, strict=True)]
        model.scale = tuple(platt(x, y[held]) for x in z)
        if turn < rounds:
            for view, label, content, meta in surest(model, [set(x) for x in extra]):
                extra[1 - view][content, meta] = label
    z = np.stack(model.logits(own[0][held], own[1][held]), 1)
    x, w = np.hstack([z, np.ones((len(held), 1))]), np.array([1.0, 0.0, 0.0])
    prior = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (p - y[held]) + (w - prior)), -1, 1)
    model.mixed = w
    return model


def _viewed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("string").alias(c) for c in ("source", "lang")])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """good, style measures, hash buckets and metadata of sampled rows (text, source, lang, good)."""
    for part, buf, off in common.blocks(batches):
        dense, h, first = style(buf, off)
        meta = metadata(part.column("source").to_pylist(), part.column("lang").to_pylist(), np.diff(off))
        buckets = [np.unique(h[i:j] & np.uint64((1 << WORDS_BITS) - 1)).astype("<u4").tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
        yield pa.record_batch([part.column("key"), part.column("good"), pa.array([x.tobytes() for x in dense], pa.binary()), pa.array(buckets, pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], names=["key", "good", "dense", "words", "meta"])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prepared() over the sample's features, as one row."""
    got = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[3]))
    if not got:
        return
    y = np.array([r[1] for r in got])
    model, sample = prepared(np.stack([np.frombuffer(r[2]) for r in got]), [np.frombuffer(r[3], "<u4") for r in got], np.stack([np.frombuffer(r[4], np.int64) for r in got]), y)
    cells = [b""] * 6 if sample is None else [x.tobytes() for x in (model.evidence, model.edges, sample.content.astype("<i2"), sample.meta.astype("<i2"), y.astype("<i2"), sample.fold.astype("<i2"))]
    yield pa.record_batch([pa.array([model.share]), *(pa.array([c], pa.binary()) for c in cells)], names=["share", "evidence", "edges", "content", "meta", "y", "fold"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and whether it is good, for documents with a label."""
    good = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.coalesce("quality", F.lit(1)) == 1).cast("int") * (F.coalesce("toxic", F.lit(0)) == 0).cast("int")).alias("good"))
    return good.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, handed: int = HANDED, sure: float = SURE) -> Model:
    """Fit on at most `sample` labelled documents and an exchange over all others."""
    spark = docs.sparkSession
    good = stored(labelled(docs, labels), "labelled")
    drawn = good.withColumn("key", F.xxhash64("doc_id", F.lit("cotrain"))).orderBy("key", "doc_id").limit(sample)
    rows = _viewed(docs).join(F.broadcast(drawn), "doc_id").select("text", "source", "lang", "good", "key")  # `sample` rows at most
    got = rows.mapInArrow(common.trimmed(_features), "key long, good int, dense binary, words binary, meta binary").repartition(1)
    got = got.mapInArrow(common.trimmed(_prepare), "share double, evidence binary, edges binary, content binary, meta binary, y binary, fold binary").first()
    model = Model(share=got["share"] if got else 1.0)
    if not got or not got["evidence"]:
        dropped(good)
        return model
    at = lambda c, kind, *shape: np.frombuffer(got[c], kind).reshape(*shape)
    model.evidence, model.edges = at("evidence", np.float32, 2, -1), at("edges", np.float64, STYLE + 3, -1)
    own = Sample(*(at(c, "<i2", -1, w).astype(np.int64) for c, w in (("content", STYLE + 3), ("meta", FIELDS))), *(at(c, "<i2", -1).astype(np.int64) for c in ("y", "fold")))
    pool = stored(_pool(docs, good, model), "cotrain-pool")

    def surest(model: Model, given: list[set]) -> list[tuple[int, int, bytes, bytes]]:
        small = Model(content=model.content, meta=model.meta, scale=model.scale, evidence=None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                if b.num_rows:
                    content, meta = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<i2").reshape(b.num_rows, -1).astype(np.int64) for i in (0, 1))
                    found = surest_of(content, meta, small, given, handed, sure)
                cols = list(zip(*found, strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), *(b.column(i).take(pa.array(cols[3], pa.int64())) for i in (0, 1))], names=["view", "label", "p", "content", "meta"])

        best = Window.partitionBy("view", "label").orderBy(F.desc("p"), F.xxhash64("content", "meta"))
        top = pool.mapInArrow(common.trimmed(run), "view int, label int, p double, content binary, meta binary").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= handed)
        return [(r["view"], r["label"], bytes(r["content"]), bytes(r["meta"])) for r in top.orderBy("view", "label", "rank").collect()]  # 4 * handed rows at most

    out = cotrain(model, own, surest, rounds)
    dropped(pool, good)
    return out


def _pool(docs: DataFrame, good: DataFrame, model: Model) -> DataFrame:
    """The distinct views (content, meta: 16-bit numbers) of all rows without a label."""
    held = docs.sparkSession.sparkContext.broadcast((model.evidence, model.edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(evidence=held.value[0], edges=held.value[1])
        for part, buf, off in common.blocks(batches):
            dense, h, first = style(buf, off)
            content = m.binned(np.hstack([dense, m.lexical(h, first)])).astype("<i2")
            meta = metadata(part.column("source").to_pylist(), part.column("lang").to_pylist(), np.diff(off)).astype("<i2")
            yield pa.record_batch([part.column("doc_id"), *(pa.array([x.tobytes() for x in v], pa.binary()) for v in (content, meta))], names=["doc_id", "content", "meta"])

    views = _viewed(docs).mapInArrow(common.trimmed(run), "doc_id long, content binary, meta binary")
    # rows without an id have no label; they stay out of the join, where they would be one key
    return views.filter("doc_id is not null").join(good, "doc_id", "left_anti").unionByName(views.filter("doc_id is null")).select("content", "meta").distinct()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with p_content, p_meta, p_quality and keep, for every row."""
    docs = docs.drop(*SCORES)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part, buf, off in common.blocks(batches):
            dense, h, first = style(buf, off)
            meta = metadata(*(part.column(c).cast(pa.string()).to_pylist() for c in ("source", "lang")), np.diff(off))
            a, b, p = m.scores(np.hstack([dense, m.lexical(h, first)]), meta)
            yield pa.record_batch([*part.columns, pa.array(a), pa.array(b), pa.array(p), pa.array(p >= 0.5)], names=[*names, *SCORES])

    kind = StructType([*docs.schema.fields]).add("p_content", "double").add("p_meta", "double").add("p_quality", "double").add("keep", "boolean")
    return docs.mapInArrow(common.trimmed(run), kind)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
