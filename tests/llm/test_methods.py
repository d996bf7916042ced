"""The methods themselves: against plain versions, on held-out rows, and by what they look at."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewright.llm import common, cotrain, mih, mixing, packing, queries, sharding, ts_media, url_filter

SF = "/root/testdata/sf0.1"


# ---- transport streams


def _packets(data: bytes) -> list[bytes]:
    return [data[i : i + 188] for i in range(0, len(data), 188)]


def test_a_packet_sent_twice_counts_once():
    payload = ts_media.padded(b"x1" * 4000)
    p = _packets(ts_media.mux(payload))
    s = ts_media.demux(b"".join([*p[:5], p[4], *p[5:]]))
    assert (s.payload, s.gaps, s.damaged) == (payload, 0, 0)
    s = ts_media.demux(b"".join([*p[:5], p[4], p[4], *p[5:]]))
    assert s.gaps > 0  # a third time is no repetition


def test_units_without_a_length():
    payload = ts_media.padded(b"open" * 3000)
    out = bytearray()
    for p in _packets(ts_media.mux(payload)):
        at = p.find(b"\x00\x00\x01\xbd") if p[1] & 0x40 and p[1] & 0x1F else -1
        out += p if at < 0 else p[: at + 4] + b"\x00\x00" + p[at + 6 :]
    s = ts_media.demux(bytes(out))
    assert (s.payload, s.damaged) == (payload, 0) and len(s.stamps) == -(-len(payload) // 3072)


def test_a_gap_cuts_its_unit_alone():
    payload = ts_media.padded(bytes(range(256)) * 40)
    p = _packets(ts_media.mux(payload))
    s = ts_media.demux(b"".join(p[:6] + p[7:]))
    unit = ts_media.UNIT * ts_media.UNITS
    assert (s.gaps, s.damaged) == (1, 1) and payload.startswith(s.payload[:300]) and s.payload.endswith(payload[unit:])
    marked = bytearray(p[2])
    marked[5] |= 0x80  # the discontinuity mark
    assert ts_media.demux(b"".join([p[0], p[1], p[3], *p[2:3]])).gaps == 1
    assert ts_media.demux(b"".join([p[0], p[1], *p[2:20], bytes(marked)])).gaps == 0


def test_sections_over_several_packets():
    names = b"".join(n.to_bytes(2, "big") + (0xE000 | 0x200 + n).to_bytes(2, "big") for n in range(2, 90))
    long = ts_media._section(0, 1, (1).to_bytes(2, "big") + (0xE000 | ts_media.PMT_PID).to_bytes(2, "big") + names)
    other, packets = ts_media._section(0x42, 9, b"abc"), []
    body = b"\x00" + long
    packets.append(b"\x47\x40\x00\x10" + body[:184])
    rest = body[184:]
    packets.append(b"\x47\x00\x00\x11" + rest[:184])
    rest = rest[184:]
    packets.append((b"\x47\x40\x00\x12" + bytes([len(rest)]) + rest + other).ljust(188, b"\xff") if rest else b"")
    stream = b"".join(packets) + ts_media.mux(ts_media.padded(b"a"))[188:]
    s = ts_media.demux(stream)
    assert s.programs[1] == ts_media.PMT_PID and len(s.programs) == 89 and s.payload == ts_media.padded(b"a")


# ---- URLs


def test_url_model_on_names_that_it_has_not_seen():
    """A fifth of the names at a time is left out of training."""
    table, hit, wrong, bad, good = url_filter.labelled(), 0, 0, 0, 0
    for fold in range(5):
        held = {n for n in url_filter._BLOCKED + url_filter._ALLOWED if sum(map(ord, n)) % 5 == fold}
        w = url_filter.train([(u, y) for u, y in table if not any(f"//{n}." in u for n in held)])
        for n in held:
            g = url_filter.grams(f"{n}.net", "/x")
            block = w[g].sum() / np.sqrt(len(g)) + w[-1] >= 0
            if n in url_filter._BLOCKED:
                hit, bad = hit + block, bad + 1
            else:
                wrong, good = wrong + block, good + 1
    assert hit >= 0.35 * bad and wrong <= 0.03 * good


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", "check_s"])
def test_no_host_of_a_table_trains_the_url_model(sf):
    hosts = {url_filter.parts(u)[0] for u in pq.read_table(f"/root/testdata/{sf}/pages.parquet", columns=["url"])["url"].to_pylist()}
    names = {label for h in hosts for label in h.split(".")} - {"example", "com", "org", "net"}
    assert not names & {label for u, _ in url_filter.labelled() for label in url_filter.parts(u)[0].split(".")[:-1]}


# ---- co-training


def _pages(seed: int, n: int, labelled: int) -> tuple[list, list]:
    """Pages whose text and source both tell the class, each alone not always."""
    rng, rows, labels = np.random.default_rng(seed), [], []
    for i in range(n):
        good = i % 2
        words = rng.choice(["river", "stone", "garden"] if good else ["buy", "cheap", "win"], 20) if rng.random() < 0.8 else rng.choice(["the", "and", "of"], 20)
        source = f"{'a' if good else 'z'}{rng.integers(3)}" if rng.random() < 0.9 else "any"
        rows.append((i, " ".join(words), "en", source))
        if i < labelled:
            labels.append((i, good, 0))
    return rows, labels


def test_exchange_equals_a_plain_version_and_changes_the_views(spark):
    rows, labels = _pages(3, 1500, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, alone = cotrain.train(docs, known, handed=40, sure=0.8), cotrain.train(docs, known, rounds=0)
    assert np.abs(got.content - alone.content).max() > 1e-3 and np.abs(got.meta - alone.meta).max() > 1e-3
    # the same rounds over one array of all unlabelled rows
    pool = sorted({(bytes(r["content"]), bytes(r["meta"])) for r in cotrain._pool(docs, cotrain.labelled(docs, known), alone).collect()})
    content, meta = (np.stack([np.frombuffer(p[k], "<i2") for p in pool]).astype(np.int64) for k in (0, 1))
    order = {p: h for p, h in spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pool], "content binary, meta binary").select(F.struct("content", "meta"), F.xxhash64("content", "meta")).rdd.map(lambda r: ((bytes(r[0][0]), bytes(r[0][1])), r[1])).collect()}
    handed = []

    def surest(model, given):
        out = []
        for view, z in enumerate(model.logits(content, meta)):
            for label, p in ((1, 1 / (1 + np.exp(-z))), (0, 1 / (1 + np.exp(z)))):
                fresh = [i for i in range(len(pool)) if p[i] >= 0.8 and pool[i] not in given[1 - view]]
                out += [(view, label, *pool[i]) for i in sorted(fresh, key=lambda i: (-p[i], order[pool[i]]))[:40]]
        handed.append(len(out))
        return sorted(out, key=lambda x: x[:2])

    start, sample = _prepared(docs, known)
    plain = cotrain.cotrain(start, sample, surest)
    assert sum(handed) > 40 and np.allclose(plain.content, got.content) and np.allclose(plain.meta, got.meta) and np.allclose(plain.mixed, got.mixed)


def _prepared(docs, labels):
    good = cotrain.labelled(docs, labels).withColumn("key", F.xxhash64("doc_id", F.lit("cotrain")))
    rows = cotrain._viewed(docs).join(good, "doc_id").select("text", "source", "lang", "good", "key")
    got = sorted(map(tuple, rows.mapInArrow(cotrain._features, "key long, good int, dense binary, words binary, meta binary").collect()), key=lambda r: (r[0], bytes(r[3])))
    return cotrain.prepared(np.stack([np.frombuffer(r[2]) for r in got]), [np.frombuffer(r[3], "<u4") for r in got], np.stack([np.frombuffer(r[4], np.int64) for r in got]), np.array([r[1] for r in got]))


def test_held_out_labels(spark):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    part = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5))
    model = cotrain.train(docs, labels.filter(part != 0))
    out = cotrain.score(docs, model).join(labels.filter(part == 0), "doc_id").select("keep", "quality", "toxic").toPandas()
    good = (out.quality == 1) & (out.toxic == 0)
    assert len(out) > 500 and out.keep[good].mean() >= 0.97 and (~out.keep[~good]).mean() >= 0.9


# ---- sharding


def test_best_fit_decreasing_in_bulk_equals_one_by_one():
    rng = np.random.default_rng(8)
    for _ in range(40):
        sizes = Counter(rng.integers(1, 60, 150).tolist())
        capacity = int(rng.integers(60, 200))
        slots, bins = sharding.best_fit_decreasing([(s, n, s) for s, n in sorted(sizes.items(), reverse=True)], capacity)
        rooms: list[int] = []
        for s in sorted(sizes.elements(), reverse=True):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits)[1]] -= s
            else:
                rooms.append(capacity - s)
        got = [capacity] * bins
        for s, a, b, k in slots:
            got[k] -= (b - a) * s
        assert sorted(got) == sorted(rooms)


def test_capacity_tree_stays_balanced():
    rng, tree, plain = np.random.default_rng(9), sharding.CapacityTree(), []
    for i in range(3000):
        if plain and rng.random() < 0.4:
            size = int(rng.integers(0, 1000))
            want = min((x for x in plain if x[0] >= size), default=None)
            assert tree.take(size) == want
            if want:
                plain.remove(want)
        else:
            plain.append((int(rng.integers(0, 1000)), i))
            tree.insert(*plain[-1])
    assert list(tree) == sorted(plain) and tree.top[3] <= 1.45 * np.log2(len(plain) + 2)


# ---- mixing


def test_repeated_rows_at_the_cut(spark):
    rows = [(7, "same words here", "s")] * 400 + [(None, "no id", "s")] * 300 + [(i, f"w{i} " * (i % 9 + 1), "t") for i in range(200)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()


# ---- nearest neighbours


def _recall(spark, x: np.ndarray, every: int) -> tuple[float, float]:
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = mih.search(df, 20, every, probes=True).toPandas()
    y, hit, total = x.astype(np.float32).astype(float), 0, 0
    for q, g in out.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        hit, total = hit + len(set(g.vec_id) & set(np.argsort(-s)[:20].tolist())), total + 20
    looked = out.groupby("query_id").probed.max().mean()
    return hit / total, looked


def test_near_neighbours_are_found_in_few_rows(spark):
    """100,000 vectors around 500 centres."""
    rng = np.random.default_rng(12)
    x = (rng.standard_normal((500, 64))[rng.integers(0, 500, 100_000)] + 0.15 * rng.standard_normal((100_000, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    recall, looked = _recall(spark, x, 500)
    blocks = max(1, min(spark.sparkContext.defaultParallelism, 100_000 // 4096))
    assert recall >= 0.9 and looked <= 0.15 * 100_000 / blocks, (recall, looked)


def test_ties_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(mih, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(13)
    base = rng.standard_normal((40, 16))
    x = np.vstack([base] * 10)
    df = spark.createDataFrame([(i, v.tolist(), "q", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, query_id string, v int")
    for q, g in mih.search(df, 9, 40).toPandas().groupby("query_id"):
        assert g.sort_values("rank").vec_id.tolist() == [i for i in range(0, 400, 40) if i != q]


def test_new_words_encoded_as_one_text():
    """Words of a batch in few calls of the tokenizer, with the ids that it gives them in their texts."""
    from array import array

    cache = packing.WordCache(queries.vocabulary())
    texts = ["one two  three\n four's 5 six7 über straße 中文 กำ x́y café ẞ ʰa Ⅰ", " a b", "", " ǅ \U00010400 々 ᛮ ⱼ"]
    want = [array("I", cache.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert cache.ids(texts) == want

    class Counted:
        def __init__(self, own):
            self.own, self.calls = own, []

        def encode(self, text, **how):
            self.calls.append(1)
            return self.own.encode(text, **how)

        def encode_batch_fast(self, words, **how):
            self.calls += words
            return self.own.encode_batch_fast(words, **how)

    cache.tokenizer = Counted(cache.tokenizer)
    many = " " + " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(5000))
    assert cache.ids([many]) == [array("I", cache.tokenizer.own.encode(many, add_special_tokens=False).ids).tobytes()]
    assert len(cache.tokenizer.calls) == 1
    # words that meet as an added token are encoded each on its own
    cache.added, cache.tokenizer.calls = (lambda t: " morn even" in t), []
    cache._learn([" morn", " even"])
    assert cache.tokenizer.calls == [" morn", " even"]
