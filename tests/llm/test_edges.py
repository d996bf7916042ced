"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import numpy as np
import pytest

from framewright.llm import chain_dedup, cotrain, mih, mixing, ngram_join, packing, queries, sharding, suffix_dedup, ts_media, url_filter
from tests.llm.test_contracts import brute_components, brute_removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, n int, bucket string"


def _text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in rng.integers(2, 8, n))


LONG = _text(1, 30000)
BASE = _text(2, 200)
NEAR = " ".join(w if i != 90 else "changed" for i, w in enumerate(BASE.split(" ")))
RAW = [
    (1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, BASE), (6, BASE), (7, NEAR), (8, "a" * 1000), (9, "short one"), (10, "Short ONE"),
    (11, "é" * 300), (12, _text(3, 80) + " " + BASE[:600] + " " + _text(4, 80)), (12, BASE), (12, BASE), (None, "no id " + _text(5, 60)), (13, None), (-1, _text(6, 60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en" if (k or 0) % 2 else None, None if (k or 0) % 3 == 0 else f"s{(k or 0) % 3}", None, 1, "x", 2, "b") for k, t in RAW], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media(docs, empty):
    out = ts_media.media_features(ts_media.media_columns(docs)).collect()
    assert len(out) == len(RAW) and all(r["gaps"] == r["damaged"] == 0 for r in out)
    want = sorted(hashlib.sha256(ts_media.padded((t or "").encode())).hexdigest() for _, t in RAW)
    assert sorted(r["payload_sha256"] for r in out) == want
    assert ts_media.media_features(ts_media.media_columns(empty)).count() == 0


def test_media_damage():
    data = ts_media.mux(ts_media.padded(b"x" * 9000))
    s = ts_media.demux(data)
    assert s.payload == ts_media.padded(b"x" * 9000) and s.programs == {1: 0x100} and s.streams == {0x101: 6} and s.access[0] == (0, 2)
    lost = ts_media.demux(data[: 188 * 5] + data[188 * 6 :])
    assert lost.gaps == 1 and lost.damaged == 1
    assert ts_media.demux(b"").packets == 0 and ts_media.demux(b"\x00" * 376).damaged == 2


def test_packing(docs, empty):
    out = packing.pack_documents(docs, queries.vocabulary(), 256).toPandas()
    assert out.length.max() <= 256 and out.groupby("sequence_id").length.sum().max() <= 256
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()
    assert (out[out.doc_id.isin([1, 2, 13])].length == 1).all()
    assert packing.pack_documents(empty, queries.vocabulary()).count() == 0


def test_plan_is_complete():
    rng = np.random.default_rng(0)
    for _ in range(30):
        h = {int(x): int(c) for x, c in zip(rng.integers(1, 65, 20), rng.integers(1, 50, 20), strict=True)}
        slots, used = packing.plan(h, 64), {}
        for x, a, b, s, o in slots:
            for k in range(b - a):
                used.setdefault(s + k, []).append((o, x))
        assert {x: sum(b - a for y, a, b, _, _ in slots if y == x) for x in h} == h
        for places in used.values():
            at = 0
            for o, x in sorted(places):
                assert o == at
                at += x
            assert at <= 64


def test_cotraining(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = cotrain.classify(docs, labels).collect()
    assert len(out) == len(RAW) and all(0 <= r["p_quality"] <= 1 for r in out)
    assert cotrain.classify(empty, labels).count() == 0


def test_url_filter(spark):
    urls = [None, "", "example.net/en/", "http://EXAMPLE.net/en/x?y#z", "http://a.example.com/de/", "https://example.net?x=/en/", "ftp://x.org#/fr/", "http://x.org/fr/1", "http://notexample.com/de/", "a://b://c.net/", "https://free-casino-bets.com/" + "x" * 5000]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert [out[i]["rule"] for i in range(11)] == [None, None, None, "example.net/en/", "example.com/de/", None, None, "org/fr/", None, None, None]
    assert (out[5]["host"], out[5]["path"]) == ("example.net", "") and (out[0]["host"], out[0]["verdict"]) == ("", "allow")
    assert (out[9]["host"], out[9]["path"]) == ("b:", "//c.net/") and out[10]["verdict"] == "block"
    for i, u in enumerate(urls):
        assert (out[i]["host"], out[i]["path"]) == url_filter.parts(u)


def test_suffix_dedup(docs, empty):
    texts = [(t or "").encode() for _, t in RAW]
    want = sorted((len(t), int(m.sum()), hashlib.sha256(bytes(b for b, x in zip(t, m, strict=True) if not x)).hexdigest()) for t, m in zip(texts, brute_removed(texts, 200), strict=True))
    out = suffix_dedup.dedup(docs, 200).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in out) == want
    assert suffix_dedup.dedup(empty, 200).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[200:600]
    text[2000:2300] = 97
    b = suffix_dedup.Block(text, 200)
    s = b.order(np.arange(len(text) - 300))
    raw = text.tobytes() + b"\0" * 400
    keys = [raw[i : i + 256] for i in s]
    assert keys == sorted(keys)


def test_chained_passages(docs, empty):
    out = chain_dedup.passages(docs).collect()
    parent = {k: k for k in (5, 6, 7, 12)}
    for r in out:  # every copy is tied to another one
        a, b = r["doc_id"], r["partner_id"]
        parent = {k: min(parent[a], parent[b]) if v in (parent[a], parent[b]) else v for k, v in parent.items()}
    assert set(parent.values()) == {5} and all(r["similarity"] >= 0.75 and r["n_words"] >= 50 for r in out)
    assert any(r["doc_id"] == 12 and r["start"] == 80 for r in out) or any(r["partner_id"] == 12 and r["partner_start"] == 80 for r in out)
    assert chain_dedup.passages(empty).count() == 0


def test_chain_scores():
    x = np.array([0, 5, 10, 15, 40]), np.array([100, 105, 3, 115, 140])
    assert chain_dedup.chains(*x)[0] == (0, 45, 100, 145, 4)
    a = np.array([1, 2, 3, 4, 5, 6], np.uint32)
    assert chain_dedup.common_words(a, np.array([1, 9, 3, 4, 6], np.uint32)) == 4


def test_sharding(docs, empty):
    out = sharding.shard(docs, 4).toPandas()
    assert len(out) == len(RAW)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_splits_only_what_cannot_fit(spark):
    df = spark.createDataFrame([(i, "same text " * 5) for i in range(400)] + [(1000 + i, _text(i, 8)) for i in range(200)], "doc_id long, text string")
    out = sharding.shard(df, 8).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 0.1 * sizes.mean()


def test_mixing(docs, empty):
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(RAW) and (out.taken <= 2 * out["size"]).all()
    assert mixing.mix(empty).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(400, None), (420, []), (440, [0.0] * 8), (460, [nan] + [1.0] * 7), (480, [inf] + [1.0] * 7), (500, [None] + [1.0] * 7), (520, [1.0] * 3), (540, rows0 := [float(a) for a in x[5]]), (541, rows0)]
    out = mih.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(out.query_id) == set(range(0, 300, 20)) | {540}
    ids, y = np.array([*range(300), 540, 541]), np.vstack([x, x[5:6], x[5:6]])
    hit = 0
    for q in {*range(0, 300, 20), 540}:
        own = ids != q
        score = y[own] @ y[ids == q][0]
        got = out[out.query_id == q].sort_values("rank").vec_id.tolist()
        assert len(got) == 20
        hit += len(set(got) & set(ids[own][np.lexsort((ids[own], -score))[:20]].tolist()))
    assert hit >= 0.9 * 16 * 20
    few = mih.search(spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")).toPandas()
    assert len(few) == 4
    assert mih.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("wide", [256, 0])
def test_ngram_join(docs, empty, monkeypatch, wide):
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    out = ngram_join.join(docs).collect()
    want = brute_components(list(enumerate(t for _, t in RAW)))
    ids = [k for k, _ in RAW]
    groups = {}
    for i, (_, c) in want.items():
        groups.setdefault(c, []).append(i)
    least = {i: min((ids[j] for j in groups[want[i][1]] if ids[j] is not None), default=None) for i in want}
    key = lambda r: tuple(-(10**9) if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == sorted(((ids[i], want[i][0], least[i]) for i in want), key=key)
    assert ngram_join.join(empty).count() == 0


@pytest.mark.parametrize("wide", [256, 2])
def test_ngram_join_of_a_near_copy_family(spark, monkeypatch, wide):
    """Variants of one text, of which only some pairs link, and texts that share a passage."""
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    rng, base = np.random.default_rng(9), _text(40, 60).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.choice(60, 3, replace=False):
            w[j] = f"v{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, _text(200 + i, 20) + " " + " ".join(base[:25])) for i in range(40)]
    want = brute_components(rows)
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
