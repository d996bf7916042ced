"""Each stage of the pipeline on its own input, against brute force."""

import re

import numpy as np
import pytest

import corpus_pipeline as P
from framewright.llm import common
from tests.llm.test_contracts import brute_components, brute_removed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    out, docs = [], common.read(spark, SF, "documents")
    for name, f in P.STAGES:
        new = common.stored(f(spark, docs, SF), "test-stage")
        out.append((docs, new))
        docs = new
    return out


def test_names_and_columns(stages):
    assert len(P.STAGES) == 5
    for _, new in stages[:-1]:
        assert new.columns == P.COLUMNS


def test_quality(spark, stages):
    docs, kept = stages[0]
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    labels = common.read(spark, SF, "labels").collect()
    clean = [r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert np.mean([i in ids for i in clean]) > 0.9 and np.mean([i in ids for i in bad]) < 0.1


def test_near_duplicates(stages):
    docs, kept = stages[1]
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, c in want.values()})


def test_repeats(stages):
    docs, kept = stages[2]
    rows = docs.collect()
    texts = [(r["text"] or "").encode() for r in rows]
    want = {}
    for r, t, m in zip(rows, texts, brute_removed(texts, 200), strict=True):
        rest = bytes(np.frombuffer(t, np.uint8)[~m]) if t else b""
        if rest or not m.any():
            want[r["doc_id"]] = re.sub("�+", "?", rest.decode(errors="replace"))
    got = {r["doc_id"]: re.sub("�+", "?", r["text"] or "") for r in kept.collect()}
    assert got == want


def test_mix(stages):
    docs, mixed = stages[3]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    taken: dict[int, int] = {}
    for r in mixed.select("doc_id").collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert set(taken) <= set(size) and max(taken.values()) <= 2
    assert abs(sum(size[k] * n for k, n in taken.items()) / sum(size.values()) - 1.5) < 0.1


def test_pack(stages):
    docs, packed = stages[4]
    p = packed.toPandas()
    assert p[p.piece == 0].shape[0] == docs.count() and p.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()


# ---- nulls, empty and long texts, ties, repeated rows and ids, clashing columns, empty tables


@pytest.fixture(scope="module")
def edges(spark):
    from tests.llm.test_edges import RAW

    rows = [*RAW, (12, "another text under a repeated id " * 9), (None, RAW[4][1]), (None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row long, head long, kept string, copies int"
    return rows, spark.createDataFrame([(k, t, None, None if (k or 0) % 2 else "s", len(t or ""), 7, 7, "x", 3) for k, t in rows], kind)


def test_quality_of_edge_rows(spark, edges):
    rows, docs = edges
    out = P.quality(spark, docs, SF)
    assert out.columns == P.COLUMNS and out.count() <= len(rows)


def test_near_duplicates_of_edge_rows(spark, edges):
    rows, docs = edges
    got = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, SF).collect()]
    groups: dict = {}
    for i, (_, c) in brute_components(list(enumerate(t for _, t in rows))).items():
        groups.setdefault(c, []).append(rows[i])
    assert len(got) == len(groups)
    for members in groups.values():
        least = min(((k is None, k or 0) for k, _ in members))
        assert any((k is None, k or 0) == least and (k, t) in members for k, t in got)


def test_repeats_of_edge_rows(spark, edges):
    rows, docs = edges
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (k, t), raw, m in zip(rows, texts, brute_removed(texts, 200), strict=True):
        rest = bytes(np.frombuffer(raw, np.uint8)[~m]) if raw else b""
        if rest or not m.any():
            want.append((str(k), None if t is None else rest.decode(errors="replace")))
    got = [(str(r["doc_id"]), r["text"]) for r in P.exact_repeats(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mix_and_pack_of_edge_rows(spark, edges):
    rows, docs = edges
    mixed = P.mix(spark, docs, SF)
    names = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert mixed.columns == P.COLUMNS and all((t or "").split() for _, t in names)
    for x in set(names):
        assert names.count(x) <= 2 * rows.count(x)
    assert P.pack(spark, docs, SF).filter("piece = 0").count() == len(rows)


def test_stages_of_an_empty_table(spark, edges):
    none = edges[1].limit(0)
    assert [f(spark, none, SF).count() for _, f in P.STAGES] == [0] * 5
