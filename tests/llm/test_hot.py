"""Hot groups, long regular texts, texts of several blocks, and what is handed on between steps."""

import hashlib

import numpy as np
import pytest

from framewright.llm import common, ngram_join, suffix_dedup
from tests.llm.test_contracts import brute_components, brute_removed
from tests.llm.test_edges import _text


def _checked_removal(spark, texts: list[str]) -> None:
    raw = [t.encode() for t in texts]
    want = [(int(m.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()) for t, m in zip(raw, brute_removed(raw, 200), strict=True)]
    out = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 200).collect()
    assert [(r["n_removed"], r["kept_sha256"]) for r in sorted(out, key=lambda r: r["doc_id"])] == want


@pytest.mark.parametrize("hot", [1 << 30, 3000])
def test_a_common_line_in_many_contexts(spark, monkeypatch, hot):
    """Its bucket is split at two levels; repeats across the line are found as in one bucket."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    line, edge = _text(300, 25), _text(301, 60)
    texts = [_text(400 + i, 30) + " " + line + " " + _text(500 + i, 30) for i in range(60)]
    texts += [_text(600 + i, 20) + edge for i in range(30)] + [_text(700 + i // 2, 15) + " " + line + " " + _text(800 + i // 2, 15) for i in range(20)]
    _checked_removal(spark, texts)


def _thue_morse(k: int, flip: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1 << k))


def test_regular_texts_are_told_apart(spark):
    a, b = _thue_morse(12, 0), _thue_morse(12, 1)
    prefix = common.Prefix(np.frombuffer((a + b).encode(), np.uint8))
    h = prefix.of(np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]
    _checked_removal(spark, [a, b + "x", _text(1, 60)])
    rows = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, f"{a} one two three four")]
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {1: 1, 2: 2, 3: 1}


def test_texts_of_several_blocks(spark):
    big = _text(7, 240_000)
    assert len(big) > common.BLOCK
    texts = [big, _text(8, 50), big[: 3 * len(big) // 4 + 10], big[1000:], _text(8, 50) + " x"]
    raw = [t.encode() for t in texts]
    out = sorted(suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 200).collect(), key=lambda r: r["doc_id"])
    assert [r["n_removed"] for r in out] == [len(raw[0]), 250 if len(raw[1]) < 200 else out[1]["n_removed"], len(raw[2]), len(raw[3]), out[4]["n_removed"]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute_components(list(enumerate(texts)))


@pytest.mark.parametrize("copies", [100, 400])
def test_links_of_a_loose_family_follow_its_size(spark, monkeypatch, copies):
    """Variants of one text with four changed words, of which few pairs link: links handed on grow with the copies."""
    handed = []
    add = ngram_join.Labels.add

    def counted(self, pairs):
        handed.append(add(self, pairs))
        return handed[-1]

    monkeypatch.setattr(ngram_join.Labels, "add", counted)
    rng, base, rows = np.random.default_rng(11), _text(50, 200).split(" "), []
    for i in range(copies):
        w = list(base)
        for j in rng.choice(200, 4, replace=False):
            w[j] = f"v{i}x{j}"
        rows.append((i, " ".join(w)))
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows)
    assert sum(made for _, made in handed) <= 3 * copies, handed


def test_pairs_made_of_a_loose_family_follow_its_size(spark, monkeypatch):
    """Texts that still lie apart when the leaders have done their part meet some of a large family, and the rest only if they find no link there."""
    monkeypatch.setattr(ngram_join, "DRAWN", 16, raising=False)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    made = []
    whole = ngram_join.all_pairs

    def counted(*args):
        out = whole(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "all_pairs", counted)
    rng, base, rows = np.random.default_rng(12), _text(51, 200).split(" "), []
    for i in range(600):
        w = list(base)
        for j in rng.choice(200, 4, replace=False):
            w[j] = f"v{i}x{j}"
        rows.append((i, " ".join(w)))
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows)
    assert sum(made) <= 30 * len(rows), made


def test_components_of_few_edges_are_joined_at_once(spark, monkeypatch):
    made, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: made.append(name) or stored(df, name))
    edges = [(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(70, 65), (65, 90), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {k: k // 20 * 20 for k in range(60) if k % 20} | {70: 65, 90: 65}
    assert {r["node"]: r["root"] for r in common.components(df).collect()} == want
    assert len(made) == 2
    monkeypatch.setattr(common, "FEW", 0)
    assert {r["node"]: r["root"] for r in common.components(df).collect()} == want
