"""Each contract query against brute force on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from framewright.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def test_op1_round_trip(spark, docs):
    out = Q.op1_transport_stream(spark, SF).toPandas().set_index("doc_id")
    assert len(out) == len(docs)
    for r in docs.itertuples():
        raw = (r.text or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        o = out.loc[r.doc_id]
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert "gaps=0;damaged=0" in o.feature


def test_op2_pieces_and_places(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(Q.vocabulary())
    out = Q.op2_histogram_packing(spark, SF).toPandas()
    total, by_doc = 0, {k: g.sort_values("piece") for k, g in out.groupby("doc_id")}
    for r in docs.itertuples():
        ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for k, p in enumerate(by_doc[r.doc_id].itertuples()):
            assert (p.piece, p.start) == (k, at)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert p.length == 2048 or k == 0
            at += p.length
        assert at == len(ids)
    used = 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= 2048
        used += 1
    assert used <= -(-total // 2048) * 1.02 + 1


def test_op4_rules(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    out = Q.op4_url_filter(spark, SF).toPandas()
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    assert len(out) == len(pages)
    for r in out.itertuples():
        m = re.match(r"(?s)(?:.*?)://([^/?#]*)([^?#]*)", pages.url[r.page_id])
        host, path = m[1].lower(), m[2]
        assert (r.host, r.path) == (host, path)
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert r.rule == (best[0] + best[1] if best else None)
        if best:
            assert r.verdict == best[2]


def test_op7_law_and_slots(spark, docs):
    out = Q.op7_bfd_sharding(spark, SF).toPandas()
    text = docs.set_index("doc_id").text
    sizes = out.groupby("shard")["size"].sum()
    assert set(sizes.index) == set(range(16)) and sizes.max() - sizes.min() <= 0.01 * sizes.mean() + 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    where = defaultdict(set)
    for r in out.itertuples():
        raw = text[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        where[raw].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_op8_targets(spark, docs):
    out = Q.op8_pareto_mixing(spark, SF).toPandas()
    docs = docs.assign(size=[len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text])
    size = docs.set_index("doc_id")["size"]
    assert (size[out.doc_id].to_numpy() == out["size"].to_numpy()).all()
    per = docs.groupby("source")["size"].sum()
    names = sorted(per.index)
    w, cap, total = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {s: 2 * per[s] for s in names}, 1.5 * per.sum()
    full: set = set()
    while True:
        left, weight = total - sum(cap[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: float(cap[s]) if s in full else left * w[s] / weight for s in names}
        over = {s for s in names if s not in full and target[s] > cap[s]}
        if not over:
            break
        full |= over
    source = docs.set_index("doc_id").source
    out["source"] = source[out.doc_id].to_numpy()
    for s, g in out.groupby("source"):
        assert (g.source_size == per[s]).all() and np.allclose(g.target, target[s])
        assert abs(g.taken.sum() - target[s]) <= g["size"].max() / 2 + 1
        assert (g.taken <= 2 * g["size"]).all() and (g.taken >= 0).all()
    again = Q.op8_pareto_mixing(spark, SF).toPandas()
    assert Counter(map(tuple, again[["doc_id", "taken"]].to_numpy())) == Counter(map(tuple, out[["doc_id", "taken"]].to_numpy()))


def brute_components(texts: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for k, t in texts:
        raw = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", raw)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    pairs = Counter((a, b) for h in holders.values() if len(h) > 1 for i, a in enumerate(h) for b in h[i + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_op10_components(spark, docs):
    want = brute_components([(r.doc_id, r.text) for r in docs.itertuples()])
    out = Q.op10_ngram_join(spark, SF).toPandas()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()}
    assert len(out) == len(docs) and got == want


def brute_removed(texts: list[bytes], width: int) -> list[np.ndarray]:
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                m[i] += 1
                m[min(i + width, len(t))] -= 1
        out.append(np.cumsum(m)[: len(t)] > 0)
    return out


def test_op5_removed_bytes(spark, docs):
    out = Q.op5_suffix_array_dedup(spark, SF).toPandas().set_index("doc_id")
    texts = [(t or "").encode() for t in docs.text]
    assert len(out) == len(docs)
    for key, t, m in zip(docs.doc_id, texts, brute_removed(texts, 200), strict=True):
        o = out.loc[key]
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~m]) if t else b""
        assert (o.n_bytes, o.n_removed, o.n_spans, o.kept_sha256) == (len(t), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()), key


def test_word_cache_equals_the_tokenizer():
    from tokenizers import Tokenizer

    from framewright.llm.packing import WordCache

    c = WordCache(Q.vocabulary())
    texts = ["", " ", "  a  b\n\n c", "it's we'll 12a½ ２３ x²y", "<|endoftext|> end", "x <|endoftext|> y", "start <|endoftext|>", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "a\x1cb\x85c d᠎e\x0b\x0c f", "日本語 テキスト", "Ⅷ_a__b -- ñandú ÷×", "ƻ ǅ ǅ ª º"]
    texts += ["".join(chr(i) + "a " + chr(i) * 2 + "1" for i in range(a, a + 512) if not 0xD800 <= i < 0xE000) for a in range(0, 0x3400, 512)]
    got = [np.frombuffer(x, "<u4").tolist() for x in c.ids(texts)]
    plain = Tokenizer.from_file(Q.vocabulary())
    assert c.cached and got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_op9_recall_and_scores(spark, sf):
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    out = Q.op9_multi_index_hashing(spark, sf).toPandas()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:20]
        got = out[out.query_id == q].sort_values("rank")
        assert len(got) == 20 and list(got["rank"]) == list(range(1, 21))
        assert np.allclose(got.score, [s[ids == v][0] for v in got.vec_id], rtol=0, atol=1e-12)
        hit += len(set(got.vec_id) & set(ids[keep][order]))
        total += 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    r = con.sql(Q.ORACLES[name])
    cols = sorted(r.columns)
    want = sorted(tuple(x[r.columns.index(c)] for c in cols) for x in r.fetchall())
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(tuple(x[c] for c in cols) for x in df.collect()) == want
