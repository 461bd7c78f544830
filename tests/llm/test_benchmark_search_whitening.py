"""Decontamination, lexical search and whitening against plain versions, with odd rows."""

import hashlib
import math
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from loanlab.llm import bidiagonal, decontam, lexical, whiten

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, words string, `key` long, items string"
ITEMS = "item_id long, text string, runs string"


def _low(text):
    return (text or "").translate(LOWER)


# ------------------------------------------------------------ decontamination
def _plain_hits(text, items, window=10):
    words = [m for m in WORD.finditer(_low(text))]
    said, hit, ids = [m.group() for m in words], set(), set()
    for item, t in items:
        w = WORD.findall(_low(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            cut = w[i:i + window]
            for j in range(len(said) - len(cut) + 1):
                if said[j:j + len(cut)] == cut:
                    hit.update(range(j, j + len(cut)))
                    ids.add(item)
    return len(said), hit, sorted(str(i) for i in ids if i is not None), words


def _odd_documents():
    item = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu?"
    items = [(1, item), (2, "Größe ÄRGER naïve"), (10, "x"), (3, None), (4, ""), (5, "!!"), (None, "nameless item here"),
             (1, item), (6, "iota kappa lambda mu nu xi omicron pi rho sigma tau"), (7, "a b a b a b a b a b a b")]
    texts = [None, "", " \n", item, item.upper(), "pre " + item.replace(" ", " -- ") + " post", item[:-4], "alphabeta gamma",
             "größe Ärger naïve", "GRÖßE ÄRGER naïve", "größe ÄRGER naïve größe ÄRGER naïve", "x", "xx x-x", "é nameless\titem  HERE",
             "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon",
             "a b " * 40, "b a " * 5, "word " * 3000 + item + " word" * 3000, "z" * 5000 + " " + item, "\x00" + item]
    docs = [(i if i % 5 else None, t, "c", i, "c") for i, t in enumerate(texts)] + [(3, item, "c", 0, "c")] * 3
    return docs, items


@pytest.mark.parametrize("block_bytes,piece", [(1 << 22, 1 << 20), (60, 1 << 20), (1 << 22, 64)])
def test_passages_as_a_plain_search_finds_them(spark, monkeypatch, block_bytes, piece):
    monkeypatch.setattr(decontam, "PIECE", piece)
    docs, items = _odd_documents()
    got = decontam.find_passages(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(*r, "c") for r in items], ITEMS),
                                 block_bytes=block_bytes).collect()
    want = []
    for i, text, *_ in docs:
        n, hit, ids, words = _plain_hits(text, items)
        runs = []
        for p in sorted(hit):
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        want.append((i, n, tuple(map(tuple, runs)), tuple(ids),
                     tuple((words[a].start(), words[b].end()) for a, b in runs)))
    rows = [(r.key, r.words, tuple(map(tuple, r.runs)), tuple(r["items"]), tuple(map(tuple, r.spans))) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_contamination_digest_and_empty_tables(spark):
    docs, items = _odd_documents()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*r, "c") for r in items], ITEMS)
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(d, b).collect()}
    want = set()
    for i, text, *_ in docs:
        n, hit, ids, _ = _plain_hits(text, items)
        want.add((i, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    assert got == want
    clean = decontam.contamination(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_items for r in clean)
    assert decontam.contamination(d.limit(0), b).count() == 0


# ------------------------------------------------------------- lexical search
def _plain_search(docs, items, k=20):
    terms = [(i, TERM.findall(_low(t))) for i, t in docs]
    counted = [(i, len(w), {x: w.count(x) for x in set(w)}) for i, w in terms if w]
    n_docs, length = len(counted), sum(n for _, n, _ in counted)
    df = {}
    for _, _, tf in counted:
        for t in tf:
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, n, tf in counted:
            m = 75 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
                    for t in TERM.findall(_low(text)) if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("item_block,item_terms,tile,doc_tile", [(512, 1 << 14, 2048, 512), (2, 8, 3, 4), (512, 1 << 14, 1, 1)])
def test_search_as_a_plain_one(spark, monkeypatch, item_block, item_terms, tile, doc_tile):
    monkeypatch.setattr(lexical.term_tiles, "__defaults__", (tile, lexical.EXACT))
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(40)] + ["Größe", "ÄRGER", "don't", "x_y"]
    docs = [(int(i), " ".join(rng.choice(word, int(rng.integers(1, 30))))) for i in range(90)]
    docs += [(200 + i, "w1 w2 W3") for i in range(30)] + [(None, "w1 w2 w3")] * 3 + [(5, "w1 w2 w3"), (900, None), (901, ""), (902, " ?!"),
             (903, "w7 " * 20000)]
    items = [(1, "w1 W2 w2 w2"), (2, "größe don't"), (2, "w39"), (None, "w3 w4 w5"), (3, None), (4, ""), (5, "never seen"), (6, "w7"),
             (7, " ".join(word))]
    got = lexical.search(spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, n long, terms string").repartition(5),
                         spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n long"),
                         item_block=item_block, item_terms=item_terms, doc_tile=doc_tile)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_search(docs, items)


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0
    assert lexical.search(d.withColumn("text", d.text.substr(9, 1)), i).count() == 0  # no term at all
    assert [tuple(r) for r in lexical.search(d, i).collect()] == _plain_search([(1, "a b")], [(1, "a")])


def test_tiles_stay_exact_beyond_2_to_the_53(spark):
    """Weights whose products pass 2^53 in one sum are cut into tiles that stay below."""
    weights = [(t, 0, 3_000_000_000 + t) for t in range(9)] + [(4, 1, 25_000_000_001), (2, 1, 7)]
    tiles = lexical.term_tiles(sorted(weights), 9, 2)
    for _, items, _, w in tiles:
        for i in (0, 1):
            assert w[items == i].sum() * lexical.IMPACT < 2 ** 53
    terms, docs = np.tile(np.arange(9), 2), np.repeat([0, 1], 9)
    impact = np.concatenate([np.full(9, 999_999), np.arange(9) * 7919 + 1])
    got = lexical.tile_scores(tiles, 2, terms, docs, impact, 2)
    for i in (0, 1):
        for d in (0, 1):
            assert got[i, d] == sum(w * int(impact[d * 9 + t]) for t, j, w in weights if j == i)


# ------------------------------------------------------------------ whitening
def _vectors(spark, x, parts=4):
    rows = [(i, [None if c is None else float(c) for c in v] if v is not None else None, 0, "c") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x long, component string").repartition(parts)


def _plain_whitening(x, k=32):
    """n, deviation by row, eigenvalues, directions by a dense eigensolver."""
    x = np.floor(64 * np.asarray(x, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    away = n * x - x.sum(axis=0)
    e, w = np.linalg.eigh((away / n).T @ (away / n) / n)
    return n, (away ** 2).sum(axis=1), e[::-1][:k], w[:, ::-1][:, :k], away / n, e.sum()


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_as_a_dense_solver(spark, parts):
    x = np.random.default_rng(1).standard_normal((700, 48)) * np.linspace(0.2, 2, 48)
    got = whiten.whiten(_vectors(spark, x, parts)).toPandas()
    n, dev, e, w, y, trace = _plain_whitening(x)
    assert len(got) == 700 * 32 and set(got.n) == {700} and got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1
    by = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    want = (y @ w) / np.sqrt(e)
    signs = np.sign((by * want).sum(axis=0))
    assert np.abs(by - want * signs).max() < 1e-8
    assert (got.groupby("vec_id").deviation.first().sort_index().to_numpy() == dev).all()
    assert np.allclose(got.groupby("component").explained.first().sort_index().to_numpy(), e / trace, rtol=1e-12)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = np.round(rng.standard_normal((60, 6)), 3)
    good[:, 2], good[:, 4] = 0.5, good[:, 1]  # a constant and a dependent dimension
    good[20:50] = good[20]  # one vector many times
    rows = [list(v) for v in good] + [None, [], [1.0, None] + [0.0] * 4, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    got = whiten.whiten(_vectors(spark, rows)).toPandas()
    assert sorted(got.vec_id.unique()) == list(range(60)) and sorted(got.component.unique()) == [1, 2, 3, 4]
    assert got.identity_error.max() < 1e-10 and abs(got[got.vec_id == 0].explained.sum() - 1) < 1e-12
    ids = spark.createDataFrame([(None, [float(i), 1.0]) for i in range(3)] + [(1, [0.0, 0.5])] * 2, "vec_id long, embedding array<double>")
    assert sorted(map(str, whiten.whiten(ids).toPandas().vec_id)) == sorted(["nan"] * 6 + ["1.0"] * 4)
    for empty in (ids.limit(0), ids.where("vec_id = 1"), ids.selectExpr("vec_id", "cast(null as array<double>) embedding")):
        out = whiten.whiten(empty)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for far in ([1e30, -1e30], [1e10, -1e10]):
        with pytest.raises(ArithmeticError):
            whiten.whiten(spark.createDataFrame([(1, far), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("seed", range(3))
def test_solver_on_close_and_equal_values(seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((300, 40)))[0]
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    spread = [np.array([3.0] * 10 + [2] * 10 + [1] * 20), np.geomspace(1, 1e-9, 40), np.arange(40.0), np.ones(40)]
    for s in spread:
        for noise in (0, 1e-12, 1e-7):
            y = (q * s) @ turn + noise * rng.standard_normal((300, 40))
            lams, v = bidiagonal.right_singular(np.linalg.qr(y, mode="r"), 40)
            want = np.linalg.svd(y, compute_uv=False) ** 2
            assert np.allclose(lams, want, rtol=1e-6, atol=1e-13 * want[0])
            k = v.shape[1]
            assert np.abs(v.T @ v - np.eye(k)).max() < 1e-6
            assert np.abs(y.T @ (y @ v) - v * lams[:k]).max() < 1e-6 * lams[0]


def test_dqds_against_the_definition():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 17, 60):
        a, b = rng.standard_normal(d), rng.standard_normal(max(d - 1, 0))
        want = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
        assert np.allclose(bidiagonal.squared_singular_values(a, b), want, rtol=1e-10, atol=1e-14 * want[0])


# ------------------------------------------------------------------ exact top-k
def test_top_k_refuses_overflow_and_tells_queries_apart(spark):
    from loanlab.llm import pivots
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(9000)] + [(0, rng.standard_normal(8).tolist())]
    rows += [rows[0]]  # a query twice, and another under its id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = pivots.top_k(df, F.col("vec_id") % 3000 == 0, k=5).collect()
    ids, x = np.array([r[0] for r in rows]), np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64)
    want = []
    for q in [0, 3000, 6000, 9000]:
        scores = x @ x[q]
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != ids[q])[:5]
        want += [(int(ids[q]), r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    for far in (4e6, 1e30):
        with pytest.raises(ArithmeticError):
            pivots.top_k(spark.createDataFrame([(1, [far, far]), (100, [1.0, 0.0])], df.schema), F.col("vec_id") % 100 == 0)
