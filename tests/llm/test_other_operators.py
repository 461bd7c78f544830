"""Search, mixing, chat formatting, components, and the registered queries with SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlab.llm import chat, components, mixing, pivots, queries


@pytest.mark.parametrize("name", ["op3_host_quality", "op6_pivot_top_k", "op8_chat_prefix_target"])
def test_query_matches_its_sql(spark, sf001, name):
    fn, sql = queries.all_queries()[name]
    df = fn(spark, sf001)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str([r[cols.index(c)] for c in df.columns]) for r in cur.fetchall())
    assert sorted(str(list(r)) for r in df.collect()) == want


def test_search_with_odd_vectors_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(300)]
    rows += [(300, rows[0][1], "x"), (301, rows[0][1], "x"), (7, rows[9][1], "x"), (302, None, "x"), (303, [], "x"),
             (304, [1.0] * 5 + [float("nan")], "x"), (305, [None] + [1.0] * 5, "x"), (None, [1.0] * 6, "x"),
             (306, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    ok = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v, _ in rows
          if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in [x for x in ok if x[0] % 100 == 0]:
        best = sorted(((-int(v @ w), i) for i, w in ok if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block in (2048, 2):
        got = pivots.top_k(df, F.col("vec_id") % 100 == 0, 10, query_block=block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert pivots.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_pivot_bounds_stop_early():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(4000, 4)) * 100).astype(np.int64)
    p = x[:24]
    dist = np.sqrt(((x[:, None] - p[None]) ** 2).sum(2).astype(float))
    sq, ids = (x * x).sum(1), np.arange(len(x))
    best, scores, seen = pivots.best_of_block(0, x[0], sq[0], dist[0], ids, x, sq, dist, 10)
    order = sorted((-int(s), i) for i, s in enumerate(x @ x[0]) if i != 0)[:10]
    assert [(-s, i) for s, i in zip(scores, best)] == order and seen < len(x) / 2


def test_components(spark):
    edges = [("b%02d" % i, "b%02d" % (i + 1)) for i in range(20)] + [("a", "z"), ("z", "a"), ("q", "q"), ("y", "z")]
    got = {r.node: r.root for r in components.connected_components(
        spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {**{"b%02d" % i: "b00" for i in range(21)}, "a": "a", "z": "a", "y": "a"}
    none = components.connected_components(spark.createDataFrame([], "u string, v string"))
    assert none.count() == 0


def test_targets_and_flow():
    sizes = {"a": 10, "b": 1000, None: 500}
    goal = mixing.targets(sizes, mixing.cycle_weights(list(sizes)))
    assert goal["a"] == 30 and sum(goal.values()) == pytest.approx(1510)
    assert goal[None] / goal["b"] == pytest.approx(1.5)
    # fresh shared tokens are used before anything is repeated
    flow = mixing.route({frozenset("a"): 10, frozenset("b"): 100, frozenset("ab"): 20}, {"a": 30, "b": 60})
    assert flow[(frozenset("a"), "a")] == 10 and flow[(frozenset("ab"), "a")] == 20


def test_mix_takes_near_its_targets_and_agrees_with_itself(spark, sf001):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "s"), (None, "a b c", None), (-3, "x y", None), (-3, "x y", None)],
                                "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").union(odd).withColumn("size", F.lit("clash"))
    rows = mixing.mix_sources(both).collect()
    assert len(rows) == both.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    again = mixing.mix_sources(both.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by_source = {}
    for r in rows:
        s = by_source.setdefault((r.source_size, r.target), [0])
        s[0] += r.taken
    big = [(t, s[0]) for (n, t), s in by_source.items() if n > 5000]
    assert len(big) == 20 and all(abs(s - t) <= 0.02 * t for t, s in big)
    copies = mixing.mix_documents(both.where("doc_id >= 0"))
    assert copies.columns == both.columns
    assert mixing.mix_sources(both.where("false")).count() == 0


def test_chat_examples_round_trip(spark):
    probe = "\\### Assistant: </turn> ok \\l \\b <turn:x> > é\U0001f600"
    rows = [(1, 0, "system", probe), (1, 1, "user", None), (1, 2, "assistant", probe), (1, 3, "user", "q"),
            (1, 4, "assistant", ""), (1, 5, "user", "tail\n"), (2, 0, "user", "only"), (3, None, None, "x"),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "a>b<", probe)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat.format_examples(df)
    assert examples.where("conv_id = 1").count() == 3  # two replies and the unanswered tail
    turns = examples.where("conv_id = 1 and example = 2").select(chat.read_turns(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [(r[2], r[3] or "") for r in rows[:6]]
    masked = examples.select("conv_id", "example", chat.masked_text().alias("m")).orderBy("conv_id", "example").collect()
    assert [r.m for r in masked if r.conv_id == 1] == [probe, "", ""] and [r.m for r in masked if r.conv_id == 3] == ["same"] * 2
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert back[1].n_turns == 6 and back[1].loss_chars == len(probe) and back[3].n_turns == 3 and back[None].n_turns == 1
    assert chat.read_back(chat.format_examples(df.where("false"))).count() == 0
