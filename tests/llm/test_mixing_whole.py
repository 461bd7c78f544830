"""Mixing without a bound on the sources, and over shared sources."""

from collections import Counter

from pyspark.sql import functions as F

from loanlab.llm import mixing


def test_any_number_of_sources(spark):
    rows = [(i, f"host{i % 21_000:05d}", "a b c d") for i in range(42_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(docs)
    sizes = {f"host{i:05d}": 8 for i in range(21_000)}
    goal = mixing.targets(sizes, mixing.cycle_weights(list(sizes)))
    got = {r.s: r for r in out.withColumn("s", F.format_string("host%05d", F.col("doc_id") % 21_000)).groupBy("s").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("n")).collect()}
    assert len(got) == 21_000 and all(r.n == 8 and r.target == goal[s] for s, r in got.items())
    assert all(abs(r.taken - r.target) <= 4 for r in got.values())


def test_targets_with_caps_are_the_plain_ones(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 400, None: 500}
    goal = mixing.targets(sizes, mixing.cycle_weights(list(sizes)))
    rows = spark.createDataFrame([("0" if s is None else "1" + s, n) for s, n in sizes.items()],
                                 "name string, source_size long")
    assert {r.name[1:] or None: r.target for r in mixing._goals(rows).collect()} == goal


def test_shared_sources_end_to_end(spark):
    patterns = [["a"], ["a", "b"], ["b", None], ["c"], ["d", "c"], ["e"]]
    rows = [(i, patterns[i % 6], 1 + i % 7) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    out = mixing.mix(sized).collect()
    tokens = Counter()
    for _, p, n in rows:
        tokens[frozenset(p)] += n
    sizes = Counter()
    for p, n in tokens.items():
        for s in p:
            sizes[s] += n
    goal = mixing.targets(dict(sizes), mixing.cycle_weights(list(sizes)))
    flow = mixing.route(dict(tokens), {s: round(g) for s, g in goal.items()})
    want, got = Counter(), Counter()
    for (p, _), n in flow.items():
        want[p] += n
    for r in out:
        got[frozenset(r.sources)] += r.times * r["size"]
        assert (r.source_size, r.target) == (sizes[r.sources[0]], goal[r.sources[0]])
    # what the documents take is the flow of their component, within a document
    for part in ([["a"], ["a", "b"], ["b", None]], [["c"], ["d", "c"]], [["e"]]):
        keys = [frozenset(p) for p in part]
        assert abs(sum(got[k] for k in keys) - sum(want[k] for k in keys)) <= 7 * len(keys)
