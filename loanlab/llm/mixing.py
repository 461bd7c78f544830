"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources that hold
their text. Tokens flow from patterns to sources: a pattern offers the tokens
of its distinct texts, the i-th repetition at cost i - 1 a token (convex), a
source may take ``max_repeats`` times its own copies of them, and each source
takes its quota from the patterns that name it. Flows of rising cost route the
quotas at least total cost (``route``): texts that only one source holds, or
that no other source has used, go first. A flow is then spent on the copies of
its source: every document floor(flow / tokens) times, and the rest on
documents in the order of a seeded hash while they fit, and last on the
documents that fit the remainder best (``FILL_TURNS`` of them at most); where
more than ``ROUGH`` of it is missing then, a document too many is taken and
others are left for it.

Scale: texts are only counted and hashed; sizes go to the shared folder.
Weights and targets are worked out on tables with a row per source, of any
number; the driver sees a few sums. Sources that share texts, directly or
through others, are a component, and each component (also of one source) is
routed in one task, which holds its (pattern, source) pairs, not documents:
the time for the largest component bounds what can be mixed. The seeded
order needs no global sort: documents fall into hash ranges, sizes are summed
per (pattern, source, range), and only the one range in which a flow ends is
ranked document by document; the number of ranges grows with the documents.

Defined results: null text has size 0; null source is a source (last in
order); documents of size 0 take nothing; repeated rows are documents each;
null doc_ids are allowed; extra columns are ignored (``mix_documents`` keeps
them); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, row_key, stored, whole_text
from .components import connected_components

MAX_REPEATS = 3
PER_RANGE = 50_000
FILL_TURNS = 3
ROUGH = 0.005
SEED = "mix-1"


def cycle_weights(sources: list) -> dict:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted(s for s in sources if s is not None) + [s for s in sources if s is None]
    return {s: 1 + i % 3 for i, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, max_repeats: int = MAX_REPEATS) -> dict:
    """Targets that share the total by weight, none above ``max_repeats`` times
    its source's size; an excess is shared by weight among the others."""
    total, capped = float(sum(sizes.values())), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in weights if s not in capped]
        w = sum(weights[s] for s in free)
        share = {s: rest * weights[s] / w for s in free} if w else {}
        over = {s: float(max_repeats * sizes[s]) for s in free if share[s] > max_repeats * sizes[s]}
        if not over:
            return {**capped, **share}
        capped.update(over)


def route(patterns: dict, quotas: dict, max_repeats: int = MAX_REPEATS, held: dict | None = None) -> dict:
    """Tokens that each pattern gives to each source: {(pattern, source): n}.

    patterns: {frozenset of sources: tokens}; quotas: {source: tokens}; held:
    {(pattern, source): tokens of the source's own copies}, ``tokens`` unless
    given. Integer min-cost flow: the arcs start -> pattern hold ``tokens`` each
    and cost 0, 1, 2, ... (with ``held``, what copies there are beyond
    ``max_repeats`` times the tokens costs alike); pattern -> source holds
    ``max_repeats`` times the source's copies; source -> end its quota. A path
    from start to end costs what its first arc costs, so successive shortest
    paths are maximum flows by rising cost: free arcs first, then those of
    cost 1, and so on, each by blocking flows over level graphs.
    """
    names = sorted(patterns, key=lambda p: sorted(map(str, p)))
    sources = sorted(quotas, key=str)
    place = {s: j for j, s in enumerate(sources)}
    from_p, from_s, ends, room, flow = [[] for _ in names], [[] for _ in sources], [], [], []
    for i, p in enumerate(names):
        for s in sorted(p, key=str):
            if s in place:
                from_p[i].append(len(ends))
                from_s[place[s]].append(len(ends))
                ends.append((i, place[s]))
                room.append(max_repeats * int((held or {}).get((p, s), patterns[p])))
                flow.append(0)
    left, offer = [int(quotas[s]) for s in sources], [0] * len(names)
    for _ in range(max_repeats):
        offer = [o + int(patterns[p]) for o, p in zip(offer, names, strict=True)]
        _fill(from_p, from_s, ends, room, flow, offer, left)
    if held:
        offer = [sum(room[e] - flow[e] for e in own) for own in from_p]
        _fill(from_p, from_s, ends, room, flow, offer, left)
    return {(names[i], sources[j]): f for (i, j), f in zip(ends, flow, strict=True) if f}


def _fill(from_p: list, from_s: list, ends: list, room: list, flow: list, offer: list, left: list) -> None:
    """Send as much as ``offer`` (by pattern) and ``left`` (by source) allow; all but the first three in place."""
    while True:
        # levels: patterns that offer, sources that these reach, patterns that could take back, ...
        of_p, of_s = [0 if o else -1 for o in offer], [-1] * len(left)
        line, level, open_ = [i for i, o in enumerate(offer) if o], 0, False
        while line and not open_:
            reached = []
            for i in line:
                for e in from_p[i]:
                    j = ends[e][1]
                    if of_s[j] < 0 and flow[e] < room[e]:
                        of_s[j] = level + 1
                        reached.append(j)
            open_ = any(left[j] for j in reached)
            line = []
            for j in [] if open_ else reached:
                for e in from_s[j]:
                    i = ends[e][0]
                    if of_p[i] < 0 and flow[e]:
                        of_p[i] = level + 2
                        line.append(i)
            level += 2
        if not open_:
            return
        at_p, at_s = [0] * len(offer), [0] * len(left)
        for first in range(len(offer)):
            while offer[first]:
                end = _path(first, from_p, from_s, ends, room, flow, left, of_p, of_s, at_p, at_s)
                if end is None:
                    break
                j, path = end
                n = min(offer[first], left[j], *[room[e] - flow[e] if k % 2 == 0 else flow[e] for k, e in enumerate(path)])
                for k, e in enumerate(path):
                    flow[e] += n if k % 2 == 0 else -n
                offer[first] -= n
                left[j] -= n


def _path(i, from_p, from_s, ends, room, flow, left, of_p, of_s, at_p, at_s):
    """(source, arcs there) of a path by rising level from pattern ``i`` to a source with something left, or None."""
    path: list = []
    while True:
        # at pattern i
        own = from_p[i]
        while at_p[i] < len(own) and not (flow[own[at_p[i]]] < room[own[at_p[i]]]
                                          and of_s[ends[own[at_p[i]]][1]] == of_p[i] + 1):
            at_p[i] += 1
        if at_p[i] == len(own):  # nowhere to go from here
            if not path:
                return None
            j = ends[path.pop()][1]
            at_s[j] += 1
        else:
            path.append(own[at_p[i]])
            j = ends[own[at_p[i]]][1]
        # at source j
        if left[j]:
            return j, path
        back = from_s[j]
        while at_s[j] < len(back) and not (flow[back[at_s[j]]] and of_p[ends[back[at_s[j]]][0]] == of_s[j] + 1):
            at_s[j] += 1
        if at_s[j] == len(back):
            i = ends[path.pop()][0]
            at_p[i] += 1
        else:
            path.append(back[at_s[j]])
            i = ends[back[at_s[j]]][0]


def _unit(key: Column, seed: str) -> Column:
    """A number of 0 .. 2^40 - 1 from a key and the seed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))


def select(rows: DataFrame, amounts: DataFrame, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """``rows`` (``key``, pattern, size, ...) with ``times``: how often each is taken so
    that a pattern's tokens come to its amount (pattern, amount, tokens)."""
    n = rows.count()
    ranges = max(1, -(-n // PER_RANGE)) * 8
    dealt = rows.withColumn("__u", _unit(F.col(key), seed))
    dealt = dealt.withColumn("__range", F.floor(F.col("__u") * ranges / float(1 << 40)).cast("long"))
    sums = dealt.groupBy("pattern", "__range").agg(F.sum("size").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("pattern").orderBy("__range")
                                 .rowsBetween(Window.unboundedPreceding, -1))
    want = F.col("amount") - F.floor(F.col("amount") / F.greatest("tokens", F.lit(1))) * F.col("tokens")
    plan = stored(sums.join(amounts, "pattern", "left")
                  .select("pattern", "__range", "__sum", F.coalesce(before, F.lit(0)).alias("__before"),
                          F.coalesce(F.floor(F.col("amount") / F.greatest("tokens", F.lit(1))), F.lit(0)).alias("__full"),
                          F.coalesce(want, F.lit(0)).alias("__want")), "mix-ranges")
    placed = dealt.join(plan, ["pattern", "__range"], "left")
    whole = F.col("__before") + F.col("__sum") <= F.col("__want")
    none = F.col("__before") >= F.col("__want")
    settled = placed.where(whole | none).withColumn("__more", whole & ~none)
    # the range in which the flow ends: a bounded share of a pattern, ranked
    w = (Window.partitionBy("pattern", "__range").orderBy("__u", key, "size")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = placed.where(~(whole | none)).withColumn("__more", F.col("__before") + F.sum("size").over(w) <= F.col("__want"))
    state = stored(settled.unionByName(last), "mix-state")
    # what is missing to the flow goes to single documents that fit it best
    gap = (F.max("__want") - F.sum(F.when(F.col("__more"), F.col("size")).otherwise(0))).alias("__gap")
    gaps = stored(state.groupBy("pattern").agg(gap, F.max("__want").alias("__goal")).where("__gap > 0"), "mix-gaps")
    alike = Window.partitionBy("pattern", "__more", "size").orderBy("__u", key)
    some = (state.where("size > 0").withColumn("__place", F.row_number().over(alike)).where(F.col("__place") <= FILL_TURNS)
            .select("pattern", "__more", "size", "__u", F.col(key).alias("__id")))
    flips = some.join(gaps, "pattern").groupBy("pattern").applyInArrow(_flips, "__id long")
    out = state.join(stored(flips.withColumn("__flip", F.lit(True)), "mix-flips"), F.col(key) == F.col("__id"), "left")
    more = F.col("__more") != F.coalesce("__flip", F.lit(False))
    return out.withColumn("times", F.col("__full") + F.when(more, 1).otherwise(0)).drop(
        "__u", "__range", "__sum", "__before", "__full", "__want", "__more", "__id", "__flip")


def _flips(table):
    """Of a pattern's candidates (a few of each size, taken or not), the documents to take or to leave."""
    import bisect

    import pyarrow as pa
    rows = sorted((r["size"], r["__u"], r["__id"], r["__more"]) for r in table.to_pylist())
    gap, goal = table.column("__gap")[0].as_py(), table.column("__goal")[0].as_py()
    out, taken = [r[:3] for r in rows if not r[3]], [r[:3] for r in rows if r[3]]
    flipped: set = set()

    def move(source, target, k):
        one = source.pop(k)
        bisect.insort(target, one)
        flipped.symmetric_difference_update({one[2]})
        return one[0]

    def fitting(source, most):
        k = bisect.bisect_right(source, (most, float("inf"))) - 1
        return bisect.bisect_left(source, (source[k][0],)) if k >= 0 else None
    for _ in range(FILL_TURNS):
        k = fitting(out, gap)
        if k is not None:
            gap -= move(out, taken, k)
    # where much is still missing, a document too many goes in and others leave for it
    k = bisect.bisect_right(out, (gap, float("inf")))
    if gap > ROUGH * goal and k < len(out):
        gap -= move(out, taken, k)
        for _ in range(FILL_TURNS):
            k = fitting(taken, -gap)
            if k is not None:
                gap += move(taken, out, k)
    return pa.table({"__id": pa.array(sorted(flipped), pa.int64())})


def _goals(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(name, source_size, target) from (name, source_size): ``cycle_weights`` and ``targets``
    without a list of the sources on the driver. ``name`` is "0" for null, else "1" and the source."""
    last = (F.col("name") == "0").cast("int")
    dealt = stored(sources.repartitionByRange(last, "name").withColumn("__part", F.spark_partition_id()), "mix-sources")
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(last, "name")) - 1 + F.col("__first")
    weighed = stored(dealt.join(F.broadcast(parts), "__part").withColumn("__w", F.lit(1) + place % 3)
                     .select("name", "source_size", "__w"), "mix-weights")
    total, sums = float(weighed.agg(F.sum("source_size")).first()[0] or 0), None
    share, most = F.lit(0.0), F.lit(float(max_repeats)) * F.col("source_size")
    while True:  # the share of a weight only grows, so a source that is over stays over
        over = share > most
        new = weighed.agg(F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(~over, F.col("__w")).otherwise(0)),
                          F.count_if(over)).first()
        if new == sums or not new[1]:
            return stored(weighed.select("name", "source_size", F.when(over, most).otherwise(share).alias("target")),
                          "mix-goals")
        sums = new
        share = F.lit(total - new[0]) * F.col("__w") / F.lit(float(new[1]))


def _amounts(units: DataFrame, goals: DataFrame) -> DataFrame:
    """(pattern, name, amount) from (pattern, tokens, name, held): every component of sources
    that share patterns, those of one source too, is routed in one task."""
    links = units.groupBy("pattern").agg(F.min("name").alias("u"), F.max("name").alias("last")).where("u != last")
    edges = units.join(links, "pattern").select("u", F.col("name").alias("v"))
    roots = connected_components(edges).select(F.col("node").alias("name"), "root")
    placed = units.join(goals, "name").join(roots, "name", "left").select(
        F.coalesce("root", "name").alias("root"), "pattern", "tokens", "name", "held",
        F.bround("target").cast("long").alias("quota"))
    return placed.groupBy("root").applyInArrow(_routed, "pattern string, name string, amount long")


def _routed(table):
    """(pattern, name, amount) for the rows (pattern, tokens, name, held, quota) of one component."""
    import pyarrow as pa
    names: dict = {}
    tokens, quotas, held = {}, {}, {}
    for r in table.to_pylist():
        names.setdefault(r["pattern"], set()).add(r["name"])
        tokens[r["pattern"]] = r["tokens"]
        quotas[r["name"]] = r["quota"]
        if r["held"] is not None:
            held[(r["pattern"], r["name"])] = r["held"]
    found = {frozenset(v): p for p, v in names.items()}
    held = {(frozenset(names[p]), s): n for (p, s), n in held.items()}
    flow = route({k: tokens[p] for k, p in found.items()}, quotas, held=held or None)
    rows = [(found[k], s, n) for (k, s), n in flow.items()]
    return pa.table({"pattern": pa.array([r[0] for r in rows], pa.string()), "name": pa.array([r[1] for r in rows], pa.string()),
                     "amount": pa.array([r[2] for r in rows], pa.int64())})


def measured(docs: DataFrame, *extra: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(F.col("source").cast("string")).alias("sources"),
                       F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"), *extra)


def _name(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def _dealt(sized: DataFrame) -> DataFrame:
    """``sized`` with ``__key``, a number of its own for every row. Equal rows are counted and
    dealt out again, ``PER_RANGE`` at a time, so that no task meets all of them."""
    columns = sized.columns
    counted = sized.groupBy(*columns).agg(F.count("*").alias("__n"))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / PER_RANGE).cast("long"))
    many = counted.where(F.col("__n") > 1).withColumn("__part", F.explode(parts)).repartition("__part", *columns)
    last = F.least(F.col("__n"), (F.col("__part") + 1) * PER_RANGE)
    many = many.withColumn("__place", F.explode(F.sequence(F.col("__part") * PER_RANGE + 1, last))).drop("__part")
    rows = counted.where(F.col("__n") == 1).withColumn("__place", F.lit(1).cast("long")).unionByName(many)
    return rows.withColumn("__key", F.xxhash64(*columns, F.size("sources"), F.col("sources")[0].isNull(), "__place")).drop(
        "__n", "__place")


def _by_text(rows: DataFrame) -> tuple:
    """(rows with their ``pattern`` and ``name``, units): a pattern is the set of sources that hold a text."""
    rows = rows.withColumn("name", _name(F.col("sources")[0]))
    texts = stored(rows.where("size > 0").groupBy("__text").agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.max("size").alias("size")), "mix-texts")
    pattern = F.when(F.size("names") > 1, F.sha2(F.array_join("names", "\x00"), 256)).otherwise(
        F.concat(F.lit("="), F.col("names")[0])).alias("pattern")
    tokens = texts.groupBy(pattern).agg(F.sum("size").alias("tokens"))
    shared = texts.where(F.size("names") > 1).select("__text", pattern)
    placed = rows.join(shared, "__text", "left").withColumn(
        "pattern", F.coalesce("pattern", F.concat(F.lit("="), F.col("name"))))
    placed = stored(placed, "mix-rows")
    held = placed.groupBy("pattern", "name").agg(F.sum("size").alias("held"))
    units = stored(held.join(tokens, "pattern", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))), "mix-units")
    return placed, units


def _spent(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``rows`` with ``times``: every flow is spent on the copies that its source holds, those of
    shared texts first; what whole documents leave of these flows goes to the source's other texts."""
    of, own = F.concat_ws("\x01", "pattern", "name").alias("pattern"), F.col("pattern") == F.concat(F.lit("="), F.col("name"))
    flows = plan.select("name", own.alias("own"), of, "amount", F.col("held").alias("tokens"))
    both = rows.select("*", own.alias("__own")).withColumn("pattern", of)
    first = stored(select(both.where(~F.col("__own")).drop("__own"), flows.where(~F.col("own")).drop("own", "name"),
                          seed, "__key"), "mix-shared")
    used = first.groupBy("name").agg(F.sum(F.col("times") * F.col("size")).alias("used"))
    whole = flows.groupBy("name").agg(F.sum("amount").alias("whole"))
    rest = flows.where("own").join(whole, "name").join(used, "name", "left")
    left = F.greatest(F.lit(0), F.least(F.col("tokens") * MAX_REPEATS, F.col("whole") - F.coalesce("used", F.lit(0))))
    second = select(both.where("__own").drop("__own"), stored(rest.select("pattern", left.alias("amount"), "tokens"), "mix-rest"),
                    seed, "__key")
    return first.unionByName(second).drop("name")


def mix(sized: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, sources, size, times for documents with ``sources`` (array of the
    sources that hold them), mixed to ``cycle_weights``; also attaches
    source_size and target of the document's first source. ``__row``, if
    there, tells rows apart that agree in the other columns. With ``__text`` (the text's
    hash) every row is a copy in its one source, and the sources that hold a text share its
    tokens: what one takes of it makes it dearer to the others."""
    columns = sized.columns
    rows = _dealt(sized)
    if "__text" in columns:
        rows, units = _by_text(rows)
    else:
        names = F.transform(F.array_sort(F.array_distinct("sources")), _name)
        rows = stored(rows.withColumn("names", names).withColumn("pattern", F.array_join("names", "\x00")), "mix-rows")
        patterns = rows.groupBy("pattern").agg(F.sum("size").alias("tokens"), F.first("names").alias("names"))
        units = stored(patterns.select("pattern", F.explode("names").alias("name"), "tokens",
                                       F.lit(None).cast("long").alias("held")), "mix-units")
    goals = _goals(units.groupBy("name").agg(F.sum(F.coalesce("held", "tokens")).alias("source_size")))
    routed = stored(_amounts(units, goals), "mix-plan")
    if "__text" in columns:
        taken = _spent(rows, routed.join(units.drop("tokens"), ["pattern", "name"]), seed)
    else:
        plan = routed.groupBy("pattern").agg(F.sum("amount").alias("amount")).join(
            units.groupBy("pattern").agg(F.first("tokens").alias("tokens")), "pattern")
        taken = select(rows.drop("names"), plan, seed, "__key")
    return (taken.withColumn("name", _name(F.col("sources")[0])).join(goals, "name")
            .select(*columns, "times", "source_size", "target"))


def mix_sources(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    out = mix(stored(measured(docs, F.xxhash64(whole_text()).alias("__text")), "mix-sizes"), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken. A column named ``__row`` is refused."""
    columns = docs.columns
    if "__row" in columns:
        raise ValueError("a column __row is used here")
    key = row_key(columns)
    rows = stored(measured(docs, F.xxhash64(whole_text()).alias("__text"), key.alias("__row")), "mix-sizes")
    # rows that are equal in all columns stand for each other: one of them goes out for all
    times = stored(mix(rows, seed).groupBy("__row").agg(
        F.sum("times").alias("__llm_times"), F.count("*").alias("__llm_rows")).where("__llm_times > 0"), "mix-times")
    found = docs.withColumn("__row", key).join(times, "__row")
    found = found.where("__llm_rows = 1").unionByName(found.where("__llm_rows > 1").dropDuplicates(["__row"]))
    few = found.where(F.col("__llm_times") <= PER_RANGE).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__llm_times").cast("int"))))
    # very many copies of one row: written by several tasks
    starts = F.sequence(F.lit(0).cast("long"), F.col("__llm_times") - 1, F.lit(PER_RANGE).cast("long"))
    many = found.where(F.col("__llm_times") > PER_RANGE).withColumn("__first", F.explode(starts)).repartition("__row", "__first")
    size = F.least(F.col("__llm_times") - F.col("__first"), F.lit(PER_RANGE))
    many = many.withColumn("__copy", F.explode(F.sequence(F.lit(1), size.cast("int"))))
    return few.select(*columns).unionByName(many.select(*columns))
