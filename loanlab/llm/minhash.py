"""MinHash near-duplicate detection with exact confirmation.

A document's set holds the hashes of its distinct five-word shingles (A-Z
lower-cased; with fewer words, the whole sequence is the one shingle; without
words the set is empty and links with nothing). Documents of equal sets form a
class, so that copies are never paired. Per class:

* ``HASHES`` universal hash minima (multiply-add-shift on 64 bits) in bands of
  ``ROWS``; at a similarity of 0.75 a pair shares no band with probability
  (1 - 0.75^4)^32 = 5e-6;
* within a band's bucket no list of all pairs is made. Each member is paired
  with the bucket's hub (``HUB_TURNS`` hubs, chosen by hash); verified links
  give components; a bucket whose members are in one component needs nothing
  more. Members of the others meet through their rarest shingles: of sets with
  a similarity of 0.75, one shares at least a shingle of the other's
  n - ceil(0.75 n) + 1 first in any common order of all shingles, so taking
  the rare ones first is exact, and a passage that many documents hold pairs
  nobody. Only members of different components are paired, those of a
  shingle's largest component not with each other, and only where parity bits
  of both sets leave a link possible. So every pair that shares
  a bucket is tested, already connected, or shown to be no link: nothing is
  lost to a cap;
* a pair is verified by its signature (an estimate under 0.5 cannot be 0.75
  but with probability 1e-8) and then on the full sets: 100 * intersection
  >= 75 * union;
* components by alternating large-star and small-star (``components``).

Defined results: null, empty or blank text: n_shingles 0, a component of its
own. A row with null doc_id counts its shingles but has null component_id and
is kept. Rows that repeat a doc_id are rows of that document. component_id is
the smallest doc_id of the component. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import WORD, bounded_batches, row_key, stored, whole_text
from .components import connected_components

SHINGLE = 5
HASHES, ROWS = 128, 4
MIN_ESTIMATE = 0.5
HUB_TURNS = 1
SLOTS = 1 << 18  # counters that tell frequent shingles from rare ones
PARITY = 8  # 64-bit numbers of a set's parity bits
SEED = 20240229
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, memo: dict):
    """Sorted distinct 64-bit hashes of the text's shingles (numpy uint64)."""
    import numpy as np
    import xxhash
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(memo) > 400_000:
        memo.clear()
    codes = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w, SEED)
        codes.append(h)
    h = np.array(codes, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED + len(words))], np.uint64)
    n = len(h) - SHINGLE + 1
    mix = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        mix = (mix ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    return np.unique(mix)


def _coefficients():
    import numpy as np
    rng = np.random.default_rng(SEED)
    return (rng.integers(1, 2 ** 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, HASHES, dtype=np.uint64))


def signature(hashes):
    """Minimum of each universal hash over the set (numpy uint32)."""
    import numpy as np
    a, b = _coefficients()
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):  # bounded memory for very long texts
        x = hashes[i:i + 2048] >> np.uint64(1)
        np.minimum(out, (a[:, None] * x[None, :] + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _describe(batches):
    import hashlib

    import pyarrow as pa
    memo: dict = {}
    for batch in batches:
        n, cls, sig = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_hashes(text, memo)
            n.append(len(s))
            cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": batch.column("h"),
                                          "g": batch.column("g"), "n": pa.array(n, pa.int64()),
                                          "cls": pa.array(cls, pa.binary()), "sig": pa.array(sig, pa.binary())})


def _bands(batches):
    """(bucket, cls) for each band of each class."""
    import numpy as np
    import pyarrow as pa
    import xxhash
    step = 4 * ROWS
    for batch in batches:
        keys, cls = [], []
        for c, sig in zip(batch.column("cls").to_pylist(), batch.column("sig").to_pylist()):
            for band in range(HASHES // ROWS):
                keys.append(xxhash.xxh64_intdigest(sig[band * step:(band + 1) * step], band))
                cls.append(c)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64()),
                                          "cls": pa.array(cls, pa.binary())})


def _verify(batches):
    """Of candidate pairs with both texts, those whose sets are similar enough."""
    from collections import OrderedDict

    import numpy as np
    import pyarrow as pa
    memo: dict = {}
    sets: OrderedDict = OrderedDict()  # a hub comes with many partners

    def of(cls, text):
        s = sets.get(cls)
        if s is None:
            s = _own_set(cls, text, memo)
            if s is None:
                return None
            sets[cls] = s
            if len(sets) > 64:
                sets.popitem(last=False)
        return s
    for batch in batches:
        us, vs = [], []
        for r in batch.to_pylist():
            same = np.count_nonzero(np.frombuffer(r["sig_u"], np.uint32) == np.frombuffer(r["sig_v"], np.uint32))
            if same < MIN_ESTIMATE * HASHES:
                continue
            a, b = of(r["u"], r["text_u"]), of(r["v"], r["text_v"])
            if a is None or b is None:
                continue
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                us.append(r["u"])
                vs.append(r["v"])
        yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})


def _own_set(cls, text, memo: dict):
    """The set of a class, or None if the text is of another row with the same doc_id."""
    import hashlib
    s = shingle_hashes(text, memo)
    return s if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == cls else None


def _slot_counts(batches):
    """(slot, n): shingles of this task's sets, counted by a hash slot."""
    import numpy as np
    import pyarrow as pa
    memo: dict = {}
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for cls, text in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist()):
            s = _own_set(cls, text, memo)
            if s is not None:
                counts += np.bincount((s % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    slot = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "n": pa.array(counts[slot], pa.int64())})


def _parity(s):
    """Parity of the shingles in each of 64 * PARITY hash slots. Where two sets differ in a
    bit, they differ in a shingle: so many shingles, at least, are in one of them only."""
    import numpy as np
    slot = ((s >> np.uint64(32)) % np.uint64(64 * PARITY)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=64 * PARITY).astype(np.uint8) & 1).view(np.int64)


def _rarest(counts_b):
    """(shingle, cls, root, n, at, bits) for the shingles of each set of which a similar set holds
    one; ``at`` is the shingle's place (from 1) in the set's order, rare ones first."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        memo: dict = {}
        for batch in batches:
            found = []  # (first shingles, cls, root, n, bits) of a set
            for c, r, text in zip(*[batch.column(k).to_pylist() for k in ("cls", "root", "text")]):
                s = _own_set(c, text, memo)
                if s is not None:
                    order = np.lexsort((s, counts_b.value[(s % np.uint64(SLOTS)).astype(np.int64)]))
                    found.append((s[order[:len(s) - (75 * len(s) + 99) // 100 + 1]], c, r, len(s), _parity(s)))
            times = [len(f[0]) for f in found]

            def spread(k, kind):
                return pa.array([f[k] for f, t in zip(found, times) for _ in range(t)], kind)
            bits = np.repeat(np.array([f[4] for f in found], np.int64).reshape(-1, PARITY), times, axis=0)
            yield pa.RecordBatch.from_pydict({
                "shingle": pa.array([x for f in found for x in f[0].view(np.int64).tolist()], pa.int64()),
                "cls": spread(1, pa.binary()), "root": spread(2, pa.binary()), "n": spread(3, pa.int64()),
                "at": pa.array([i + 1 for t in times for i in range(t)], pa.int64()),
                **{f"b{k}": pa.array(bits[:, k], pa.int64()) for k in range(PARITY)}})
    return run


def _rare_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``members`` (cls, root) in different components that may be similar enough."""
    import numpy as np
    spark = members.sparkSession
    own = stored(members.join(texts, "cls").select("cls", "root", "text"), "open-texts")
    found = own.select("cls", "text").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    rare = stored(own.mapInArrow(_rarest(spark.sparkContext.broadcast(counts)),
                                 "shingle long, cls binary, root binary, n long, at long, "
                                 + ", ".join(f"b{k} long" for k in range(PARITY))), "rare-shingles")
    # of the members of a shingle, those outside its largest component meet all of another component
    shared = stored(rare.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(
        F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("main"))
        .where("roots > 1").select("shingle", "main"), "rare-shared")
    placed = stored(rare.join(shared, "shingle"), "rare-members")
    columns = ["cls", "root", "n", "at", *[f"b{k}" for k in range(PARITY)]]
    few = placed.where("root != main").select("shingle", "main", *[F.col(c).alias(f"{c}_u") for c in columns])
    every = placed.select("shingle", *[F.col(c).alias(f"{c}_v") for c in columns])
    # 100 * intersection >= 75 * union if and only if 7 * (shingles in one set only) <= n_u + n_v
    # similar sets share 3 / 7 of n_u + n_v shingles, so after the first one that they share
    # (itself included) at least so many are left in either order
    differ = " + ".join(f"bit_count(b{k}_u ^ b{k}_v)" for k in range(PARITY))
    return (few.join(every, (few["shingle"] == every["shingle"])
                     & F.expr("root_u != root_v and (root_v = main or cls_u < cls_v)")
                     & F.expr("7 * (least(n_u - at_u, n_v - at_v) + 1) >= 3 * (n_u + n_v)")
                     & F.expr(f"7 * ({differ}) <= n_u + n_v"))
            .select(F.col("cls_u").alias("u"), F.col("cls_v").alias("v")))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    u = texts.select(F.col("cls").alias("u"), F.col("text").alias("text_u"), F.col("sig").alias("sig_u"))
    v = texts.select(F.col("cls").alias("v"), F.col("text").alias("text_v"), F.col("sig").alias("sig_v"))
    return stored(pairs.join(u, "u").join(v, "v").select("u", "text_u", "sig_u", "v", "text_v", "sig_v")
                  .mapInArrow(_verify, "u binary, v binary"), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``
    (``kept``: doc_id is the component's smallest)."""
    return _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))


def _grouped(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` of (doc_id, text) with ids of any type that has an order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # an id and 96 bits of its text find a text again, also where many texts have one id
    docs = docs.withColumns({"h": F.xxhash64("text"), "g": F.hash("text")})
    rows = stored(docs.mapInArrow(_describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, g int, "
                                             "n long, cls binary, sig binary"), "signatures")
    linkable = rows.where("n > 0 and doc_id is not null")
    classes = stored(linkable.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "classes")
    reps = (linkable.join(classes, ["cls", "doc_id"], "left_semi")).dropDuplicates(["cls"])
    bands = reps.select("cls", "sig").mapInArrow(_bands, "bucket long, cls binary")
    # Buckets that more than one class shares. Bands that hold the same classes say the
    # same: of buckets with equal member sets (count and two sums of hashes) one stays.
    shared = stored(bands.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("h1"),
        F.sum(F.xxhash64("cls", F.lit(1)).cast("decimal(20,0)")).alias("h2"))
        .where("n > 1").groupBy("n", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")
    active = stored(bands.join(shared, "bucket").select("bucket", "cls"), "members")
    wanted = stored(active.select("cls").distinct().join(reps, "cls").select("cls", "doc_id", "h", "g", "sig"), "needed")
    texts = stored(docs.join(wanted, ["doc_id", "h", "g"]).dropDuplicates(["cls"]).select("cls", "sig", "text"), "texts")

    links = roots = tested = None
    for turn in range(HUB_TURNS + 1):
        placed = active.withColumn("root", F.col("cls")) if roots is None else active.join(
            roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        # a bucket is open while members of it are in different components; its hub changes every turn
        hub = F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("o"), "cls", "root")).alias("h")
        open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), hub).where(
            "low != high").select("bucket", F.col("h.cls").alias("hub"), F.col("h.root").alias("hub_root"))
        rows_open = stored(placed.join(stored(open_, "open"), "bucket"), "open-rows")
        if rows_open.isEmpty():
            break
        if turn < HUB_TURNS:
            cross = rows_open.where("root != hub_root").select(F.col("cls").alias("u"), F.col("hub").alias("v"))
            active = rows_open.where("cls != hub").select("bucket", "cls")  # the hub has met every other member
        else:
            cross = _rare_pairs(rows_open.select("cls", "root").distinct(), texts)
        pairs = _ordered(cross.select("u", "v"))
        pairs = stored(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = _links(pairs, texts)
        links = found if links is None else links.union(found)
        roots = connected_components(links)
    if roots is None:
        roots = spark.createDataFrame([], "node binary, root binary")

    # smallest doc_id of every component, then of every class
    lowest = (roots.join(classes, roots["node"] == classes["cls"])
              .groupBy("root").agg(F.min("doc_id").alias("component_id")))
    linked = roots.join(lowest, "root").select(F.col("node").alias("cls"), "component_id")
    owner = stored(classes.join(linked, "cls", "left")
                   .select("cls", F.coalesce("component_id", "doc_id").alias("component_id")), "owners")
    return (rows.select("doc_id", "n", "cls").join(owner, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), None)
                    .otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def unique_rows(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group of rows: that of the smallest doc_id
    (null last). Rows are told apart by 128 bits of id and text, so rows that share
    an id are decided each on their own, as are rows without one; of rows equal in both,
    one with the smallest key of all columns (nulls included) stays. Rows without words all
    stay. Input columns may have any names but ``__row`` and ``__all``, which are refused."""
    columns = docs.columns
    if {"__row", "__all"} & set(columns):
        raise ValueError("columns __row and __all are used here")
    pair = F.to_json(F.struct(F.col("doc_id").cast("long").alias("i"), whole_text().alias("t")), {"ignoreNullFields": "false"})
    keys = {"__row": F.unhex(F.substring(F.sha2(pair, 256), 1, 32)), "__all": row_key(columns)}
    keyed, words = docs.withColumns(keys), whole_text().rlike(WORD)
    ids = stored(keyed.where(words).select("__row", "__all", F.col("doc_id").cast("long").alias("__id")), "row-keys")
    found = _grouped(keyed.where(words).select(F.col("__row").alias("doc_id"), whole_text().alias("text")))
    groups = found.groupBy(F.col("doc_id").alias("__row")).agg(F.min("component_id").alias("__group"))
    first = F.min(F.struct(F.col("__id").isNull().alias("o"), "__id", "__row", "__all")).alias("__first")
    kept = stored(ids.join(groups, "__row").groupBy("__group").agg(first).select("__first.__row", "__first.__all"),
                  "kept-rows")
    once = keyed.join(kept, ["__row", "__all"], "left_semi").dropDuplicates(["__row"])
    return once.unionByName(keyed.where(~words)).select(*columns)
