"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of digits, letters a-z (A-Z lower-cased) and anything beyond
ASCII. Every benchmark item gives its windows of ``WINDOW`` consecutive words
(an item of fewer words is one window). All windows go into one automaton over
normalised text: words with one blank around each, so that a match can only
begin and end at words. A document is normalised once and scanned once, in
pieces of ``PIECE`` bytes that carry the automaton's state on; every match
ends at a blank, whose number gives the words that are hit, and only for
documents with matches the words are mapped back to places in the original.

Scale: documents stay where they are, no text is shuffled. The automaton of a
task holds at most about ``BLOCK_BYTES`` of windows (the size is summed before
anything is sent); a larger benchmark is dealt into blocks of windows by hash,
each an automaton and a scan of its own, and what the blocks find is put
together by the digest of the text.

Defined results: null and empty texts have no words and are clean; a null
doc_id stays null; repeated rows are documents each; rows of one item_id are
one item; the windows of an item without an id hit words, but there is no item
to count; an empty benchmark hits nothing; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, byte_pieces, stored, whole_text

WINDOW = 10
PIECE = 1 << 20
BLOCK_BYTES = 1 << 22
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "words long, runs array<struct<first:long,last:long>>, items array<string>"
SPANS = "spans array<struct<start:long,end:long>>"


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, words, items): distinct windows with the ids of the items that hold them."""
    words = F.regexp_extract_all(F.translate(whole_text(), UPPER, UPPER.lower()), F.lit(BENCH_WORD), F.lit(0))
    w, n = F.col("w"), F.size("w")
    cut = F.when(n > window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.slice(w, i, window))
                 ).otherwise(F.array(w))
    return (items.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(n > 0)
            .select("item", F.explode(cut).alias("w"))
            .groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("words"))
            .agg(F.collect_set("item").alias("items")))


def _automaton(rows):
    import ahocorasick
    a = ahocorasick.Automaton()
    for k, (window, _, _) in enumerate(rows):
        a.add_word(" " + window.encode().decode("latin-1") + " ", k)
    a.make_automaton()
    return a


def _scanner(rows_b, with_spans: bool, only_hits: bool):
    """(key, text) -> key, words, runs of hit words, items (, spans); ``rows_b``: windows of one block."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        rows = rows_b.value
        automaton = _automaton(rows) if rows else None
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                n, matches, blanks, search = 0, [], [], None
                raw = text.encode()
                for piece in byte_pieces(raw, PIECE):
                    words = piece.split()
                    if not words:
                        continue
                    line = b" ".join(words) + b" "
                    if automaton is not None:
                        if search is None:
                            line = b" " + line
                            search = automaton.iter(line.decode("latin-1"))
                        else:
                            search.set(line.decode("latin-1"), False)
                        found = list(search)
                        if found:
                            matches += found
                    blanks.append(line)
                    n += len(words)
                runs, items = [], []
                if matches:
                    place = np.flatnonzero(np.frombuffer(b"".join(blanks), np.uint8) == 32)  # blank i stands before word i
                    which = np.array([k for _, k in matches])
                    last = np.searchsorted(place, np.array([e for e, _ in matches])) - 1
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, last - np.array([rows[k][1] for k in which]) + 1, 1)
                    np.add.at(edge, last + 1, -1)
                    hit = np.concatenate([[0], (np.cumsum(edge[:n]) > 0).astype(np.int8), [0]])
                    steps = np.flatnonzero(np.diff(hit))
                    runs = [{"first": int(a), "last": int(b) - 1} for a, b in zip(steps[::2], steps[1::2], strict=True)]
                    items = sorted({i for k in np.unique(which) for i in rows[k][2]})
                out.append((n, runs, items, _spans(raw, runs) if with_spans else None))
            cols = {"words": pa.array([r[0] for r in out], pa.int64()),
                    "runs": pa.array([r[1] for r in out], _run_type(pa, "first", "last")),
                    "items": pa.array([r[2] for r in out], pa.list_(pa.string()))}
            if with_spans:
                cols["spans"] = pa.array([r[3] for r in out], _run_type(pa, "start", "end"))
            got = pa.RecordBatch.from_pydict({"key": batch.column("key"), **cols})
            yield got.filter(pa.array([bool(r[1]) for r in out], pa.bool_())) if only_hits else got
    return run


def _run_type(pa, a: str, b: str):
    return pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))


def _spans(raw: bytes, runs: list) -> list:
    """Places (code points, end exclusive) in the original of runs of words."""
    import numpy as np
    if not runs:
        return []
    known = np.zeros(len(raw) + 2, np.int8)
    at = 0
    for piece in byte_pieces(raw, PIECE):
        known[at + 1:at + 1 + len(piece)] = np.frombuffer(piece, np.uint8) != 32
        at += len(piece)
    steps = np.flatnonzero(np.diff(known))
    starts, ends = steps[::2], steps[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # code points before a byte
    return [{"start": int(points[starts[r["first"]]]), "end": int(points[ends[r["last"]]])} for r in runs]


def _joined(with_spans: bool):
    """(key, text, runs and items of several blocks) -> the columns of ``_scanner``."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for text, runs, items in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(),
                                         batch.column("items").to_pylist(), strict=True):
                raw, merged = text.encode(), []
                for r in sorted(runs or [], key=lambda r: r["first"]):
                    if merged and r["first"] <= merged[-1]["last"] + 1:
                        merged[-1]["last"] = max(merged[-1]["last"], r["last"])
                    else:
                        merged.append(dict(r))
                n = sum(len(p.split()) for p in byte_pieces(raw, PIECE))
                out.append((n, merged, sorted(items or []), _spans(raw, merged) if with_spans else None))
            cols = {"words": pa.array([r[0] for r in out], pa.int64()),
                    "runs": pa.array([r[1] for r in out], _run_type(pa, "first", "last")),
                    "items": pa.array([r[2] for r in out], pa.list_(pa.string()))}
            if with_spans:
                cols["spans"] = pa.array([r[3] for r in out], _run_type(pa, "start", "end"))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), **cols})
    return run


def find_passages(docs: DataFrame, items: DataFrame, key: Column | None = None, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, spans: bool = True) -> DataFrame:
    """One row per row of ``docs``: key (``doc_id`` unless given), words, runs of hit
    words (from 0, both ends included), items (ids whose windows occur, sorted)
    and, with ``spans``, the runs as places in the original text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    key = F.col("doc_id").cast("long") if key is None else key
    texts = docs.select(key.alias("key"), whole_text().alias("text"))
    kind = dict(texts.dtypes)["key"]
    schema = f"key {kind}, {FOUND}" + (f", {SPANS}" if spans else "")
    table = stored(windows(items, window), "bench-windows")
    total = table.agg(F.sum(F.octet_length("window") + 3 + F.aggregate(
        "items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))

    def block(b: int):
        own = table.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == b)
        return spark.sparkContext.broadcast([(r.window, r.words, r["items"]) for r in own.toLocalIterator()])
    if n_blocks == 1:
        return texts.mapInArrow(_scanner(block(0), spans, False), schema)
    digest = F.sha2("text", 256)
    parts = None
    for b in range(n_blocks):
        hits = texts.select(digest.alias("key"), "text").mapInArrow(_scanner(block(b), False, True), f"key string, {FOUND}")
        hits = stored(hits.groupBy("key").agg(F.first("runs").alias("runs"), F.first("items").alias("items")), "bench-hits")
        parts = hits if parts is None else parts.union(hits)
    found = parts.groupBy(F.col("key").alias("__digest")).agg(
        F.flatten(F.collect_list("runs")).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return (texts.withColumn("__digest", digest).join(found, "__digest", "left")
            .select("key", "text", "runs", "items").mapInArrow(_joined(spans), schema))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return find_passages(docs, items, window=window, spans=False).select(
        F.col("key").alias("doc_id"), F.col("words").alias("n_words"), hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM cut),
lens AS (SELECT DISTINCT m FROM win),
place AS (SELECT row_id, w, unnest(generate_series(1, len(w))) AS i FROM low WHERE len(w) > 0),
seen AS (SELECT row_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM place JOIN lens ON i + m - 1 <= len(w)),
occ AS (SELECT row_id, i, seen.m AS m, item_id FROM seen JOIN win ON seen.win = win.win AND seen.m = win.m),
hit AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (
          SELECT row_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT row_id, i, m FROM occ)) GROUP BY row_id),
its AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
          SELECT DISTINCT row_id, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (row_id) LEFT JOIN its USING (row_id)
"""
