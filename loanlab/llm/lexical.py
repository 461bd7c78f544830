"""Ranked lexical search by dense blocked BLAS multiplication.

Items are queries of terms; a document's score for an item is the sum, over
the item's terms, of an integer weight of the term times an integer impact of
the term in the document. Both sides are laid out as dense float64 tiles over
the compact vocabulary of the items: weights (items x terms) times impacts
(terms x documents), a BLAS product per pair of tiles. A tile of the
vocabulary is cut before the sum of any item's weights times the largest
possible impact reaches 2^53, so every product is an exact integer; tiles are
added up in 64-bit integers. Of each tile of documents only scores that reach
the item's k-th best so far go on, equal ones included, so ties are decided by
document id alone, whatever the tiles.

Scale: documents are read once per block of items and leave (id, length, terms
of the vocabulary with their counts) in the shared folder; document frequencies
are summed there. Items come in blocks of about ``ITEM_BLOCK`` items and
``ITEM_TERMS`` (item, term) pairs (counted before anything is sent); a task
returns k rows an item, merged first within slices of tasks, then per item.

Defined results: null and empty texts have no terms: such a document counts
nowhere, such an item has no rows; every row of the items is an item of its own, also where ids
repeat or are null; repeated documents are documents each; a null doc_id comes
after all others at equal score; extra columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, byte_pieces, stored, whole_text

TOP = 20
PIECE = 1 << 20
ITEM_BLOCK = 512
ITEM_TERMS = 1 << 14
TERM_TILE = 2048
DOC_TILE = 512
IMPACT = 1_000_000  # no impact is larger
EXACT = (1 << 53) - 1
SLICES = 64
SCHEMA = "item_id long, rank int, doc_id long, score long"


def _counter(vocabulary_b):
    """(id, text) -> id, n (terms in the text), terms and counts; of the vocabulary
    (positions), or of all terms (as text) without one."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa
        get = None if vocabulary_b is None else vocabulary_b.value.get
        for batch in batches:
            ns, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                n, seen = 0, Counter()
                for piece in byte_pieces(text.encode(), PIECE):
                    words = piece.split()
                    n += len(words)
                    seen.update(words if get is None else map(get, words))
                seen.pop(None, None)
                ns.append(n)
                found = sorted(seen)
                terms.append([t.decode() for t in found] if get is None else found)
                counts.append([seen[t] for t in found])
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n": pa.array(ns, pa.int64()),
                "terms": pa.array(terms, pa.list_(pa.string() if get is None else pa.int32())),
                "counts": pa.array(counts, pa.list_(pa.int64()))})
    return run


def _counted(table: DataFrame, id_col: str, vocabulary_b=None) -> DataFrame:
    kind = "string" if vocabulary_b is None else "int"
    return table.select(F.col(id_col).cast("long").alias("id"), whole_text().alias("text")).mapInArrow(
        _counter(vocabulary_b), f"id long, n long, terms array<{kind}>, counts array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_tiles(rows: list, n_terms: int, n_items: int, tile: int = TERM_TILE, exact: int = EXACT) -> list:
    """Tiles of the vocabulary: [(terms, items, places, weights)], the last three one entry a weight.

    rows: (term, item, weight) by term. Within a tile no item's weights sum to
    ``exact`` // IMPACT or more; a weight beyond that is dealt out to several tiles."""
    import numpy as np
    most = exact // IMPACT
    by_term: dict = {}
    for t, i, w in rows:
        by_term.setdefault(t, []).append((i, w))
    tiles, run, terms, entries = [], np.zeros(n_items, np.int64), [], []

    def close():
        nonlocal run, terms, entries
        if terms:
            items, places, weights = zip(*entries, strict=True)
            tiles.append((np.array(terms), np.array(items), np.array(places), np.array(weights, np.float64)))
        run, terms, entries = np.zeros(n_items, np.int64), [], []
    for t in sorted(by_term):
        left = by_term[t]
        while left:
            part = [(i, min(w, most)) for i, w in left]
            if len(terms) == tile or any(run[i] + w > most for i, w in part):
                close()
            entries += [(i, len(terms), w) for i, w in part]
            for i, w in part:
                run[i] += w
            terms.append(t)
            left = [(i, w - most) for i, w in left if w > most]
    close()
    return tiles


def impacts(tf, n, n_docs: int, length: int):
    """Integer impacts of counts ``tf`` in documents of ``n`` terms (arrays of one length)."""
    import numpy as np
    each, where = np.unique(n, return_inverse=True)
    m = np.array([75 + (25 * int(v) * n_docs) // length for v in each], np.int64)[where]
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def tile_scores(tiles: list, n_items: int, terms, docs, impact, n_docs_tile: int):
    """Exact scores (items x documents, int64) of one tile of documents, whose entries
    are (term, document, impact)."""
    import numpy as np
    scores = np.zeros((n_items, n_docs_tile), np.int64)
    for own, items, places, weights in tiles:
        at = np.searchsorted(own, terms)
        at[at == len(own)] = 0
        here = own[at] == terms
        active, row = np.unique(at[here], return_inverse=True)  # the terms of the tile that occur
        if not len(active):
            continue
        right = np.zeros((len(active), n_docs_tile))
        right[row, docs[here]] = impact[here]
        left = np.zeros((n_items, len(own)))
        left[items, places] = weights
        scores += (left[:, active] @ right).astype(np.int64)
    return scores


class _Best:
    """The k best (score, id) of every item so far; ties to the smaller id, null ids last."""

    def __init__(self, n_items: int, k: int):
        import numpy as np
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(n_items)]

    def add(self, scores, ids, nulls):
        import numpy as np
        rows, cols = np.nonzero(scores >= self.least[:, None])
        for i in np.unique(rows):
            c = cols[np.searchsorted(rows, i):np.searchsorted(rows, i, "right")]
            s, d, z = (np.concatenate(p) for p in zip(self.kept[i], (scores[i, c], ids[c], nulls[c]), strict=True))
            top = np.lexsort((d, z, -s))[:self.k]
            self.kept[i] = (s[top], d[top], z[top])
            if len(top) == self.k:
                self.least[i] = s[top][-1]


def _searcher(block_b, k: int, doc_tile: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        item_ids, tiles, n_docs, length = block_b.value
        best, held = _Best(len(item_ids), k), []

        def flush():
            if not held:
                return
            ids = pa.concat_arrays([b.column("id") for b in held])
            nulls = np.asarray(ids.is_null())
            n = np.concatenate([b.column("n").to_numpy() for b in held])
            sizes = np.concatenate([b.column("terms").value_lengths().to_numpy() for b in held])
            terms = np.concatenate([b.column("terms").flatten().to_numpy() for b in held])
            tf = np.concatenate([b.column("counts").flatten().to_numpy() for b in held])
            docs = np.repeat(np.arange(len(n)), sizes)
            impact = impacts(tf, n[docs], n_docs, length)
            best.add(tile_scores(tiles, len(item_ids), terms, docs, impact, len(n)),
                     ids.fill_null(0).to_numpy(), nulls)
            held.clear()
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= doc_tile:
                    flush()
        flush()
        piece = TaskContext.get().partitionId() % SLICES
        for i, (s, d, z) in enumerate(best.kept):
            if len(s):
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array(np.full(len(s), i), pa.int64()), "item_id": pa.array([item_ids[i]] * len(s), pa.int64()),
                    "doc_id": pa.array(d, pa.int64(), mask=z), "score": pa.array(s, pa.int64()),
                    "slice": pa.array(np.full(len(s), piece), pa.int64())})
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_block: int = ITEM_BLOCK, item_terms: int = ITEM_TERMS,
           doc_tile: int = DOC_TILE) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents with a score above 0 of every row of ``items``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = stored(_counted(items, "item_id").where("n > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    n_items, pairs = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_blocks = max(1, -(-n_items // item_block), -(-pairs // item_terms))
    block_of = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    found = None
    for b in range(n_blocks):
        own = list(asked.where(block_of == b).orderBy("item").toLocalIterator())
        if not own:
            continue
        part = _searched(docs, own, k, doc_tile).withColumn("block", F.lit(b))
        part = stored(part, "lexical-top") if n_blocks > 1 else part
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    within = Window.partitionBy("block", "item", "slice").orderBy(*order)
    overall = Window.partitionBy("block", "item").orderBy(*order)
    return (found.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def _searched(docs: DataFrame, own: list, k: int, doc_tile: int) -> DataFrame:
    """(item, item_id, doc_id, score, slice): each task's best documents for a block of items."""
    sc = docs.sparkSession.sparkContext
    vocabulary = {t.encode(): j for j, t in enumerate(sorted({t for r in own for t in r.terms}))}
    counted = stored(_counted(docs, "doc_id", sc.broadcast(vocabulary)), "doc-terms")
    n_docs, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row a term of the block
    weights = []
    for i, r in enumerate(own):
        for t, c in zip(r.terms, r.counts, strict=True):
            j = vocabulary[t.encode()]
            if j in df:
                weights.append((j, i, c * weight(n_docs, df[j])))
    tiles = term_tiles([x for x in weights if x[2] > 0], len(vocabulary), len(own))
    value = ([r.id for r in own], tiles, n_docs, length)
    return counted.where(F.size("terms") > 0).select("id", "n", "terms", "counts").mapInArrow(
        _searcher(sc.broadcast(value), k, doc_tile), "item long, item_id long, doc_id long, score long, slice long")


ORACLE = r"""
WITH dt AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tf AS (SELECT row_id, t, count(*) AS tf FROM (SELECT row_id, unnest(w) AS t FROM dt) GROUP BY row_id, t),
tot AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM dt),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, tot),
it AS (SELECT item_row, any_value(item_id) AS item_id, t, count(*) AS c FROM (
         SELECT item_id, row_number() OVER () AS item_row, unnest(regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
       GROUP BY item_row, t),
m AS (SELECT row_id, doc_id, 100 - 25 + (25 * len(w) * n) // l AS m FROM dt, tot WHERE len(w) > 0),
sc AS (SELECT item_row, any_value(it.item_id) AS item_id, tf.row_id, any_value(m.doc_id) AS doc_id,
         CAST(sum(c * wt.w * ((1000000000 * tf) // (1000 * tf + 12 * m.m))) AS BIGINT) AS score
       FROM it JOIN tf USING (t) JOIN wt USING (t) JOIN m ON m.row_id = tf.row_id GROUP BY item_row, tf.row_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank
      FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
