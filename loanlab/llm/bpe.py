"""Byte-level BPE encoding and decoding.

Method: a text is cut into words by the tokenizer's pattern; words are encoded
once, not once per occurrence. Spark higher-order functions fold the ranked
merges over the byte array of each distinct word, looking ranks up in a
literal rank map (``encode_words``): at every step the adjacent pair of lowest
rank is merged, leftmost first, until no pair has a rank. A word that has a
rank itself is one token, as in the public library that reads these rank
files. Decoding concatenates the binary pieces of the ids.

The dictionary of encoded words that goes to the tasks is bounded: about the
``DICTIONARY_WORDS`` most frequent words of at most ``MAX_WORD_BYTES`` bytes
(counted over the whole corpus; the count from which words go in is read off a
histogram of at most some hundred classes, and of the class at the edge a
share by hash goes in), so about ``DICTIONARY_WORDS * 5 * MAX_WORD_BYTES``
bytes at most, whatever the corpus holds. Any other word is merged in the task that meets it, by the
same rule (``merge_bytes``; from ``SHORT`` bytes on a heap over a linked list: n log n, so a
word of a megabyte is no trouble). Nothing is dropped and no text is shuffled.

Defined results: null text = empty text = no ids; the digest of no ids is that
of the empty string; a null doc_id stays null; repeated rows are encoded each;
extra columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, stored, whole_text

MAX_WORD_BYTES = 32
DICTIONARY_WORDS = 1 << 18
BUCKETS = 1 << 14
MEMO = 1 << 17
SHORT = 48
_NONE = 2 ** 31 - 1


def parse_ranks(raw: bytes) -> dict:
    """bytes -> rank of a rank file (one base64 piece and its rank per line)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def load_ranks(path: str) -> dict:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


# ---------------------------------------------------------------- Spark side
def rank_map(spark: SparkSession, ranks: dict) -> Column:
    """The ranks as one literal: an array of small maps, addressed by the CRC-32
    of a piece (a single literal map would be searched from end to end). Pieces
    are written in hexadecimal: joining two pieces joins their texts."""
    buckets: list = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.hex().upper()
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return _literal(spark, buckets, "array<map<string,int>>")


def _literal(spark: SparkSession, value, kind: str) -> Column:
    """``value`` as a literal that came through a session variable. Such a literal is one block
    of memory with a short name in plans; one written out would stand there as megabytes of
    text, which the driver keeps for every description of every plan."""
    name = f"loanlab_llm_{len(kind)}"  # one variable a kind: a later literal replaces it
    row = spark.createDataFrame([(json.dumps(value, separators=(",", ":")),)], "v string")
    stored(row.select(F.from_json("v", kind).alias("v")), "bpe-ranks").createOrReplaceTempView(name)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
    spark.sql(f"SET VARIABLE {name} = (SELECT v FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(name)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_words(spark: SparkSession, word: Column, ranks: dict) -> Column:
    """Token ids (array<int>) of one word, as a column expression.

    The fold's state holds the pieces and, for each adjacent pair, its rank; a
    merge looks up only the two ranks that it changes. The literal occurs once
    in the expression, so that a task's plan holds one copy of it."""
    return _let(rank_map(spark, ranks), lambda table: _folded(word, table))


def _folded(word: Column, table: Column) -> Column:
    nothing = F.array().cast("array<int>")

    def rank(piece: Column) -> Column:
        found = F.try_element_at(F.get(table, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")), piece)
        return F.coalesce(found, F.lit(_NONE))

    def pair_ranks(p: Column) -> Column:
        return F.when(F.size(p) > 1, F.transform(
            F.sequence(F.lit(1), F.size(p) - 1), lambda i: rank(F.concat(F.get(p, i - 1), F.get(p, i))))
        ).otherwise(nothing)

    def step(state: Column, _) -> Column:
        p, r = state["p"], state["r"]
        # rank and place of the best pair in one number: lowest rank, then leftmost
        best = F.array_min(F.transform(r, lambda x, i: x.cast("bigint") * (1 << 24) + i))

        def merge(b: Column) -> Column:
            i = (b % (1 << 24)).cast("int")  # place of the pair, from 0

            def put(new: Column) -> Column:
                left = F.when(i > 0, F.array(rank(F.concat(F.get(p, i - 1), new)))).otherwise(nothing)
                right = F.when(i + 1 < F.size(r), F.array(rank(F.concat(new, F.get(p, i + 2))))).otherwise(nothing)
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), i), F.array(new), F.slice(p, i + 3, F.size(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(i - 1, F.lit(0))), left, right,
                             F.slice(r, i + 3, F.size(r))).alias("r"))
            return _let(F.concat(F.get(p, i), F.get(p, i + 1)), put)
        over = F.coalesce(best, F.lit(_NONE << 24)) >= (_NONE << 24)
        return F.when(over, state).otherwise(_let(best, merge))

    text = F.hex(word.cast("binary"))
    n = F.octet_length(word)
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i * 2 - 1, F.lit(2)))
                    ).otherwise(F.array().cast("array<string>"))
    start = _let(pieces, lambda p: F.struct(p.alias("p"), pair_ranks(p).alias("r")))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step)
    whole = rank(text)
    return F.when(whole != _NONE, F.array(whole)).otherwise(F.transform(folded["p"], rank))


def decode_ids(spark: SparkSession, ids: Column, ranks: dict) -> Column:
    """Bytes of an id array as a column expression: its pieces, concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    table = _literal(spark, pieces, "array<string>")
    return _let(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


# ----------------------------------------------------------------- task side
def _merge_short(word: bytes, ranks: dict) -> list:
    """Ids of a short word: the lowest of all pair ranks is looked for anew after each merge."""
    get, piece = ranks.get, [word[i:i + 1] for i in range(len(word))]
    rank = [get(word[i:i + 2], _NONE) for i in range(len(word) - 1)]
    while rank:
        best = min(rank)
        if best == _NONE:
            break
        i = rank.index(best)  # the leftmost
        piece[i:i + 2] = [piece[i] + piece[i + 1]]
        del rank[i]
        if i:
            rank[i - 1] = get(piece[i - 1] + piece[i], _NONE)
        if i < len(rank):
            rank[i] = get(piece[i] + piece[i + 1], _NONE)
    return [ranks[p] for p in piece]


def merge_bytes(word: bytes, ranks: dict) -> list:
    """Ids of one word: the same merges, by a scan of the pairs of a short word, else with a heap
    over a linked list."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n == 0:
        return []
    if n <= SHORT:
        return _merge_short(word, ranks)
    piece = [word[i:i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i:i + 2])
        if r is not None:
            heap.append((r, i, 2))
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if piece[i] is None or nxt[i] >= n:
            continue
        j = nxt[i]
        if len(piece[i]) + len(piece[j]) != size:
            continue  # a pair that has changed since
        piece[i], piece[j] = piece[i] + piece[j], None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            both = piece[i] + piece[nxt[i]]
            r = ranks.get(both)
            if r is not None:
                heapq.heappush(heap, (r, i, len(both)))
        if prv[i] >= 0:
            both = piece[prv[i]] + piece[i]
            r = ranks.get(both)
            if r is not None:
                heapq.heappush(heap, (r, prv[i], len(both)))
    return [ranks[p] for p in piece if p is not None]


def _count_words(pattern: str):
    def run(batches):
        import pyarrow as pa
        import regex
        find = regex.compile(pattern).findall
        seen: Counter = Counter()

        def out():
            words = [w for w in seen if len(w) <= MAX_WORD_BYTES and len(w.encode()) <= MAX_WORD_BYTES]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()),
                                               "n": pa.array([seen[w] for w in words], pa.int64())})
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(find(text))
            if len(seen) > 500_000:  # partial sums; Spark adds them up
                yield out()
                seen.clear()
        yield out()
    return run


def _class(n: Column) -> Column:
    """Words of like frequency share a class: counts up to 64 exactly, then eighths of a doubling."""
    return F.when(n <= 64, n).otherwise(F.floor(F.log2(n.cast("double")) * 8).cast("long") + 16)


def frequent_words(counted: DataFrame, words: int = DICTIONARY_WORDS) -> DataFrame:
    """(word) of the most frequent of (word, n), about ``words`` of them: whole classes of
    frequency while they fit, and of the next class the share that fits, by hash."""
    left, least, share = words, 0, 0.0
    for k, n in sorted((tuple(r) for r in counted.groupBy(_class(F.col("n")).alias("k")).count().collect()), reverse=True):
        if n > left:
            least, share = k, left / n
            break
        left -= n
    of = _class(F.col("n"))
    unit = F.pmod(F.xxhash64("word", F.lit("dictionary")), F.lit(1 << 30)) / float(1 << 30)
    return counted.where((of > least) | ((of == least) & (unit < share))).select("word")


def word_dictionary(docs: DataFrame, ranks: dict, pattern: str, words: int = DICTIONARY_WORDS) -> DataFrame:
    """(word, ids) of the most frequent words of the corpus, ids by ``encode_words``."""
    counted = (docs.select(whole_text().alias("text"))
               .mapInArrow(_count_words(pattern), "word string, n long")
               .groupBy("word").agg(F.sum("n").alias("n")))
    top = stored(frequent_words(stored(counted, "bpe-counts"), words), "bpe-words")
    return stored(top.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism * 4), "word")
                  .select("word", encode_words(docs.sparkSession, F.col("word"), ranks).alias("ids")), "bpe-dictionary")


def _ipc(table) -> bytes:
    import pyarrow as pa
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


class _Words:
    """What a task knows of words: the ids of each as bytes of 32-bit numbers. Words beyond
    the dictionary are merged when they are met, and up to ``MEMO`` short ones are kept."""

    def __init__(self, ranks: dict, dictionary):
        import numpy as np
        self.ranks, self.memo, self.np = ranks, {}, np
        words, ids = dictionary.column("word").to_pylist(), dictionary.column("ids").combine_chunks()
        raw, ends = ids.flatten().to_numpy().astype(np.int32).tobytes(), np.cumsum([0, *ids.value_lengths().to_pylist()]) * 4
        ends = ends.tolist()
        self.known = {w: raw[i:j] for w, i, j in zip(words, ends, ends[1:], strict=False)}

    def _merged(self, word: str) -> bytes:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.np.asarray(merge_bytes(word.encode(), self.ranks), dtype=self.np.int32).tobytes()
            if len(word) <= MAX_WORD_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def ids(self, words: list):
        """The ids of consecutive words, one array."""
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._merged(w) if f is None else f for f, w in zip(found, words, strict=True)]
        return self.np.frombuffer(b"".join(found), dtype=self.np.int32)


class _Joined:
    """``values`` (bytes) joined by their numbers, as one gather of bytes instead of an object a number."""

    def __init__(self, values: list):
        import numpy as np
        self.np, self.flat = np, np.frombuffer(b"".join(values), np.uint8)
        self.size = np.array([len(v) for v in values], np.int64)
        self.first = self.size.cumsum() - self.size

    def __call__(self, numbers):
        size = self.size[numbers]
        at = self.np.repeat(self.first[numbers] - (size.cumsum() - size), size)
        at += self.np.arange(len(at))
        return self.flat[at]


def _encoder(pattern: str, ranks_b, dictionary_b, keep_ids: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex
        find = regex.compile(pattern).findall
        ranks = parse_ranks(ranks_b.value)
        known = _Words(ranks, pa.ipc.open_stream(dictionary_b.value).read_all())
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        decode, show = _Joined(pieces), _Joined([b"%d " % i for i in range(len(pieces))])
        for batch in batches:
            digests, decoded, ids = [], [], []
            for text in batch.column("text").to_pylist():
                own = known.ids(find(text))
                ids.append(own)
                digests.append(hashlib.sha256(show(own)[:-1]).hexdigest())  # without the last blank
                decoded.append(hashlib.sha256(decode(own)).hexdigest())
            sizes = np.array([len(x) for x in ids], np.int64)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes),
                   "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if keep_ids:
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                out["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_pydict(out)
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, words: int = DICTIONARY_WORDS,
           keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (digest of the
    decimal ids joined by blanks), decoded_sha256 (digest of the bytes that the
    ids decode to) and, with ``keep_ids``, the ids themselves."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    sc = spark.sparkContext
    # the dictionary passes the driver as Arrow, never as Python rows
    dictionary_b = sc.broadcast(_ipc(word_dictionary(docs, parse_ranks(ranks), pattern, words).toArrow()))
    ranks_b = sc.broadcast(ranks)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        _encoder(pattern, ranks_b, dictionary_b, keep_ids), schema + (", ids array<int>" if keep_ids else ""))
