"""Language identification with a bidirectional gated recurrent network over bytes.

The network (one GRU layer in each direction) reads segments of ``SEGMENT``
bytes, labels every byte position, and a document's probabilities are the mean
of its positions' probabilities over the whole text, in segments, so a long
text needs no more memory than a short one. It is trained in numpy by
back-propagation through time (``train``).

Training data: a bounded sample, ``TRAIN_SEGMENTS`` segments for each language
at most (parameter ``per_language``), cut at hashed places of hashed
documents of the training side (crc32(doc_id) mod 4 is not 2) with a
language. Scoring reads only the text.

Defined results: null text, empty text or text without a letter: ``und`` with
score 0; so does every document when there is no labelled document. A null
doc_id is never held out, nor trained on. Extra columns are ignored; repeated
rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, whole_text

SEGMENT = 96
HIDDEN = 6
TRAIN_SEGMENTS = 2500
STEPS, BATCH, RATE = 450, 160, 0.02
PAD = 256  # input symbol after the end of a text
UNKNOWN = "und"
LETTER = r"\p{L}"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ------------------------------------------------------------------- network
# All arrays are feature-major, (features, segments): numpy then works on long
# contiguous rows however small the network is.
def init_model(n_langs: int, seed: int = 7) -> dict:
    import numpy as np
    rng = np.random.default_rng(seed)
    m = {}
    for d in "fb":  # forward, backward
        m["x" + d] = rng.normal(0, 0.3, (3 * HIDDEN, 257)).astype(np.float32)
        m["u" + d] = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32)
        m["o" + d] = rng.normal(0, 0.3, (n_langs, HIDDEN)).astype(np.float32)
    m["c"] = np.zeros((n_langs, 1), np.float32)
    return m


def _run(m: dict, d: str, codes, logit, keep: bool) -> list:
    """One direction over ``codes`` (T, B): adds its part of the logits (T, L, B)
    and, with keep, returns (t, state before, gates, candidate, state) a step."""
    import numpy as np
    t_len, n = codes.shape
    size = HIDDEN
    # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: the halves go into the weights
    x, u = m["x" + d].copy(), m["u" + d].copy()
    x[:2 * size] *= 0.5
    u[:2 * size] *= 0.5
    uzr, uc, o = u[:2 * size], u[2 * size:], m["o" + d]
    h = np.zeros((size, n), np.float32)
    p = np.empty((3 * size, n), np.float32)
    kept = []
    for t in (range(t_len) if d == "f" else range(t_len - 1, -1, -1)):
        np.take(x, codes[t], axis=1, out=p, mode="clip")
        zr = uzr @ h
        zr += p[:2 * size]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c = uc @ (zr[size:] * h)
        c += p[2 * size:]
        np.tanh(c, out=c)
        new = c - h
        new *= zr[:size]
        new += h
        if keep:
            kept.append((t, h, zr, c, new))
        h = new
        logit[t] += o @ h
    return kept


def position_probabilities(m: dict, codes):
    """(T, L, B): the probabilities of every position of the segments ``codes`` (T, B)."""
    import numpy as np
    logit = np.zeros((codes.shape[0], len(m["c"]), codes.shape[1]), np.float32)
    logit += m["c"]
    for d in "fb":
        _run(m, d, codes, logit, False)
    logit -= logit.max(axis=1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis=1, keepdims=True)
    return logit


def gradients(m: dict, codes, labels):
    """Loss (mean over positions that are text) and its gradient, through time."""
    import numpy as np
    t_len, n = codes.shape
    size = HIDDEN
    mask = (codes != PAD).astype(np.float32)
    total = max(mask.sum(), 1.0)
    logit = np.zeros((t_len, len(m["c"]), n), np.float32)
    logit += m["c"]
    kept = {d: _run(m, d, codes, logit, True) for d in "fb"}
    logit -= logit.max(axis=1, keepdims=True)
    g = np.exp(logit)
    g /= g.sum(axis=1, keepdims=True)
    own = np.arange(n)
    loss = -(np.log(g[:, labels, own] + 1e-9) * mask).sum() / total
    g[:, labels, own] -= 1
    g *= (mask / total)[:, None, :]
    grad = {k: np.zeros_like(v) for k, v in m.items()}
    grad["c"] = g.sum(axis=(0, 2))[:, None]
    flat = codes.reshape(-1)
    for d in "fb":
        u = m["u" + d]
        uzr, uc = u[:2 * size], u[2 * size:]
        carry = np.zeros((size, n), np.float32)
        gu, go = grad["u" + d], grad["o" + d]
        pre = np.empty((3 * size, t_len, n), np.float32)
        for t, h, zr, c, new in reversed(kept[d]):
            z, r = zr[:size], zr[size:]
            go += g[t] @ new.T
            dh = m["o" + d].T @ g[t] + carry
            dc = dh * z * (1 - c * c)
            drh = uc.T @ dc
            dzr = np.concatenate([dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)])
            carry = dh * (1 - z) + drh * r + uzr.T @ dzr
            gu[:2 * size] += dzr @ h.T
            gu[2 * size:] += dc @ (r * h).T
            pre[:2 * size, t], pre[2 * size:, t] = dzr, dc
        for k in range(3 * size):
            grad["x" + d][k] = np.bincount(flat, pre[k].reshape(-1), 257)
    return loss, grad


def train(segments: list, labels: list, n_langs: int, steps: int = STEPS, seed: int = 7) -> dict:
    """Adam on random batches; ``segments`` are bytes of at most SEGMENT."""
    import numpy as np
    codes, y = to_codes(segments), np.asarray(labels)
    m = init_model(n_langs, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    by_lang = [np.flatnonzero(y == k) for k in range(n_langs)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, max(1, BATCH // n_langs)) for own in by_lang])
        _, grad = gradients(m, codes[:, pick], y[pick])
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in m:
            g = np.clip(grad[k], -1, 1)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            m[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()}


def to_codes(segments: list):
    """(SEGMENT, n) input symbols, padded."""
    import numpy as np
    codes = np.full((len(segments), SEGMENT), PAD, np.intp)
    for i, s in enumerate(segments):
        codes[i, :len(s)] = np.frombuffer(s, np.uint8)
    return np.ascontiguousarray(codes.T)


# --------------------------------------------------------------------- Spark
def training_segments(docs: DataFrame, per_language: int = TRAIN_SEGMENTS) -> DataFrame:
    """(lang, segment): a hashed sample with ``per_language`` segments expected
    for each language. Every language is counted first; a document is taken
    with the same probability whatever its language's size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       whole_text().alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    share = F.lit(1.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)
    # several segments of one document where documents are few
    times = F.greatest(F.lit(1), F.least(F.lit(16), F.ceil(share))).cast("int")
    unit = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    raw = F.encode("text", "utf-8")
    room = F.greatest(F.octet_length("text") - SEGMENT + 1, F.lit(1))
    return (rows.where(unit < share)
            .where(F.col("text").rlike(LETTER))
            .withColumn("k", F.explode(F.sequence(F.lit(1), times)))
            .select("lang", F.substring(raw, F.pmod(F.xxhash64("doc_id", "k"), room.cast("long")).cast("int") + 1,
                                        F.lit(SEGMENT)).alias("segment")))


def fit(docs: DataFrame, per_language: int = TRAIN_SEGMENTS) -> tuple:
    """(languages, model); the sample is the only data that reaches the driver."""
    rows = sorted((r.lang, bytes(r.segment)) for r in training_segments(docs, per_language).toLocalIterator())
    langs = sorted({r[0] for r in rows})
    if not langs:
        return [], None
    return langs, train([s for _, s in rows], [langs.index(x) for x, _ in rows], len(langs))


def _scorer(langs: list, model):
    block = 2048  # segments at once

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            letters = batch.column("letters").to_pylist()
            total = np.zeros((len(texts), max(len(langs), 1)))
            owner, parts = [], []

            def flush():
                codes = to_codes(parts)
                p = position_probabilities(model, codes) * (codes != PAD)[:, None, :]
                np.add.at(total, owner, p.sum(axis=0).T)
                owner.clear()
                parts.clear()
            for i, t in enumerate(texts):
                if not letters[i] or not langs:
                    continue
                for k in range(0, len(t), SEGMENT):
                    owner.append(i)
                    parts.append(t[k:k + SEGMENT])
                    if len(parts) == block:
                        flush()
            if parts:
                flush()
            best = total.argmax(axis=1)
            share = total[np.arange(len(texts)), best] / np.maximum(total.sum(axis=1), 1e-12)
            known = total.sum(axis=1) > 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array([langs[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                "score": pa.array(np.where(known, share, 0.0), pa.float64())})
    return run


def predict(docs: DataFrame, langs: list, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the pooled probability) for every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       whole_text().alias("text")).withColumn("letters", F.col("text").rlike(LETTER))
    return rows.mapInArrow(_scorer(langs, model), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = TRAIN_SEGMENTS) -> DataFrame:
    langs, model = fit(docs, per_language)
    return predict(docs, langs, model)
