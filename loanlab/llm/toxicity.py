"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Model: P(grade <= k | x) = sigmoid(theta_k - w.x) with one weight vector for
all ordered thresholds (proportional odds). Features are the words of the text
(letters and digits, lower case) and their first 4 to 6 letters, of which
those are used that the labels tie to toxicity (``vocabulary``); a feature's
value is 1 + ln(occurrences).

Grades come from ``labels``: 0 for toxic = 0; a toxic document has grade 2 if
it has more than the median number of occurrences of the words that the labels
tie to toxicity (smoothed log odds over ``STRONG``), and grade 1 otherwise. The
result is the expected severity, sum of k P(grade = k), and a document is
``toxic`` if P(grade >= 1) is at least ``THRESHOLD``.

The model is fitted on a bounded sample: ``TRAIN_DOCS`` labelled documents of
each class at most, expected (hashed by doc_id). Everything else reads all
documents. Fitting is full-batch gradient descent with momentum on the driver
over that sample; only the sample's word counts reach it.

Defined results: null or empty text has no features and gets the grade of the
thresholds alone; without a labelled document of each class nothing is toxic
(severity 0); several labels of one document count as its highest; labels
without document and null ids or labels are ignored; repeated rows are scored
each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, stored, whole_text

TRAIN_DOCS = 6000
MIN_DOCS = 3
MIN_Z = 3.0
MAX_FEATURES = 8192
PREFIXES = (4, 5, 6)
STRONG = 2.0
GRADES = 3
THRESHOLD = 0.5
STEPS, RATE, RIDGE = 400, 2.0, 3e-4
_WORD = r"[^\W_]+"


def feature_counts(text: str, known=None) -> dict:
    """Occurrences of the text's features: words, and their first letters
    (``PREFIXES``; written with a star). With ``known`` only those of it."""
    import re
    words: dict = {}
    for w in re.findall(_WORD, text.lower()):
        words[w] = words.get(w, 0) + 1
    out: dict = {}
    for w, n in words.items():
        if known is None or w in known:
            out[w] = out.get(w, 0) + n
        for k in PREFIXES:
            if len(w) <= k:
                break
            f = w[:k] + "*"
            if known is None or f in known:
                out[f] = out.get(f, 0) + n
    return out


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, toxic, text): a hashed sample, ``per_class`` rows expected of each class."""
    known = (labels.where("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for cls, n in counts.items():
        share = F.when(F.col("toxic") == cls, F.lit(per_class / n)).otherwise(share)
    unit = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where("toxic in (0, 1)").where(unit < share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # the picked labels are a bounded sample (``per_class`` expected of each class): texts stay in place
    return rows.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"])


def _document_counts(batches):
    """Per batch: the documents of each class that have a feature."""
    from collections import Counter

    import pyarrow as pa
    for batch in batches:
        seen = (Counter(), Counter())
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            seen[toxic].update(feature_counts(text).keys())
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()),
                                          "clean": pa.array([seen[0][f] for f in names], pa.int64()),
                                          "toxic": pa.array([seen[1][f] for f in names], pa.int64())})


def vocabulary(sample: DataFrame) -> list:
    """The ``MAX_FEATURES`` features that the labels tie to toxicity most: z
    score (smoothed log odds over their standard error) above ``MIN_Z``, in at
    least ``MIN_DOCS`` toxic documents."""
    size = {r.toxic: float(r.n) for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = sample.select("toxic", "text").mapInArrow(
        _document_counts, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    def logit(n, total):
        return F.log((n + 0.5) / (total - n + 0.5))
    odds = logit(F.col("toxic"), size.get(1, 0.0)) - logit(F.col("clean"), size.get(0, 0.0))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = (counts.where(F.col("toxic") >= MIN_DOCS).withColumn("z", z).where(F.col("z") > MIN_Z)
           .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES))
    return sorted(r.feature for r in top.select("feature").collect())


def _counted(vocab: dict):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            counts = [feature_counts(t, vocab) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column("toxic"),
                "cols": pa.array([[vocab[f] for f in c] for c in counts], pa.list_(pa.int32())),
                "times": pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))})
    return run


def grades(toxic, at, col, times, size: int):
    """Grade of every sampled row (see the module's text) from the 0/1 labels."""
    import numpy as np
    pos, neg = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    in_pos = np.bincount(col, toxic[at], size)
    in_neg = np.bincount(col, 1 - toxic[at], size)
    odds = np.log((in_pos + 0.5) / (pos + 1.0)) - np.log((in_neg + 0.5) / (neg + 1.0))
    strong = odds > STRONG
    hits = np.bincount(at, np.where(strong[col], times, 0), len(toxic))
    middle = np.median(hits[toxic == 1])
    return np.where(toxic == 1, np.where(hits > middle, 2, 1), 0)


def _sigmoid(x):
    import numpy as np
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(grade, weight, at, col, val, size: int, steps: int = STEPS):
    """(w, theta): maximum likelihood of the proportional-odds model. The
    thresholds stay ordered: theta_k = theta_0 + the sum of exp(gap)."""
    import numpy as np
    n = len(grade)
    w, theta0, gaps = np.zeros(size), 0.0, np.zeros(GRADES - 2)
    vw, vt, vg = np.zeros(size), 0.0, np.zeros(GRADES - 2)
    weight = weight / weight.sum()
    rows = np.arange(n)
    for _ in range(steps):
        theta = np.concatenate([[-np.inf], theta0 + np.concatenate([[0], np.cumsum(np.exp(gaps))]), [np.inf]])
        s = np.bincount(at, w[col] * val, n)
        cum = np.empty((n, GRADES + 1))  # P(grade < k)
        cum[:, 0], cum[:, -1] = 0, 1
        cum[:, 1:-1] = _sigmoid(theta[1:-1][None, :] - s[:, None])
        slope = cum * (1 - cum)
        low, high = slope[rows, grade], slope[rows, grade + 1]
        p = np.maximum(cum[rows, grade + 1] - cum[rows, grade], 1e-9)
        ds = weight * (high - low) / p  # of the negative log likelihood by s
        dtheta = np.zeros(GRADES + 1)
        np.add.at(dtheta, grade + 1, -weight * high / p)
        np.add.at(dtheta, grade, weight * low / p)
        gw = np.bincount(col, ds[at] * val, size) + RIDGE * w
        gt = dtheta[1:-1].sum()
        gg = np.array([dtheta[k + 2:-1].sum() for k in range(GRADES - 2)]) * np.exp(gaps)
        vw = 0.9 * vw - RATE * gw
        vt = 0.9 * vt - RATE * 0.5 * gt
        vg = 0.9 * vg - RATE * 0.5 * gg
        w, theta0, gaps = w + np.clip(vw, -0.5, 0.5), theta0 + vt, np.clip(gaps + vg, -5, 3)
    return w, theta0 + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS):
    """(weights by word, thresholds), or (None, None) if a class is missing."""
    import numpy as np
    bounded_batches(docs.sparkSession)
    sample = stored(training_rows(docs, labels, per_class), "toxicity-sample")
    vocab = {f: i for i, f in enumerate(vocabulary(sample))}
    counted = sample.select("toxic", "text").mapInArrow(_counted(vocab), "toxic int, cols array<int>, times array<int>")
    rows = sorted((r.toxic, r.cols, r.times) for r in counted.toLocalIterator())
    toxic = np.array([r[0] for r in rows], np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None, None
    at = np.array([i for i, r in enumerate(rows) for _ in r[1]], np.int32)
    col = np.array([k for r in rows for k in r[1]], np.int32)
    times = np.array([n for r in rows for n in r[2]], np.float64)
    grade = grades(toxic, at, col, times, len(vocab))
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    w, theta = fit_ordinal(grade, weight, at, col, 1 + np.log(np.maximum(times, 1)), len(vocab))
    return {word: float(w[k]) for word, k in vocab.items()}, [float(x) for x in theta]


def _grader(weights, theta):
    def run(batches):
        import math

        import pyarrow as pa

        def below(x):
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))
        for batch in batches:
            severity, grade, p_toxic = [], [], []
            for text in batch.column("text").to_pylist():
                if weights is None:
                    severity.append(0.0)
                    grade.append(0)
                    p_toxic.append(0.0)
                    continue
                s = sum(weights[f] * (1 + math.log(n)) for f, n in feature_counts(text, weights).items())
                over = [1 - below(t - s) for t in theta]  # P(grade > k)
                severity.append(sum(over))
                p_toxic.append(over[0])
                probs = [1 - over[0]] + [a - b for a, b in zip(over, over[1:])] + [over[-1]]
                grade.append(max(range(len(probs)), key=lambda k: (probs[k], -k)))
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in batch.schema.names if c != "text"},
                "expected_severity": pa.array(severity, pa.float64()), "grade": pa.array(grade, pa.int32()),
                "p_toxic": pa.array(p_toxic, pa.float64())})
    return run


def score(docs: DataFrame, weights, theta) -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic, toxic and kept (not toxic) for every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = rows.mapInArrow(_grader(weights, theta),
                             "doc_id long, expected_severity double, grade int, p_toxic double")
    toxic = F.col("p_toxic") >= THRESHOLD
    return scored.select("*", toxic.alias("toxic"), (~toxic).alias("kept"))


def _filter(weights, theta):
    grader = _grader(weights, theta)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            text = batch.column("text")
            seen = pa.RecordBatch.from_pydict({"text": pc.fill_null(text, "")})
            for out in grader(iter([seen])):
                yield batch.filter(pc.less(out.column("p_toxic"), THRESHOLD))
    return run


def drop_toxic(docs: DataFrame, weights, theta) -> DataFrame:
    """The rows of ``docs`` that are not toxic, unchanged; texts are not shuffled."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_filter(weights, theta), docs.schema)
