"""Quality rules with host-level verdicts (DataFrame and SQL functions only).

Per document: word, symbol, duplicate-line and repeated-window counts and the
base rules. Per host (``source``): for each rule the share of its documents
that fail, shrunk towards all hosts' mean with a beta prior whose strength is
fitted to the hosts' rates by moments; a host whose shrunk rate of any rule is
above ``MAX_RATE`` is rejected, and the verdict is joined back to its
documents. A document is kept if it passes the base rules and its host is not
rejected.

Scale: texts are read once and never shuffled; the counts are written to the
shared checkpoint folder. Failures are summed before the shuffle, so a host
with a third of all documents is one row by then; the join back is an
equi-join that Spark broadcasts by size or splits where skewed.

Defined results: null or empty text counts as no words (fails the base rule);
a null source has no host and is judged on its own; null doc_ids and repeated
rows are counted and returned as they are; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, stored, whole_text

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_RATE = 0.5
DEFAULT_STRENGTH = 10.0  # prior strength where the hosts' rates do not vary
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that occur twice or more."""
    last = F.size(words) - WINDOW  # last window's start, from 0

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(F.slice(starts, F.lit(2), F.size(starts) - 1),
                          F.slice(starts, F.lit(1), F.size(starts) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)

    def exact(windows: Column) -> Column:
        """windows: (text, start) sorted; equal texts are neighbours."""
        n = F.size(windows)
        same = F.zip_with(F.slice(windows, F.lit(1), n - 1), F.slice(windows, F.lit(2), n - 1),
                          lambda a, b: a["g"] == b["g"])

        def starts(eq: Column) -> Column:
            either = F.zip_with(F.concat(F.array(F.lit(False)), eq), F.concat(eq, F.array(F.lit(False))),
                                lambda x, y: x | y)
            hit = F.zip_with(windows, either, lambda w, e: F.when(e, w["i"]))
            return F.array_sort(F.filter(hit, lambda i: i.isNotNull()))
        return _let(same, lambda eq: _let(starts(eq), lambda s: F.when(F.size(s) > 0, covered(s)).otherwise(0)))

    at = F.sequence(F.lit(0), last)
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW))))
    # equal windows have equal hashes: most texts need no more than this test
    some = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    full = F.array_sort(F.transform(at, lambda i: F.struct(
        F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("g"), i.alias("i"))))
    return F.when(last < 1, F.lit(0)).when(some, _let(full, exact)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of the base rules for every row."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        whole_text().alias("text"))
            .select("doc_id", "source", "text", words.alias("words")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    return rows.select(
        "doc_id", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"))


def rule_failures() -> dict:
    """Rule name -> whether a row of ``measure`` fails it."""
    return {"few_words": F.col("n_words") < MIN_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")}


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, host_rejected): shrunk failure rates against ``max_rate``."""
    rules = rule_failures()
    hosts = stored(measured.where("source is not null").groupBy("source").agg(
        F.count("*").alias("n"), *[F.sum(fails.cast("long")).alias(r) for r, fails in rules.items()]), "hosts")
    rates = hosts.select(*[(F.col(r) / F.col("n")).alias(r) for r in rules])
    moments = rates.agg(*[f(r).alias(f"{k}_{r}") for r in rules for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    bad = F.lit(False)
    for r in rules:
        mean, var = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        strength = max(mean * (1 - mean) / var - 1, 1.0) if var > 1e-12 else DEFAULT_STRENGTH
        bad = bad | ((F.col(r) + mean * strength) / (F.col("n") + strength) > max_rate)
    return hosts.select("source", bad.alias("host_rejected"))


def apply_rules(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Counts, base_failed, host_rejected and kept for every row of ``docs``."""
    measured = stored(measure(docs), "quality")
    verdicts = stored(host_verdicts(measured, max_rate), "host-verdicts")
    failed = F.lit(False)
    for fails in rule_failures().values():
        failed = failed | fails
    rejected = F.coalesce("host_rejected", F.lit(False))
    return (measured.join(verdicts, "source", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~rejected).alias("kept")))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM r) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON c.rid = w.rid),
f AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2 FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(f1 AS INT)) AS s1, sum(CAST(f2 AS INT)) AS s2
      FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(s1 / n) AS m1, var_pop(s1 / n) AS v1, avg(s2 / n) AS m2, var_pop(s2 / n) AS v2 FROM h),
q AS (SELECT m1, m2, CASE WHEN v1 > 1e-12 THEN greatest(m1 * (1 - m1) / v1 - 1, 1.0) ELSE 10.0 END AS k1,
        CASE WHEN v2 > 1e-12 THEN greatest(m2 * (1 - m2) / v2 - 1, 1.0) ELSE 10.0 END AS k2 FROM p),
b AS (SELECT source, (s1 + m1 * k1) / (n + k1) > 0.5 OR (s2 + m2 * k2) / (n + k2) > 0.5 AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND NOT coalesce(b.bad, false) AS kept
FROM f LEFT JOIN b ON b.source = f.source
"""
