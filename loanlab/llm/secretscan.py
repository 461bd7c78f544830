r"""Secret scans with a trigram inverted index (DataFrame and SQL functions only).

From each rule's regular expression a Boolean query over trigrams is derived
(``trigram_query``): a run of literals, small alternations and optional
characters has a finite set of texts; every match holds one of them, and so
all trigrams of one of them. For the trigrams that occur in the rules' queries
an inverted index is built (``postings``: trigram, doc_id; trigrams of the
lower-cased text, so the same postings serve rules in either case). A rule's
candidates are found by intersecting postings: a document needs every trigram
of one alternative. Only candidates are searched by the regular expression; a
rule without mandatory trigrams (``hex``) searches every text.

A rule's matches are leftmost and not overlapping; matches that fail its
length test are dropped afterwards. Base rules: assign, access, hex. Added by
this method: pem (private key headers), ghtoken, slack. Spans are code points,
end exclusive.

Scale: postings combine per document (never per trigram: a trigram may occur
in a third of all documents); documents are looked up by id.

Defined results: null text counts as empty and has no spans; rows with null
doc_id or a repeated one are scanned each on their own (rows carry a key made
from id, text and place among equals where needed); extra columns are
ignored by ``scan`` and kept by ``redact``; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, whole_text


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str           # the same meaning in Java and Python
    min_length: int = 0  # code points of ``measured``
    measured: int = 0    # group
    fold: bool = False   # letters in either case
    base: bool = False


# FIXED VALUES: the base rules of the contract; the others are public formats. Where a
# match is one run of a class, its least length stands in the expression: a run that is too
# short holds no other match. ``assign`` consumes what it drops, so its length is tested after.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         6, 2, fold=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
MAX_TEXTS = 64  # texts of a run; more say nothing


# --------------------------------------------------------- trigram derivation
def _texts(node) -> set | None:
    """All texts that a parsed node matches, or None if not a small finite set."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out = set()
        for kind, value in arg:
            if str(kind) != "LITERAL":
                return None
            out.add(chr(value).lower())
        return out
    if op == "SUBPATTERN":
        return _sequence_texts(arg[3])
    if op == "BRANCH":
        sets = [_sequence_texts(b) for b in arg[1]]
        return None if any(s is None for s in sets) else set().union(*sets)
    if op == "MAX_REPEAT" and arg[1] <= 1:
        inner = _sequence_texts(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence_texts(nodes) -> set | None:
    out = {""}
    for node in nodes:
        texts = _texts(node)
        if texts is None:
            return None
        out = {a + b for a in out for b in texts}
        if len(out) > MAX_TEXTS:
            return None
    return out


def _trigrams(text: str) -> frozenset:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> list:
    """A list of alternatives, each a set of lower-case trigrams of which a
    match holds all; [] if the expression has no mandatory trigram. Of several
    runs the one with the fewest alternatives is taken."""
    from re import _parser  # the standard library's own reading of the expression
    runs, run = [], {""}
    for node in list(_parser.parse(regex)) + [None]:
        texts = None if node is None else _texts(node)
        if texts is not None and len(run) * len(texts) <= MAX_TEXTS:
            run = {a + b for a in run for b in texts}
        else:
            runs.append(run)
            run = texts if texts is not None else {""}
    queries = []
    for texts in runs + [run]:
        sets = {_trigrams(t) for t in texts}
        if frozenset() in sets:
            continue
        # an alternative that needs more than another adds nothing
        queries.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return min(queries, key=len) if queries else []


def postings(docs: DataFrame, key: str, trigrams) -> DataFrame:
    """(trigram, key) for each of ``trigrams`` that a text holds."""
    low = docs.select(key, F.lower("text").alias("low"))  # once, not once per trigram
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))
    return low.select(F.explode(held).alias("trigram"), F.col(key))


def candidates(docs: DataFrame, key: str, rules) -> DataFrame:
    """(key, kinds): documents that a rule's Boolean query admits."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    needed = {t for q in queries.values() for alt in q for t in alt}
    if not needed:
        return docs.select(key).where("false").withColumn("kinds", F.array().cast("array<string>"))
    found = postings(docs, key, needed).groupBy(key).agg(F.collect_set("trigram").alias("have"))
    admits = [F.when(_any_of(q), F.lit(kind)) for kind, q in sorted(queries.items()) if q]
    return (found.select(key, F.filter(F.array(*admits), lambda k: k.isNotNull()).alias("kinds"))
            .where(F.size("kinds") > 0))


def _any_of(query) -> Column:
    out = F.lit(False)
    for alt in query:
        out = out | (F.size(F.array_except(F.array(*[F.lit(t) for t in sorted(alt)]), F.col("have"))) == 0)
    return out


# ----------------------------------------------------------------- the search
def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches in ``text``. The places
    come from the pieces between the matches."""
    pattern = ("(?i)" if rule.fold else "") + rule.regex

    def places(both: Column) -> Column:
        found, between = both["found"], both["between"]
        sizes = F.transform(found, lambda m, i: F.struct(
            F.length(F.get(between, i)).alias("gap"), F.length(m).alias("size"),
            F.length(F.get(both["measured"], i)).alias("measured")))
        walk = F.aggregate(
            sizes, F.struct(F.lit(0).alias("at"), F.array().cast(
                "array<struct<start:int,end:int,measured:int>>").alias("out")),
            lambda acc, s: F.struct((acc["at"] + s["gap"] + s["size"]).alias("at"), F.concat(acc["out"], F.array(
                F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end"),
                         s["measured"].alias("measured")))).alias("out")))
        good = F.filter(walk["out"], lambda s: s["measured"] >= rule.min_length)
        return F.transform(good, lambda s: F.struct(s["start"], s["end"]))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between"),
                    (F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.measured)) if rule.measured else found
                     ).alias("measured"))
    return F.when(text.rlike(pattern), _let(both, places)).otherwise(
        F.array().cast("array<struct<start:int,end:int>>"))


def find_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) with ``__llm_spans``: array<struct<
    start, kind_no, end>> of all rules, sorted. Texts must not be null."""
    for r in rules:
        if (re.compile(r.regex).groups or 0) < r.measured:
            raise ValueError(f"rule {r.kind} has no group {r.measured}")
    indexed = [r for r in rules if trigram_query(r.regex)]
    # what is scanned again is looked up by a hash of id and text: null and repeated ids are no trouble
    keyed = docs.withColumn("__llm_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    wanted = stored(candidates(keyed, "__llm_key", indexed).withColumnRenamed("kinds", "__llm_kinds"), "secret-index")
    joined = keyed.join(wanted, "__llm_key", "left")

    def spans(no: int, rule: Rule) -> Column:
        found = F.transform(spans_of(F.col("text"), rule), lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end")))
        if rule not in indexed:
            return found
        return F.when(F.array_contains("__llm_kinds", rule.kind), found).otherwise(
            F.array().cast("array<struct<start:int,kind_no:int,end:int>>"))
    every = F.array_sort(F.flatten(F.array(*[spans(i, r) for i, r in enumerate(rules)])))
    return joined.withColumn("__llm_spans", every).drop("__llm_key", "__llm_kinds")


def _shown(spans: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, counts of the base rules, digest of the base spans and all spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = find_spans(rows, rules).select("doc_id", F.col("__llm_spans").alias("s"))
    base_no = [i for i, r in enumerate(rules) if r.base]
    base = F.filter("s", lambda s: s["kind_no"].isin(base_no))

    def count(no: int) -> Column:
        return F.size(F.filter("s", lambda s: s["kind_no"] == no)).cast("long").alias(f"n_{rules[no].kind}")
    counts = [count(i) for i in base_no]
    return found.select("doc_id", *counts, F.sha2(_shown(base, rules), 256).alias("base_sha256"),
                        _shown(F.col("s"), rules).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs``, every span (overlapping ones as one) replaced by
    ``mark``; ``n_chars``, if there, follows the new text. Null texts stay null."""
    columns = docs.columns
    whole = docs.withColumn("__llm_null", F.col("text").isNull()).withColumn("text", whole_text())
    found = find_spans(whole, rules)

    def cut(text: Column, spans: Column) -> Column:
        walk = F.aggregate(
            spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
                s["end"].alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.concat(
                    F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))))).otherwise(acc["out"]).alias("out"))))
        return _let(walk, lambda w: F.concat(F.array_join(w["out"], ""), F.substr(text, w["at"] + 1)))
    text = F.when(F.col("__llm_null"), None).when(F.size("__llm_spans") > 0, cut(F.col("text"), F.col("__llm_spans"))
                                                  ).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("__llm_spans") > 0, F.length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return out.select(*columns)
