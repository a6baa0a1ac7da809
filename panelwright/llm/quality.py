"""Quality rules whose cut-offs are certified on labelled holdouts. All columns are Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize

_SYMBOLS = "#*$%&|<>"
#: Bits for a word's position below the hash of its window.
_BITS = 28


def _bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column, k: int = 3) -> Column:
    """How many words lie in k-word windows that occur twice or more, the first occurrence included.

    Windows are sorted by 36 bits of a hash with their position, so equal ones are neighbours. If neighbours of equal
    bits are found to be of different words, the windows of that text are sorted by their words instead.
    """
    low = F.lit((1 << _BITS) - 1)

    def count(w: Column) -> Column:
        n = F.size(w) - k + 1
        every = F.sequence(F.lit(0), n - 1)
        packed = F.sort_array(F.transform(every, lambda i: F.shiftleft(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), _BITS).bitwiseOR(i.cast("long"))))
        place = lambda x: x.bitwiseAND(low).cast("int")
        bits = lambda x: F.shiftright(x, _BITS)

        def differ(x: Column, y: Column) -> Column:
            other = F.lit(False)
            for j in range(k):
                other = other | (F.get(w, place(x) + j) != F.get(w, place(y) + j))
            return (bits(x) == bits(y)) & other

        def covered(starts: Column) -> Column:
            return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (k - 1)))))))

        def twice(s: Column, same) -> Column:
            return F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))

        def by_words() -> Column:
            named = F.array_sort(F.transform(every, lambda i: F.struct(F.array_join(F.slice(w, i + 1, k), " ").alias("g"), i.alias("i"))))
            return _bind(named, lambda s: F.transform(twice(s, lambda x, y: x["g"] == y["g"]), lambda x: x["i"]))

        def starts(s: Column) -> Column:
            clash = F.exists(F.sequence(F.lit(0), n - 2), lambda i: differ(F.get(s, i), F.get(s, i + 1)))
            return F.when(clash, by_words()).otherwise(F.transform(twice(s, lambda x, y: bits(x) == bits(y)), place))

        return F.when(n < 2, F.lit(0)).otherwise(_bind(packed, lambda s: _bind(starts(s), covered)))

    return _bind(words, count).cast("long")


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = t
    for c in _SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_words(w).alias("r"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    got = docs.select(*keep, (F.length(t) - F.length(bare)).cast("long").alias("n_symbols"), _bind(_words(t), of_words).alias("w_"), _bind(lines, of_lines).alias("l_"))
    return got.select(*keep, F.col("w_.n").alias("n_words"), F.col("w_.c").alias("word_chars"), "n_symbols", F.col("l_.n").alias("n_lines"), F.col("l_.d").alias("n_dup_lines"), F.col("w_.r").alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose ``value`` lies above the cut-off; the possible cut-offs are fixed beforehand."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


#: What the rules measure, and the cut-offs that may be certified.
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0)),
    Rule("short_words", "-word_chars / greatest(n_words, 1)", (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5)),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
)


@dataclass(frozen=True)
class Risk:
    """With probability ``1 - delta``, for every stratum at once, the rules together reject at most the share
    ``alpha`` of the good documents. Each of the strata gets an equal part of ``delta``; ``tune`` is the share of the
    labelled documents that only decide the order of the tests."""

    alpha: float = 0.02
    delta: float = 0.05
    tune: float = 1 / 3
    rules: tuple[Rule, ...] = field(default=RULES)


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n and p, summed term by term."""
    import math

    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)
    zero = F.struct(first.cast("double").alias("t"), F.exp(first).cast("double").alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, zero, step, lambda acc: acc["s"])


def certified_cutoffs(labelled: DataFrame, risk: Risk) -> DataFrame:
    """``stratum`` and one column ``cut_<rule>`` for each rule: the strictest certified cut-off; null if there is none.

    ``labelled``: the counts of labelled documents with ``stratum``, ``good`` (boolean) and ``tune`` (boolean). A step
    is a cut-off of a rule. The ``tune`` documents of a stratum put the steps in order, by good documents rejected for
    each bad one (steps that reject no bad one are left out, if there are bad ones). The other documents then test the
    steps in that order, each together with those before it: it is certified if so few good documents rejected by any of them have at
    most the stratum's part of ``delta`` of probability at a rate of ``alpha`` (an exact binomial bound on the rules' joint
    rate). The first step that isn't certified ends the row of tests, so within a stratum no further correction is due.

    Without a single false rejection a stratum needs ``log(delta / strata) / log(1 - alpha)`` good test documents: 217 for 4
    strata at the default values, so 325 good labelled ones in all.
    """
    steps = [(r, c) for r in risk.rules for c in r.cutoffs]
    rejects = [F.expr(f"{r.value} > {c!r}D") for r, c in steps]
    good, bad = F.col("good"), ~F.col("good")
    sums = [F.struct(F.count_if(x & good).alias("g"), F.count_if(x & bad).alias("b"), F.lit(i).alias("step")) for i, x in enumerate(rejects)]
    tuned = labelled.filter("tune").groupBy("stratum").agg(F.array(*sums).alias("x"), F.count_if(bad).alias("bad"))
    useful = F.filter("x", lambda y: (y["b"] > 0) | (F.col("bad") == 0))
    ranked = F.array_sort(F.transform(useful, lambda y: F.struct((y["g"] / F.greatest(y["b"], F.lit(1))).alias("cost"), (-y["b"]).alias("b"), y["step"].alias("step"))))
    order = materialize(tuned.select("stratum", F.transform(ranked, lambda y: y["step"]).alias("order")), "rule-order")
    test = labelled.filter(good & ~F.col("tune")).join(order, "stratum")
    first = F.least(F.lit(len(steps) + 1), *[F.when(x, F.nullif(F.array_position("order", i), F.lit(0))) for i, x in enumerate(rejects)])
    counts = [F.count_if(F.col("first") <= j) for j in range(1, len(steps) + 1)]
    counted = materialize(test.withColumn("first", first).groupBy("stratum", "order").agg(F.count("*").alias("n"), F.array(*counts).alias("k")), "rule-counts")
    level = risk.delta / max(1, counted.count())
    # What is rejected grows from step to step, so the steps certified are those up to the last that passes.
    passes = lambda k: (k < F.col("n") * risk.alpha) & (binomial_at_most(k, F.col("n"), risk.alpha) <= level)
    passed = counted.withColumn("last", F.size(F.filter("k", passes)))
    cuts = []
    for r in risk.rules:
        mine = [F.when(F.array_position("order", i).between(1, F.col("last")), F.lit(float(c))) for i, (q, c) in enumerate(steps) if q is r]
        cuts.append((F.least(*mine) if len(mine) > 1 else mine[0]).alias(f"cut_{r.name}"))
    return materialize(passed.select("stratum", *cuts), "cutoffs")


def labelled_counts(counts: DataFrame, labels: DataFrame, risk: Risk, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """What :func:`certified_cutoffs` needs of the labelled documents that pass the base check; a fixed random share of the ids orders the tests."""
    known = labels.groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(label) == 1).alias("good")).filter("good is not null")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("tune")), F.lit(1_000_003)) < F.lit(int(risk.tune * 1_000_003))
    return counts.filter("not base_failed").join(known, "doc_id").withColumn("tune", part)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    risk: Risk = Risk(),
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rejected_by`` (name of the first rule that rejects it, ``base``, or null).

    The base check fails texts of fewer than 50 words or with over half of their words in repeated
    3-word windows. The other rules have cut-offs certified for each stratum (:func:`certified_cutoffs`) on the labelled documents
    that pass the base check; strata without certified cut-offs, or not in the labels, keep all.

    Null and empty texts have zero counts and fail the base check. A null stratum is one of its own.
    A document with several labels counts as good if all are; null labels and labels of unknown
    documents count for nothing. Repeated rows are judged alike; an empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("\x00null")).alias("stratum"), F.col(text).alias("text"))
    counts = materialize(text_counts(source, ["doc_id", "stratum"]), "text-counts")
    counts = counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    cuts = certified_cutoffs(labelled_counts(counts, labels, risk, doc_id, label), risk)
    why = F.when(F.col("base_failed"), "base")
    for r in risk.rules:
        why = why.when(F.expr(r.value) > F.col(f"cut_{r.name}"), r.name)
    # The cut-offs are a written table of a row a stratum: Spark sees its size and broadcasts it if it is small.
    return counts.join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", why.isNull().alias("kept"), why.alias("rejected_by")
    )
