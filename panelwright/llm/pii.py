"""Personal data: exact base patterns, and further candidates judged by boosted trees.

Everything runs as Spark expressions on whole texts. A pattern's places come from the matches and the
pieces between them, whose lengths add up to the starts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract, written so that Java's engine neither recurses nor tries a run of
# characters again from its middle: a run that fails from its start fails from every later place, and
# what a match has left of a run is tried from there (\G).
_MAIL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: Only runs of 13 to 19 digits pass later on, so shorter and longer ones needn't be listed.
CARD_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
_IP_OK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# High-recall generators of further candidates.
_AT, _DOT = r" ?[\[({] ?at ?[\])}] ?", r"(?: ?[\[({] ?dot ?[\])}] ?|\.)"
MORE = {
    "email": rf"(?<!{_MAIL})[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])",
}
#: Cards and telephone numbers come from runs of digit groups: every group starts a span with each number of groups.
RUN = r"\(?[0-9](?:[0-9\x20./(),;-]*[0-9])?"
GROUP = r"\([0-9]++\)|[0-9]++"
GROUPS = 10
SHAPES = {
    "card": (13, 19, r"^[0-9]++(?:[\x20-][0-9]++)*+$"),
    "phone": (7, 12, r"^(?:\([0-9]{2,5}\)|[0-9]{2,12}+)(?:[\x20./-]{0,2}(?:\([0-9]{2,5}\)|[0-9]{2,8}+))*+$"),
}
#: Characters of context on either side of a candidate.
CONTEXT = 32
#: Words that speak for and against personal data.
_FOR = r"(?i)(phone|tel\b|tel[.:]|call|mobile|cell|fax|whatsapp|contact|reach|mail|card|visa|credit|debit|server|host|address|number is|telefon|móvil|teléfono|téléphone|handy)"
_AGAINST = r"(?i)(order|invoice|isbn|issn|part|serial|version|page|pages|year|date|total|ticket|case|ref|id[:#]|no\.|sku|doi)"


def _bind(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _totals(a: Column) -> Column:
    """0 and the running totals of an array of longs."""
    return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running(a: Column, block: int = 512) -> Column:
    """The sum of all elements before each one. Blocks keep the appending short on long arrays."""

    def blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: _totals(F.slice(x, b * block + 1, block)))

        def join(p: Column) -> Column:
            first = _totals(F.transform(p, lambda r: F.element_at(r, -1)))
            return _bind(first, lambda o: F.flatten(F.transform(p, lambda r, i: F.transform(F.slice(r, 1, F.size(r) - 1), lambda v: v + F.get(o, i)))))

        return _bind(parts, join)

    return _bind(a, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str) -> Column:
    """Array of ``start, end, found, before, after`` of every match; places in code points."""

    def placed(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            ahead = running(F.zip_with(F.slice(g, 1, F.size(m)), m, lambda x, y: (F.length(x) + F.length(y)).cast("long")))

            def one(a: Column) -> Column:
                def row(y: Column, i: Column) -> Column:
                    start = F.get(a, i) + F.length(F.get(g, i))
                    return F.struct(
                        start.alias("start"), (start + F.length(y)).alias("end"), y.alias("found"),
                        F.right(F.get(g, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(g, i + 1), F.lit(CONTEXT)).alias("after"),
                    )

                return F.transform(m, row)

            return _bind(ahead, one)

        return F.when(F.size(m) == 0, F.array().cast(_MATCH)).otherwise(_bind(F.split(text, pattern, -1), with_gaps))

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


_MATCH = "array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>"
_SPAN = "array<struct<start:bigint,end:bigint>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.lit(0) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Places of the base kinds."""

    def span(a: Column) -> Column:
        return F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    none = F.array().cast(_MATCH)
    return {
        "email": span(F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none)),
        "ip": span(F.filter(matches(text, IP), lambda x: x["found"].rlike(_IP_OK))),
        "card": span(F.filter(matches(text, CARD_RUN), lambda x: luhn(_digits(x["found"])))),
        "phone": span(
            F.filter(
                F.when(F.contains(text, F.lit("+")), matches(text, PHONE)).otherwise(none),
                lambda x: F.length(_digits(x["found"])).between(9, 15),
            )
        ),
    }


# What the trees see of a candidate.
FEATURES = (
    "kind_email", "kind_ip", "kind_card", "kind_phone", "n_digits", "n_chars", "n_groups", "has_paren", "longest_group",
    "word_for", "word_against", "digit_near", "first_zero", "has_slash", "has_dot", "last_group", "n_separators",
)


def features(kind: str, found: Column, before: Column, after: Column) -> list[Column]:
    digits = _digits(found)
    groups = F.split(F.regexp_replace(found, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""), "[^0-9A-Za-z]+")
    return [
        *[F.lit(1.0 if kind == k else 0.0) for k in KINDS],
        F.length(digits).cast("double"),
        F.length(found).cast("double"),
        F.size(groups).cast("double"),
        F.contains(found, F.lit("(")).cast("double"),
        F.array_max(F.transform(groups, lambda g: F.length(g))).cast("double"),
        before.rlike(_FOR).cast("double"),
        before.rlike(_AGAINST).cast("double"),
        (before.rlike("[0-9][^A-Za-z]{0,3}$") | after.rlike("^[^A-Za-z]{0,3}[0-9]")).cast("double"),
        F.substring(digits, 1, 1).isin("0").cast("double"),
        F.contains(found, F.lit("/")).cast("double"),
        F.contains(found, F.lit(".")).cast("double"),
        F.length(F.element_at(groups, -1)).cast("double"),
        F.size(F.array_distinct(F.split(F.regexp_replace(found, r"\([0-9]+\) ?|[0-9A-Za-z]", ""), ""))).cast("double"),
    ]


def labelled_candidates(spark: SparkSession, rows: int) -> DataFrame:
    """``kind, found, before, after, label``: candidates made by rule, since no table of labelled spans exists.

    Formats and contexts are drawn by hashes of the row's number. A candidate is personal data if its
    format can be and its context does not speak against it; digits alone need a context that speaks for it.
    """

    def draw(seed: int, options: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(options))) + 1).cast("int"))

    def digits(seed: int, n: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10**n)).cast("string"), n, "0")

    pos = draw(1, ["phone ", "call me at ", "tel: ", "mobile ", "contact ", "my number is ", "fax ", "reach us on "])
    neg = draw(2, ["order ", "invoice ", "isbn ", "serial ", "version ", "pages ", "total ", "ref ", "case "])
    flat = draw(3, ["and the ", "of a ", "with her ", "so it was ", "1995 "])
    cards = draw(4, ["card ", "visa ", "credit card ", "debit "])
    word = draw(5, ["anna", "info", "j.smith", "sales", "max_m"])
    site = draw(6, ["example", "mail", "uni-x", "web4"])
    hex4 = lambda s: F.lower(F.lpad(F.hex(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(65536))), 4, "0"))
    phones = draw(7, ["a", "b", "c", "d"])
    phone = (
        F.when(phones == "a", F.concat(F.lit("("), digits(11, 3), F.lit(") "), digits(12, 3), F.lit("-"), digits(13, 4)))
        .when(phones == "b", F.concat(digits(11, 3), F.lit("-"), digits(12, 3), F.lit("-"), digits(13, 4)))
        .when(phones == "c", F.concat(F.lit("0"), digits(11, 2), F.lit(" "), digits(12, 7)))
        .otherwise(F.concat(F.lit("0"), digits(11, 3), F.lit("/"), digits(12, 6)))
    )
    table = draw(8, ["a", "b", "c"])
    other = (
        F.when(table == "a", F.concat(F.lit("20"), digits(11, 2), F.lit("-"), F.lpad((F.pmod("id", F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("-"), digits(12, 2)))
        .when(table == "b", F.concat(digits(11, 2), F.lit(" "), digits(12, 2), F.lit(" "), digits(13, 2)))
        .otherwise(F.concat(digits(11, 4), F.lit("."), digits(12, 2)))
    )
    card = F.concat(digits(11, 4), F.lit(" "), digits(12, 4), F.lit(" "), digits(13, 4), F.lit(" "), digits(14, 4))
    mail = F.concat(word, draw(9, [" (at) ", "[at]", " [ at ] "]), site, draw(10, [" (dot) ", "[dot]", "."]), F.lit("com"))
    ip6 = F.concat_ws(":", *[hex4(20 + i) for i in range(8)])
    amex = F.concat(digits(11, 4), F.lit(" "), digits(12, 6), F.lit(" "), digits(13, 5))
    bare = F.concat(F.lit("5"), digits(12, 4), digits(13, 5))
    tight = F.concat(F.lit("("), digits(11, 3), F.lit(")"), digits(12, 3), F.lit("-"), digits(13, 4))
    local = F.concat(digits(12, 3), F.lit("-"), digits(13, 4))
    plain = F.concat(digits(11, 3), F.lit("-"), local)
    twin = F.concat(digits(31, 3), F.lit("-"), digits(32, 3), F.lit("-"), digits(33, 4))
    day = F.concat(F.lit("20"), digits(31, 2), F.lit("-0"), digits(32, 1), F.lit("-"), digits(33, 2))
    short6 = F.concat(draw(34, ["2001:", "fe80:", "2a02:"]), F.when(table == "a", F.concat(hex4(21), F.lit(":"))).when(table == "b", "db8:").otherwise(""), F.lit(":"), F.when(phones == "a", hex4(22)).otherwise(digits(23, 1)))
    end = F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, " and the rest").otherwise(".")
    code6 = draw(10, ["a::b", "add::be", "::", "bad::face", "c::d"])
    cases = [
        ("phone", phone, pos, 1), ("phone", phone, neg, 0), ("phone", phone, flat, 0), ("phone", other, flat, 0), ("phone", other, neg, 0),
        ("phone", other, pos, 0), ("card", card, cards, 1), ("card", card, neg, 0), ("card", card, flat, 0),
        ("email", mail, flat, 1), ("email", mail, pos, 1), ("ip", ip6, flat, 1), ("ip", ip6, pos, 1),
        ("phone", bare, pos, 1), ("phone", bare, neg, 0), ("phone", bare, flat, 0), ("phone", tight, pos, 1), ("phone", tight, neg, 0), ("phone", local, pos, 1),
        ("card", amex, cards, 1), ("card", F.concat(card, F.lit(" "), digits(15, 3)), cards, 0), ("ip", short6, flat, 1), ("ip", short6, pos, 1), ("ip", code6, flat, 0),
    ]
    # Spans of runs that hold more than one number: the whole ones, and those that cut or cross them.
    runs = [
        ("phone", plain, pos, F.concat(F.lit(" "), twin), 1), ("phone", plain, F.concat(pos, twin, F.lit(" ")), end, 1), ("phone", plain, F.concat(pos, day, F.lit(" ")), end, 1),
        ("phone", local, F.concat(pos, digits(31, 3), F.lit("-")), end, 0), ("phone", local, F.concat(pos, F.lit("("), digits(31, 3), F.lit(")")), end, 0),
        ("phone", F.concat(digits(33, 4), F.lit(" "), digits(11, 3), F.lit("-"), digits(12, 3)), F.concat(pos, digits(31, 3), F.lit("-"), digits(32, 3), F.lit("-")), F.concat(F.lit("-"), digits(13, 4)), 0),
        ("phone", F.concat(digits(33, 2), F.lit(" "), plain), F.concat(pos, digits(31, 4), F.lit("-05-")), end, 0),
        ("phone", day, pos, F.concat(F.lit(" "), plain), 0),
        ("phone", F.concat(digits(11, 4), F.lit(" "), digits(12, 4)), F.concat(cards, digits(13, 4), F.lit(" ")), F.concat(F.lit(" "), digits(14, 4)), 0),
        ("phone", F.concat(digits(11, 4), F.lit(" "), digits(12, 4), F.lit(" "), digits(13, 4)), cards, F.concat(F.lit(" "), digits(14, 4)), 0),
        ("card", card, cards, F.concat(F.lit(" "), digits(15, 3)), 1),
    ]
    cases = [(k, f, b, end, y) for k, f, b, y in cases] + runs
    n = len(cases)
    pick = F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("found"), b.alias("before"), F.lit(y).alias("label"), a.alias("after")) for k, f, b, a, y in cases])
    made = spark.range(0, rows, 1, 4).withColumn("c", F.element_at(pick, (F.pmod("id", F.lit(n)) + 1).cast("int")))
    return made.select("id", "c.*")


@dataclass(frozen=True)
class Model:
    """Trees as nested tuples (feature, cut, left, right) or values, their weights, and the cut-off score of each kind."""

    trees: tuple
    weights: tuple[float, ...]
    cutoff: dict[str, float]

    def score(self, x: list[Column]) -> Column:
        def walk(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            f, cut, left, right = t
            return F.when(x[f] <= cut, walk(left)).otherwise(walk(right))

        total = F.lit(0.0)
        for t, w in zip(self.trees, self.weights):
            total = total + F.lit(w) * walk(t)
        return total


def train(spark: SparkSession, rows: int = 3900, rounds: int = 6, depth: int = 4, precision: float = 0.99) -> Model:
    """Boosted trees on two thirds of the made candidates; the cut-off of a kind is the lowest score above which
    the other third's candidates of that kind have at least ``precision``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    made = labelled_candidates(spark, rows)
    x = F.lit(None)
    for k in KINDS:
        x = F.when(F.col("kind") == k, F.array(*features(k, F.col("found"), F.col("before"), F.col("after")))).otherwise(x)
    data = made.select("id", "kind", F.col("label").cast("double").alias("label"), x.alias("x"))
    data = data.select("id", "kind", "label", *[F.get("x", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data).cache()
    fit = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7).fit(data.filter("id % 3 <> 0"))

    def tree(node):
        if node.numDescendants() == 0:
            return float(node.prediction())
        split = node.split()
        return (int(split.featureIndex()), float(split.threshold()), tree(node.leftChild()), tree(node.rightChild()))

    java = fit._java_obj
    trees = tuple(tree(t.rootNode()) for t in java.trees())
    model = Model(trees, tuple(float(w) for w in java.treeWeights()), {})
    held = data.filter("id % 3 = 0").select("kind", "label", F.round(model.score([F.col(f) for f in FEATURES]), 6).alias("s"))
    by = held.groupBy("kind", "s").agg(F.sum("label").alias("good"), F.count("*").alias("all")).orderBy(F.desc("s")).collect()
    data.unpersist()
    cutoff = dict.fromkeys(KINDS, float("inf"))
    good, total = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for r in by:  # a row for each kind and leaf combination of a few small trees
        good[r.kind] += r.good
        total[r.kind] += r["all"]
        if good[r.kind] >= precision * total[r.kind]:
            cutoff[r.kind] = r.s
    return Model(trees, model.weights, cutoff)


def _seen(text: Column) -> Column:
    """Of a text: base spans, matches of further patterns, and for each run of numbers its place with its groups."""
    email = F.when(text.rlike(r"at ?[\])}]"), matches(text, MORE["email"])).otherwise(F.array().cast(_MATCH))
    ip = F.when(F.contains(text, F.lit("::")) | text.rlike("(?::[0-9A-Fa-f]++){7}"), matches(text, MORE["ip"])).otherwise(F.array().cast(_MATCH))
    runs = F.filter(matches(text, RUN), lambda r: r["found"].rlike("(?:[0-9][^0-9]*+){7}"))
    return F.struct(
        F.struct(*[v.cast(_SPAN).alias(k) for k, v in base_spans(text).items()]).alias("base"),
        email.alias("email"), F.filter(ip, lambda x: F.size(F.split(x["found"], ":+")) <= 8).alias("ip"),
        F.transform(runs, lambda r: F.struct(r.alias("run"), matches(r["found"], GROUP).alias("groups"))).alias("runs"),
    )


def _joined(g: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.slice(g, first + 1, n), lambda x: F.concat(x["before"], x["found"])), "")


def _windows(x: Column) -> Column:
    """The spans of a run that start at any group and take any number of groups up to ``GROUPS``."""
    r, g = x["run"], x["groups"]

    def span(i: Column, j: Column) -> Column:
        a, b, back = F.get(g, i), F.get(g, j), F.least(i, F.lit(CONTEXT // 2))
        # Of the groups ahead, as many as the context can hold.
        before = F.concat(F.when(i <= CONTEXT // 2, r["before"]).otherwise(""), _joined(g, i - back, back), a["before"])
        after = F.when(j + 1 < F.size(g), _joined(g, j + 1, F.lit(1))).otherwise(F.concat(b["after"], r["after"]))
        return F.struct(
            (r["start"] + a["start"]).alias("start"), (r["start"] + b["end"]).alias("end"),
            F.concat(a["found"], _joined(g, i + 1, j - i)).alias("found"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
        )

    last = F.size(g) - 1
    every = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, F.least(i + (GROUPS - 1), last)), lambda j: span(i, j))))
    return F.filter(every, lambda y: F.length(_digits(y["found"])).between(7, 19) & ~y["before"].rlike("[A-Za-z+]$") & ~y["after"].rlike("^[A-Za-z]"))


def _score(model: Model, kind: str, x: Column) -> Column:
    seen = F.array(*features(kind, x["found"], x["before"], x["after"]))
    return _bind(seen, lambda f: model.score([F.get(f, F.lit(i)) for i in range(len(FEATURES))]))


def _free(x: Column, base: Column) -> Column:
    free = F.lit(True)
    for k in KINDS:
        free = free & ~F.exists(base[k], lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))
    return free


_NUMBER = "array<struct<worth:double,length:bigint,start:bigint,end:bigint,kind:string>>"


def _judged(every: Column, kind: str, base: Column, model: Model) -> Column:
    """What the trees accept and overlaps no base span, with its worth to sort by."""
    fits = F.filter(every, lambda x: _free(x, base))
    if kind in SHAPES:
        least, most, shape = SHAPES[kind]
        fits = F.filter(every, lambda x: F.length(_digits(x["found"])).between(least, most) & x["found"].rlike(shape) & _free(x, base))
    rated = F.transform(fits, lambda x: F.struct(
        (-F.round(_score(model, kind, x), 6)).alias("worth"), (x["start"] - x["end"]).alias("length"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.filter(rated, lambda x: -x["worth"] >= model.cutoff[kind] - 1e-6).cast(_NUMBER)


def _best(c: Column) -> Column:
    """The spans that don't overlap, by score, then length, then place."""

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])), kept).otherwise(F.concat(kept, F.array(x)).cast(_NUMBER))

    return F.aggregate(F.array_sort(c), F.array().cast(_NUMBER), step)


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


_models: dict[str, Model] = {}


def default_model(spark: SparkSession) -> Model:
    """The model of the made candidates; the same in every session, so it is fitted once."""
    if "model" not in _models:
        _models["model"] = train(spark)
    return _models["model"]


def find_pii(docs: DataFrame, keep: list[str], text: str = "text", model: Model | None = None) -> DataFrame:
    """The ``keep`` columns, ``pii_text_`` (null as empty), ``pii_base_`` and ``pii_spans_``: for each kind, its base places and all of its places.

    Places are arrays of ``start, end`` in code points, ascending. Null and empty texts have none;
    repeated rows are searched alike; an empty table gives no rows.
    """
    model = model or default_model(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))

    # Each step binds what the last one found, so it is worked out once; one expression would nest too deep for the analyser.
    found = docs.select(*keep, t.alias("pii_text_"), _bind(t, _seen).alias("pii_seen_"))
    found = found.select(*keep, "pii_text_", _bind(F.col("pii_seen_"), lambda s: F.struct(*[s[k].alias(k) for k in ("base", "email", "ip")], F.transform(s["runs"], _windows).alias("runs"))).alias("pii_seen_"))

    def rated(s: Column) -> Column:
        more = [_judged(s[k], k, s["base"], model) for k in MORE]
        numbers = F.transform(s["runs"], lambda e: F.concat(*[_judged(e, k, s["base"], model) for k in SHAPES]))
        return F.struct(s["base"].alias("base"), F.concat(*more).alias("more"), numbers.alias("runs"))

    found = found.select(*keep, "pii_text_", _bind(F.col("pii_seen_"), rated).alias("pii_seen_"))

    def chosen(s: Column) -> Column:
        def all_spans(n: Column) -> Column:
            own = lambda k: F.transform(F.filter(n, lambda x: x["kind"] == k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).cast(_SPAN)
            return F.struct(s["base"].alias("base"), F.struct(*[F.array_sort(F.concat(s["base"][k], own(k))).alias(k) for k in KINDS]).alias("spans"))

        return _bind(F.concat(s["more"], F.flatten(F.transform(s["runs"], _best))), all_spans)

    found = found.select(*keep, "pii_text_", _bind(F.col("pii_seen_"), chosen).alias("pii_found_"))
    return found.select(*keep, "pii_text_", F.col("pii_found_.base").alias("pii_base_"), F.col("pii_found_.spans").alias("pii_spans_"))


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: counts and digest of the base places and
    the list ``kind:start:end`` of all places, by kind, then start, joined by commas."""
    found = find_pii(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", model)

    def listed(column: str) -> Column:
        return F.array_join(F.concat(*[_listed(k, F.col(f"{column}.{k}")) for k in KINDS]), ",")

    return found.select(
        "doc_id", *[F.size(f"pii_base_.{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed("pii_base_"), 256).alias("base_sha256"), listed("pii_spans_").alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """The same columns, with every place found replaced by its kind in brackets.

    Where places of different kinds overlap, what one has covered is not shown again. Null texts stay null, empty ones
    empty; repeated rows are treated alike; other columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    found = find_pii(row, ["row"], "text", model)

    def tagged(kind: str) -> Column:
        tag = F.lit(f"[{kind.upper()}]")
        return F.transform(F.col(f"pii_spans_.{kind}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag.alias("tag")))

    every = F.array_sort(F.concat(*map(tagged, KINDS)))

    def cut(s: Column) -> Column:
        # Each piece runs from the furthest end before the span to its start.
        zero = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            gap = F.substr(F.col("pii_text_"), (acc["to"] + 1).cast("int"), F.greatest(x["start"] - acc["to"], F.lit(0)).cast("int"))
            tag = F.when(x["start"] >= acc["to"], x["tag"]).otherwise("")
            return F.struct(F.greatest(acc["to"], x["end"]).alias("to"), F.concat(acc["out"], F.array(F.concat(gap, tag))).alias("out"))

        return F.aggregate(s, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("pii_text_"), (acc["to"] + 1).cast("int"))))

    clean = F.when(F.col(f"row.{text}").isNull(), F.lit(None).cast("string")).otherwise(_bind(every, lambda s: F.when(F.size(s) == 0, F.col("pii_text_")).otherwise(cut(s))))
    return found.select(*[clean.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns])
