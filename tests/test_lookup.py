"""Lookups by part and prefix against a look at every name."""

from __future__ import annotations

import random

from panelwright.operators import lookup as L


def test_parts_and_prefixes(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    names = [(r.choice("pq"), i, None if i % 50 == 0 else word(r.randrange(0, 25))) for i in range(600)]
    parts = [(r.choice("pq"), word(r.randrange(0, 6))) for _ in range(80)] + [("p", "zzz"), ("q", None), ("p", ""), ("z", "a")]
    texts, asked = spark.createDataFrame(names, "k string, id long, name string"), spark.createDataFrame(parts + parts[:9], "k string, part string")
    want = {(k, p, i) for k, p in parts if p is not None for k2, i, n in names if k == k2 and n is not None and p in n}
    assert sorted(tuple(x) for x in L.containing(texts, asked, ["k"]).collect()) == sorted(want)
    long = [p for p in parts if p[1] and len(p[1]) >= 3]
    seen = L.candidates(texts, spark.createDataFrame(long, "k string, part string"), ["k"]).count()
    assert seen < 0.05 * len(long) * 600
    prefixes = [p for _, p in parts]
    got = {x.id: x.prefix for x in L.longest_prefix(texts, spark.createDataFrame([(p,) for p in prefixes], "prefix string")).collect()}
    assert got == {i: max((p for p in prefixes if p is not None and n.startswith(p)), key=len) for _, i, n in names if n is not None}
    assert L.containing(texts.limit(0), asked, ["k"]).count() == L.longest_prefix(texts, asked.select(asked.part.alias("prefix")).limit(0)).count() == 0
