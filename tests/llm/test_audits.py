"""Mixing, manifest and divergence against plain Python on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, g string, term string"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def rows(seed: int, n: int, sources: list):
    r = random.Random(seed)
    words = ["Ab", "ab", "cd", "éà", "É", "x1y", "zz", "the", "THE", "ü k", "q-r", "\x1c", "\t"]
    out = []
    for i in range(n):
        text = r.choice([None, "", " \n", " ".join(r.choices(words, k=r.randrange(1, 40))), " ".join(r.choices(words, k=300))]) if i % 3 else " ".join(r.choices(words, k=30))
        out.append((r.choice([None, i, i // 2, i]), text, r.choice([None, "", "en", "de", "xx"]), r.choice(sources), r.choice([None, 3]), 7, "g", "t"))
    return out + out[:5]


@pytest.fixture(scope="module", params=[["a", "b", None, "", "é", "B"], ["s"], [f"s{i % 40}" for i in range(45)]], ids=["mixed", "one", "many"])
def docs(spark, request):
    data = rows(len(request.param), 230, request.param)
    return data, spark.createDataFrame(data, SCHEMA).repartition(5)


def fill(sizes: dict, weights=(3, 1, 2), up=3, down=2, repeats=2):
    """Targets as fractions: the excess is shared again until no source is above its most."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = Fraction(up * sum(sizes.values()), down) - sum(repeats * sizes[s] for s in full)
        total = sum(w[s] for s in order if s not in full)
        target = {s: Fraction(repeats * sizes[s]) if s in full else left * w[s] / total for s in order}
        over = {s for s in order if s not in full and target[s] > repeats * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(docs):
    from panelwright.llm.mixing import mix, mix_report

    data, df = docs
    mixed = mix(df, (3, 1, 2)).collect()
    report = mix_report(mix(df, (3, 1, 2))).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: Counter = Counter()
    for d in data:
        sizes[d[3]] += size(d[1])
    want = fill(sizes)
    assert sorted((r.doc_id or -1, r.size, r.source_size) for r in report) == sorted((-1 if d[0] is None else d[0] or -1, size(d[1]), sizes[d[3]]) for d in data)
    taken: Counter = Counter()
    for r in mixed:
        assert r.target == float(want[r.source])
        assert 0 <= r.taken <= r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s]) for s in want)
    assert all(0 <= r.taken <= 2 * r.size for r in report)
    # In the order of the mix nothing is left out between pieces, and at every point sources have been served by their weights.
    at = 0
    for r in sorted((r for r in mixed if r.taken), key=lambda r: r.position):
        assert r.position == at
        at += r.taken
    done = sorted((r for r in mixed if r.taken == r.size), key=lambda r: r.position)
    assert all(x.finish <= y.finish for x, y in zip(done, done[1:]))
    again = mix_report(mix(df.repartition(3), (3, 1, 2))).collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, again)) == sorted(map(key, report))
    assert mix_report(mix(df.limit(0), (3, 1, 2))).count() == 0


def test_mixing_shares_what_small_sources_leave(spark):
    from panelwright.llm.mixing import mix

    text = lambda n: " ".join("w" * n)
    data = [(i, text(10), s) for i, s in enumerate(["a"] * 2 + ["b"] * 60 + ["c"] * 8 + ["d"] * 40)]
    got = {r.source: r.target for r in mix(spark.createDataFrame(data, "doc_id long, text string, source string"), (3, 1, 2)).collect()}
    # a and c are full at 40 and 160; b and d share the other 1450 by 1 to 3, of which d takes 800 at most.
    assert got == {"a": 40.0, "b": 650.0, "c": 160.0, "d": 800.0}


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, lower=False):
    text = d[1]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], d[4], text)])


def climb(nodes: list[str]):
    """The root, and for each node the siblings before and after it on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            run = at[k] // 16 * 16
            paths[k].append((nodes[run : at[k]], nodes[at[k] + 1 : run + 16]))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], paths


def test_merkle(docs):
    from panelwright.llm.merkle import tamper_report

    data, df = docs
    groups = defaultdict(list)
    for d in data:
        groups[d[3]].append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees.append(climb([leaf(d) for d in groups[s]]))
    root, tops = climb([t[0] for t in trees])
    want = []
    for s, (sub, paths), top in zip(order, trees, tops):
        for d, path in zip(groups[s], paths):
            path = path + top
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            now = leaf(d, tampered)
            for a, b in path:
                now = h(*a, now, *b)
            want.append((d[0], leaf(d), sub, root, h(*[x for a, b in path for x in a + b]), now, now == root))
    got = [tuple(r) for r in tamper_report(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {w[6] for w in want} == {True, False}
    assert tamper_report(df.limit(0)).count() == 0


def test_merkle_proofs_hold_for_every_tree_size(spark):
    from pyspark.sql import functions as F

    from panelwright.llm.merkle import fold, manifest

    data = [(i, f"s{n}", h(str(n), str(i))) for n in (1, 2, 3, 9, 10, 27, 28) for i in range(n)]
    got = manifest(spark.createDataFrame(data, "doc_id long, source string, leaf string"), fan=3)
    bad = got.filter((fold(F.col("leaf"), F.col("path")) != F.col("root")) | (fold(F.upper("leaf"), F.col("path")) == F.col("root")))
    assert got.count() == len(data) and bad.count() == 0


@pytest.mark.parametrize("terms,groups", [(1024, 64), (2, 3)])
def test_divergence(docs, monkeypatch, terms, groups):
    from panelwright.llm import divergence as D

    monkeypatch.setattr(D, "TERMS", terms)
    monkeypatch.setattr(D, "GROUPS", groups)
    data, df = docs
    n, docs_with = defaultdict(Counter), defaultdict(Counter)
    langs = defaultdict(set)
    for d in data:
        lang, source = d[2] or "", d[3] or ""
        langs[lang].add(source)
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", d[1] or "")]
        n[lang, source].update(found)
        docs_with[lang].update(set(found))
    want = []
    for lang, sources in langs.items():
        kept = sorted((t for t, c in docs_with[lang].items() if c >= 10), key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in kept})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        of, q = {s: p(n[lang, s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            best = sorted((-f(of[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and of[s][t] > q[t])[:10]
            want += [(lang, s, part, x, -v, i) for part, found in (("pair", pairs), ("term", best)) for i, (v, _, x) in enumerate(found, 1)]
    got = [tuple(r) for r in D.divergence(df).collect()]
    assert sorted(got) == sorted(want)
    assert D.divergence(df.limit(0)).count() == 0


def test_probability_is_exact():
    import numpy as np

    from panelwright.llm.divergence import probability

    r = random.Random(3)
    cases = [(a, b) for b in (1, 7, 10**9 + 7, 8 * 10**15) for a in (0, 1, b, r.randrange(b + 1)) if a <= b]
    got = probability(np.array([a for a, _ in cases]), np.array([b for _, b in cases]))
    assert got.tolist() == [1 + 10**9 * a // b for a, b in cases]
