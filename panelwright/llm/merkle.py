"""A Merkle manifest of a dataset: a tree of digests for each source, and one over their roots.

A level is one window: nodes are partitioned by group and parent, and the ordered list of a parent's children, over the full frame, is
both what the parent is the digest of and, without the node itself, its siblings. The first child stands for the parent in the next
level. A window holds ``fan`` rows, so a source of any size is spread over all tasks. What is moved are digests, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .running import running


def digest(text: Column) -> Column:
    """Lower-case hexadecimal sha256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def preimage(fields: Sequence[Column]) -> Column:
    """Each value as its UTF-8 length, a colon and itself, null as a dash: no two rows have the same."""
    parts = [c.cast("string") for c in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts])


def _with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes of unfinished groups with ``up``, ``kids`` and the joined digests of the siblings ``left`` and ``right`` of each."""
    rows = nodes.filter("n > 1").withColumn("up", F.expr(f"i div {fan}L"))
    full = W.partitionBy("g", "up").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = (F.col("i") % fan).cast("int")
    rows = rows.withColumn("kids", F.collect_list("h").over(full))
    return rows.withColumns({"left": F.array_join(F.slice("kids", F.lit(1), at), ""), "right": F.array_join(F.slice("kids", at + 2, F.lit(fan)), "")})


def levels(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """The trees of all groups from ``g, i, n, h`` (group, place from 0, number of the group's nodes, digest) up, a written table a level.

    A group's last node is the one of the level where ``n`` is 1."""
    out, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = _with_siblings(out[-1], fan).filter(F.col("i") % fan == 0)
        out.append(materialize(first.select("g", F.col("up").alias("i"), F.expr(f"(n + {fan - 1}) div {fan}L").alias("n"), digest(F.array_join("kids", "")).alias("h")), "level"))
        most = -(-most // fan)
    return out


def paths(tree: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """The leaves with the columns of ``tops`` (a row a group ``g``): ``path`` gets the siblings on the way up put before what it has.

    Levels go from the top down, each joined to its parents, so the longest strings are moved once for ``fan`` leaves."""
    more = [c for c in tops.columns if c not in ("g", "path")]
    below = None
    for level in reversed(tree):
        here = level.filter("n = 1").join(tops, "g").select(*level.columns, "path", *more)
        if below is not None:
            kin = _with_siblings(level, fan).join(below.select("g", F.col("i").alias("up"), F.col("path").alias("above"), *more), ["g", "up"])
            here = here.unionByName(kin.select(*level.columns, F.concat(F.array(F.struct("left", "right")), "above").alias("path"), *more))
        below = here if level is tree[0] else materialize(here, "paths")
    return below


def proof(path: Column) -> Column:
    """All siblings of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path come to."""
    return F.aggregate(path, leaf, lambda h, x: digest(F.concat(x["left"], h, x["right"])))


def manifest(leaves: DataFrame, fan: int = 16) -> DataFrame:
    """``leaves`` (``source``, ``doc_id``, ``leaf`` and others) with ``subroot``, ``root`` and ``path``, an array of ``left, right``.

    A source's leaves are ordered by id, null first, then by digest; every ``fan`` consecutive nodes become their digest until one is
    left, the subroot; a lone leaf is it itself. Subroots, by source (null first, by bytes), come to the root in the same way. Repeated
    rows are leaves of their own, a null source is one of its own; an empty table has no rows. ``leaves`` is read twice and must not have
    columns named ``g, i, n, h, up, kids, left, right, path, subroot, root``.
    """
    placed = running(leaves, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")]).drop("before").withColumnRenamed("ordinal", "i")
    placed = materialize(placed, "placed")
    names = running(placed.groupBy("source").agg(F.count("*").alias("n")), [], [F.col("source").asc_nulls_first()]).drop("before")
    names = names.select(F.col("source").alias("of"), F.col("ordinal").alias("g"), "n")
    nodes = materialize(placed.join(names, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("h", F.col("leaf")), "leaves")
    tree = levels(nodes, fan)
    last = [level.filter("n = 1").select("g", "h") for level in tree]
    subroots = last[0]
    for level in last[1:]:
        subroots = subroots.unionByName(level)
    n = subroots.count()
    upper = levels(materialize(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n).cast("long").alias("n"), "h"), "subroots"), fan)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    top = upper[-1].filter("n = 1").select("g", empty.alias("path"), F.col("h").alias("root"))
    tops = materialize(paths(upper, top, fan).select(F.col("i").alias("g"), F.col("h").alias("subroot"), "path", "root"), "tops")
    return paths(tree, tops, fan).drop("g", "i", "n", "h")


def digest_leaves(docs: DataFrame, fields: Sequence[str], ident: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, leaf`` of each row over its ``fields``."""
    return docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), digest(preimage([F.col(c) for c in fields])).alias("leaf"))


def tamper_report(docs: DataFrame, every: int = 5, fan: int = 16, ident: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: does the proof of the original notice tampered rows?

    Rows where ``every`` divides the crc32 of the id in decimals have the A-Z of their text in lower case when they are checked; a null
    id or text is never tampered with. ``verified`` is true where the leaf as it is now comes to the manifest's root.
    """
    f = {k: F.col(v) for k, v in {"id": ident, "source": source, "lang": lang, "n_chars": n_chars, "text": text}.items()}
    lower = F.translate(f["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: digest(preimage([f["id"], f["source"], f["lang"], f["n_chars"], t]))
    picked = F.crc32(f["id"].cast("string").cast("binary")) % every == 0
    rows = materialize(docs.select(f["id"].alias("doc_id"), f["source"].alias("source"), of(f["text"]).alias("leaf"), F.when(picked, of(lower)).alias("other")), "digests")
    now = F.coalesce("other", "leaf")
    found = manifest(rows, fan).select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), fold(now, F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
