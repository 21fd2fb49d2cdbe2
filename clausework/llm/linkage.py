"""Links between similar items and their connected components, without all pairs of a group.

Items (``node``) share keys (``token``).  The work goes in two steps:

1. every item is compared with the smallest item of each of its keys (linear in the keys);
2. items that then still lie in different components, but share a key, are compared group by group:
   a group is a bounded chunk of one component, the token-group matrix counts how many of an item's
   keys are in a group's union of keys, and only groups that pass the bound are opened.

Inside one component nothing more is compared: one link is enough to join two components, so the
components are those of the full link graph while a large group of copies costs linear work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.shared import cleaned, drop, written

#: Rows, or entries of lists in them, that may be broadcast: 8 to 24 bytes each, so some 10 MB at most.
BROADCAST_ROWS = 400_000
GROUP = 64
#: Components of one key from which its items get finer keys.
CROWD = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges(a, b)``; component is the smallest node.

    Large-star and small-star steps alternate until the edges no longer change.  Each step is a
    minimum per node and a join; its rows are written to the shared folder.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        # a is above b. Large star: neighbours above a node go to its smallest neighbour (or itself).
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its neighbours below go to the smallest of them.
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = written(small, "edges")
        with cleaned(small.sparkSession):
            stats = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now, large)
        now = small
        if stats == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = stats


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is small by count, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _pairs(compare: Callable, max_bytes: int):
    """mapInArrow over (q, h, q_text, h_text): the pairs that ``compare`` links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from clausework.llm import textnp

        for batch in textnp.slices(batches, "q_text", max_bytes):
            keep = pa.array(compare(batch.column("q_text"), batch.column("h_text")))
            yield pa.RecordBatch.from_arrays([batch.column("q").filter(keep), batch.column("h").filter(keep)], names=["a", "b"])

    return run


def paired_texts(pairs: DataFrame, texts: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(q, h, q_text, h_text) of ``pairs(q, h)``. ``texts(ids(node, ...), rows)`` adds ``text`` to rows."""
    n = pairs.count()
    one = texts(pairs.select(F.col("q").alias("node"), "h"), n).select(F.col("node").alias("q"), "h", F.col("text").alias("q_text"))
    other = texts(pairs.select(F.col("h").alias("node")).distinct(), n).select(F.col("node").alias("h"), F.col("text").alias("h_text"))
    return one.join(other.hint("merge"), "h").select("q", "h", "q_text", "h_text")


def verify_pairs(pairs: DataFrame, texts: Callable[[DataFrame, int], DataFrame], compare: Callable, max_bytes: int = 1 << 20) -> DataFrame:
    """Edges (a, b) among ``pairs(q, h)``."""
    return paired_texts(pairs, texts).mapInArrow(_pairs(compare, max_bytes), "a bigint, b bigint")


def open_groups(queries: DataFrame, members: DataFrame, texts: Callable[[DataFrame, int], DataFrame], first_link: Callable) -> DataFrame:
    """Edges between ``queries(q, gid)`` and ``members(gid, node)``: one link per query and group.

    A group has about ``GROUP`` members; queries of one group are cut into parts of about 1024, so no
    task gets an unbounded group.  Each text is fetched once and then goes to all its groups.
    """
    parts = queries.groupBy("gid").agg(F.ceil(F.count("*") / 1024).cast("int").alias("parts"))
    asked = queries.join(parts, "gid").groupBy(F.col("q").alias("node")).agg(F.collect_list(F.struct("gid", F.pmod(F.xxhash64("q"), F.col("parts").cast("bigint")).alias("part"))).alias("at"))
    held = members.join(parts, "gid").groupBy("node").agg(F.collect_list(F.struct("gid", "parts")).alias("at"))
    n, m = queries.count(), members.count()  # of what the lists hold in all
    left = texts(asked, n).select("node", "text", F.explode("at").alias("at")).select("at.gid", "at.part", "node", "text")
    right = texts(held, m).select("node", "text", F.explode("at").alias("at")).select("at.gid", F.explode(F.expr("sequence(0L, cast(at.parts - 1 as bigint))")).alias("part"), "node", "text")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        a, b = first_link(one["node"].to_pylist(), one["text"], two["node"].to_pylist(), two["text"])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("gid", "part").cogroup(right.groupBy("gid", "part")).applyInArrow(run, "a bigint, b bigint")


def _labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``rows`` with their node's component and the chunk of it (``gid``) that the node is in."""
    sizes = components.groupBy("component").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
    placed = components.join(sizes, "component").select("node", "component", F.xxhash64("component", F.pmod(F.xxhash64("node"), "chunks")).alias("gid"))
    alone = F.coalesce("component", "node"), F.coalesce("gid", F.xxhash64("node", F.lit(0)))
    return written(rows.join(placed, "node", "left").withColumns({"component": alone[0], "gid": alone[1]}), "labelled")


def _open(labelled: DataFrame) -> DataFrame:
    """Rows of the tokens under which some component asks for another one."""
    mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("asks").alias("asked"), F.bool_or("ix").alias("held")).where("lo < hi AND asked AND held").select("token")
    return written(labelled.join(mixed, "token"), "open")


def _crowds(open_rows: DataFrame, most: int = CROWD) -> DataFrame:
    """Tokens of more than ``most`` components."""
    return written(open_rows.groupBy("token").agg(F.count_distinct("component").alias("k")).where(F.col("k") > most).select("token"), "crowds")


def link_components(postings: DataFrame, texts: Callable[[DataFrame, int], DataFrame], compare: Callable, first_link: Callable, near: Column, may: Column | None, indexed: str | None = None, refine: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, apart: Callable[[DataFrame], DataFrame] | None = None, alone: Column | None = None) -> DataFrame:
    """(node, component) of all linked items.

    ``postings(token, node, n)``: n is the item's size.  With ``indexed`` (a boolean column of the
    postings) only such postings are the index and all postings probe it; else every posting is
    both.  ``near`` is a filter on (n, hn, c) for the first step, c the keys that item and anchor
    share there; ``may`` is the bound of the second step on (n, lo, hi, c): lo and hi are the sizes
    in the group, c the shared keys; None opens all groups met.

    A key that more than ``CROWD`` components share would ask for all pairs of them. ``refine``
    takes the items of such keys with the key's anchor, (node, h), and gives (node, h, rank, both,
    own, asks) and the table these are made from: two linked items of one anchor share a key in ``both``, or one has a key in ``asks``
    that the other has in ``own``.  Items are first compared with the item of the lowest rank of each
    such key, and components that then still share a key group by group.  ``apart`` first gives rows
    of crowded keys narrower keys that need no texts; ``postings`` then has a column ``places`` for it.
    With a column ``sig``, a signature of the item, ``near`` may use (sig, hsig), and ``alone`` is a
    bound on (n, lo, hi, sig, one, two) of an item and a key's group with signatures one to two.
    """
    postings = postings.withColumn("ix", F.col(indexed) if indexed else F.lit(True))
    sig = [c for c in ("sig",) if c in postings.columns]
    heads = postings.where("ix").groupBy("token").agg(F.min("node").alias("h"), F.max("node").alias("top"))
    if not indexed:
        heads = heads.where("h < top")
    shared = written(postings.join(heads, "token").where("h < top OR node <> h").select("token", "node", "n", "ix", F.lit(True).alias("asks"), F.lit(not indexed).alias("mutual"), "h", *sig, *["places"] * (apart is not None)), "shared")
    met = shared.where("node <> h").groupBy("node", "h").agg(F.max("n").alias("n"), F.count("*").alias("c"), *[F.min(c).alias(c) for c in sig])
    head_sizes = shared.where("node = h").groupBy("h").agg(F.max("n").alias("hn"), *[F.min(c).alias(f"h{c}") for c in sig]) if not indexed else shared.select("h", F.lit(0).alias("hn")).distinct()
    pairs = written(met.join(head_sizes, "h").where(near).select(F.col("node").alias("q"), "h"), "pairs")
    edges = written(verify_pairs(pairs, texts, compare), "links")
    components = connected_components(edges)
    labelled = _labelled(shared, components)
    drop(shared, pairs)
    open_rows = _open(labelled)
    drop(labelled)
    settled = None
    columns = ["token", "node", "n", "ix", "asks", "mutual", *sig]
    crowds = _crowds(open_rows) if refine is not None or apart is not None else None
    if apart is not None and not crowds.isEmpty():
        narrow = written(apart(open_rows.join(crowds, "token")), "narrow")
        heads = narrow.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        kept = [*columns, "h", "component"]
        before = open_rows
        open_rows = written(before.join(crowds, "token", "left_anti").select(kept).union(narrow.join(heads, "token").select(kept)), "open")
        drop(narrow, before)
        crowds = _crowds(open_rows, 4 * CROWD)
    if refine is not None and not crowds.isEmpty():
        settled = open_rows.join(crowds, "token", "left_anti")
        items = written(open_rows.join(crowds, "token").groupBy("node", "h").agg(F.max("n").alias("n"), F.first("component").alias("component"), *[F.min(c).alias(c) for c in sig]), "crowded")
        refined, source = refine(items.select(F.col("node").alias("q"), "h"))
        keyed = written(refined.join(items, ["node", "h"]).drop("h"), "refined")
        drop(source)
        kinds = (("both", True, True, True), ("own", True, False, False), ("asks", False, True, False))
        rows = [keyed.select(F.explode(c).alias("token"), "node", "n", F.lit(ix).alias("ix"), F.lit(asks).alias("asks"), F.lit(mutual).alias("mutual"), "component", "rank", *sig) for c, ix, asks, mutual in kinds]
        rows = rows[0].union(rows[1]).union(rows[2])
        heads = rows.groupBy("token").agg(F.min(F.when(F.col("ix"), F.struct("rank", "node", "component"))).alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("asks").alias("asked"))
        shared = written(rows.join(heads.where("lo < hi AND asked AND head IS NOT NULL").select("token", "head"), "token").drop("rank"), "shared")
        pairs = written(shared.where("asks AND component <> head.component").select(F.col("node").alias("q"), F.col("head.node").alias("h")).distinct(), "pairs")
        edges = written(edges.union(verify_pairs(pairs, texts, compare)), "links")
        components = connected_components(edges)
        labelled = _labelled(shared.drop("component", "head"), components)
        drop(items, keyed, shared, pairs)
        finer = _open(labelled)
        drop(labelled)
    if settled is not None:  # components have grown since
        before, open_rows = open_rows, _labelled(settled.select(columns).union(finer.select(columns)), components)
        drop(before, finer)
    elif "gid" not in open_rows.columns:
        open_rows = _labelled(open_rows.select(columns), components)
    groups = open_rows.where("ix").groupBy("token", F.col("gid").alias("group")).agg(F.first("component").alias("owner"), F.min("n").alias("lo"), F.max("n").alias("hi"), *[x for c in sig for x in (F.min(c).alias("one"), F.max(c).alias("two"))])
    asked = open_rows.where("asks").join(groups, "token").where("component > owner OR component < owner AND NOT mutual")
    met = (asked if alone is None else asked.where(alone)).groupBy("node", F.col("group").alias("gid")).agg(F.min("n").alias("n"), F.max("n").alias("top_n"), F.count("*").alias("c"))
    sizes = open_rows.where("ix").groupBy("gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # an item with several sizes (one id, several texts) is not bounded
    bound = met if may is None else met.join(sizes, "gid").where(may | (F.col("n") < F.col("top_n")))
    wanted = written(bound.select(F.col("node").alias("q"), "gid"), "wanted")
    if wanted.isEmpty():
        return components
    members = written(open_rows.where("ix").select("gid", "node").distinct().join(wanted.select("gid").distinct(), "gid", "left_semi"), "members")
    more = written(open_groups(wanted, members, texts, first_link), "links")
    drop(open_rows, members, wanted)
    return connected_components(edges.union(more))
