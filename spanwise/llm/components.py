"""Consolidating pairwise matches into groups.

Minimum labels are propagated across edges and accelerated with pointer
jumping: every node keeps a parent label; each round takes, over its edges, the
smallest grandparent label seen, hooks the node's own tree and itself onto it,
and then jumps to the parent's parent. Each round is checkpointed in the shared
folder, and the round before it deleted; the loop ends when no label changes.

As a large group converges, all its rows carry one label, and a hub is the end
of very many edges. Such keys, over a thousandth of the rows and so fewer than
a thousand, are looked up by broadcast and their rows spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanwise.functions.text import plain, unify_split
from spanwise.operators.skew import hot_keys, lookup
from spanwise.session import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200, hot_rows: int = 1_000_000) -> DataFrame:
    """(id, group_id): every id that an edge links to another, with the smallest id of its component.

    Null ends and edges from an id to itself link nothing; repeated and reversed
    edges count once; no edges give no row. Raises if labels still change after
    `max_rounds` (rounds grow with the logarithm of the longest chain).
    """
    one = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b")
    one = cut(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Round 0: the smallest neighbour, if smaller.
    degrees = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("n"))
    hubs = hot_keys(degrees, ["b"], "n", 2 * one.count(), hot_rows)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    nodes = labels.count()
    for _ in range(max_rounds):
        seen = _jump(labels, nodes, hot_rows)  # id, label, up: the label's label
        offers = lookup(both, seen.select(F.col("id").alias("b"), "up"), ["b"], hubs, F.col("a"))
        offers = offers.groupBy(F.col("a").alias("id")).agg(F.min("up").alias("low"))
        known = seen.join(offers, "id").select("id", "label", F.least("up", "low").alias("low"))
        # What a node has seen goes to its own label too: trees hook onto trees.
        hooked = known.groupBy(F.col("label").alias("id")).agg(F.min("low").alias("hook"))
        moved = known.join(hooked, "id", "left").select("id", F.col("label").alias("was"), F.least("low", "hook", "label").alias("label"))
        moved = cut(moved)
        changed = not moved.where("was <> label").isEmpty()
        release(labels)
        labels = moved
        if not changed:
            release(one)
            return labels.select("id", F.col("label").alias("group_id"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _jump(labels: DataFrame, nodes: int, hot_rows: int) -> DataFrame:
    """Adds the label of each label; labels that very many rows carry are spread."""
    hot = hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), ["label"], "n", nodes, hot_rows)
    up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
    return lookup(labels.select("id", "label"), up, ["label"], hot, F.col("id"))


def upheld_links(review: DataFrame, manifest: DataFrame, rejected: str = "REJECT_LEAKAGE_CANDIDATE") -> DataFrame:
    """(a, b): image ids of the pairs that reviewers upheld.

    A row counts if human_outcome is not null and not `rejected`, and
    review_authorized is true. Names are compared plainly within the unified
    split; a name that two images share stands for the smaller id; names without
    an image and pairs of one image link nothing.
    """
    images = manifest.select(unify_split(F.col("split")).alias("split"), plain(F.col("image_filename")).alias("name"), F.col("image_id").cast("bigint").alias("image_id"))
    images = images.where("split is not null and name is not null").groupBy("split", "name").agg(F.min("image_id").alias("image_id"))

    def end(side: str) -> tuple[Column, Column]:
        return unify_split(F.col(f"split_{side}")).alias(f"s_{side}"), plain(F.col(f"image_{side}")).alias(f"n_{side}")

    upheld = review.where(F.col("human_outcome").isNotNull() & (F.col("human_outcome") != rejected) & F.col("review_authorized")).select(*end("a"), *end("b")).distinct()
    for side in "ab":
        ids = images.select(F.col("split").alias(f"s_{side}"), F.col("name").alias(f"n_{side}"), F.col("image_id").alias(side))
        upheld = upheld.join(ids, [f"s_{side}", f"n_{side}"])
    return upheld.where("a <> b").select("a", "b")
