"""Linked records: groups by star contraction, leakage-safe split proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanwise.functions.scalars import content_group_id
from spanwise.operators.skew import hot_keys, lookup
from spanwise.session import cut, release


def linked_groups(edges: DataFrame, a: str, b: str, max_rounds: int = 100, hot_rows: int = 1_000_000) -> DataFrame:
    """(id, group_id): ids linked directly or through others with the smallest id of their group.

    Alternates large stars (larger neighbours to the smallest neighbour) and
    small stars (smaller neighbours to it) until the edges form stars. Null and
    self links link nothing.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = cut(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rows = 2 * now.count()
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        hot = hot_keys(low, ["u"], "n", rows, hot_rows)  # centres of stars with very many ends
        low = low.select("u", "m")
        large = lookup(both.where("v > u"), low, ["u"], hot, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = now.groupBy("u").agg(F.min("v").alias("v"))
        large = large.unionByName(kept.join(low, "u").select("u", F.least("v", "m").alias("v"))).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            roots = new.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
            return new.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(roots)
        release(now)
        now = new
    raise RuntimeError(f"links still move after {max_rounds} rounds")


def annotation_consistency(members: DataFrame, group: str, label: Column) -> DataFrame:
    """(group, members, verdict) of the annotations of a group's copies.

    `label`: an array of rows, null for a copy without labels. NO_LABELS without any,
    ONLY_ONE_LABELED_COPY if one of several has labels, else the labels there
    are: IDENTICAL_ANNOTATIONS, REORDERED_EQUIVALENT_ANNOTATIONS (equal but for
    their order) or CONFLICTING_ANNOTATIONS. Compared by hash, so a group is never gathered.
    """
    form = lambda x: F.when(label.isNotNull(), F.sha2(F.to_json(x), 256))
    # Four aggregates that need no distinct values: labels are all equal if their least and greatest forms are.
    rows = members.select(group, form(label).alias("form"), form(F.array_sort(label)).alias("set"))
    out = rows.groupBy(group).agg(F.count("*").alias("members"), F.count("form").alias("labelled"), *(f(c).alias(f"{n}_{c}") for c in ("form", "set") for n, f in (("low", F.min), ("high", F.max))))
    verdict = (
        F.when(F.col("labelled") == 0, "NO_LABELS").when((F.col("labelled") == 1) & (F.col("members") > 1), "ONLY_ONE_LABELED_COPY")
        .when(F.col("low_form") == F.col("high_form"), "IDENTICAL_ANNOTATIONS").when(F.col("low_set") == F.col("high_set"), "REORDERED_EQUIVALENT_ANNOTATIONS")
        .otherwise("CONFLICTING_ANNOTATIONS")
    )
    return out.select(group, "members", verdict.alias("verdict"))


def divided_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows lie in more than one split; empty for a safe assignment."""
    return rows.where(F.col(group).isNotNull() & F.col(split).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def propose_split(rows: DataFrame, links: DataFrame, label: Column) -> DataFrame:
    """(record, component, included, proposed_split, reason): one split for all linked records, copies once.

    rows: (record, split, path, eligible, duplicate); links: (a, b) between
    records. Copies (equal `duplicate`) whose annotations conflict are held back;
    of other copies the eligible one that comes first stays: test before valid
    before train, then the path without case, then as it is. Records linked directly
    or through others, ineligible ones included, form a component; its included
    members stay in the split of the first of them, others are left out. An
    ineligible record has neither split nor reason.
    """
    protect = F.when(F.col("split") == "test", 0).when(F.col("split") == "valid", 1).when(F.col("split") == "train", 2)
    base = cut(rows.select("record", "split", F.coalesce(F.col("eligible") & protect.isNotNull(), F.lit(False)).alias("eligible"), "duplicate", protect.alias("protect"), F.struct(protect, F.lower("path"), F.col("path"), F.col("record")).alias("place"), label.alias("label")))
    copies = base.where("duplicate is not null")
    verdicts = annotation_consistency(copies, "duplicate", F.col("label"))
    heads = copies.groupBy("duplicate").agg(F.min("record").alias("head"), F.min(F.when(F.col("eligible"), F.col("place"))).alias("first")).join(verdicts, "duplicate")
    heads = heads.select("duplicate", "head", "first", (F.col("verdict") == "CONFLICTING_ANNOTATIONS").alias("conflict"))
    joined = base.join(heads, "duplicate", "left")
    held = F.coalesce("conflict", F.lit(False))
    surplus = F.coalesce(F.col("place") != F.col("first"), F.lit(False))
    reason = F.when(~F.col("eligible"), None).when(held, "ANNOTATION_CONFLICT_HUMAN_REVIEW_REQUIRED").when(surplus, "EQUIVALENT_EXACT_DUPLICATE_REDUNDANT")
    joined = cut(joined.select("record", "split", "eligible", "protect", "place", "head", reason.alias("reason")))
    own = joined.where("head is not null and head <> record").select(F.col("head").alias("a"), F.col("record").alias("b"))
    groups = linked_groups(links.select("a", "b").unionByName(own), "a", "b").select(F.col("id").alias("record"), F.col("group_id").alias("component"))
    named = joined.join(groups, "record", "left")
    kept = F.col("eligible") & F.col("reason").isNull()
    target = named.where(kept & F.col("component").isNotNull()).groupBy("component").agg(F.min("protect").alias("target"))
    out = named.join(target, "component", "left")
    moved = kept & F.coalesce(F.col("target") != F.col("protect"), F.lit(False))
    reason = F.when(moved, "APPROVED_LEAKAGE_GROUP_OTHER_SPLIT_RETAINED").otherwise(F.col("reason"))
    included = kept & ~moved
    return out.select("record", "component", included.alias("included"), F.when(included, F.col("split")).alias("proposed_split"), reason.alias("reason"))


def component_names(members: DataFrame) -> DataFrame:
    """(component, name): LG_ and the hash of a component's sorted members, one to a line; members: (component, member).

    A name depends on every member's text, so each component's texts meet in one row; they are paths, not records.
    """
    return members.groupBy("component").agg(content_group_id(F.collect_list("member")).alias("name"))
