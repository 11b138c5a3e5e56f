"""Selection, inventory, comparison and validation of content items, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import is_blank, relative_path, relative_path_error, same_path, selected

COMPARED = ("source", "local_path", "artifact_path", "media_type", "content_hash")


def select_items(items: DataFrame, include=(), exclude=(), path: str = "relative_path") -> DataFrame:
    """Items whose path matches an include and no exclude; a narrow filter, no second listing."""
    return items.where(selected(F.col(path), include, exclude))


def exclude_items(items: DataFrame, excluded: DataFrame, path: str = "relative_path") -> DataFrame:
    """Items whose path is equivalent to none of ``excluded``: an anti-join."""
    gone = excluded.select(same_path(F.col(path)).alias("excluded_path")).distinct()
    return items.join(gone, same_path(F.col(path)) == F.col("excluded_path"), "left_anti")


def keep_first(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with equal keys the first by ``order``; combines before it shuffles, so a hot key is no burden."""
    rest = [c for c in items.columns if c not in keys]
    first = F.min(F.struct(order, *(c for c in rest if c != order))).alias("first_row")
    return items.groupBy(*keys).agg(first).select(*(F.col(k) if k in keys else F.col(f"first_row.{k}").alias(k) for k in items.columns))


def inventory(items: DataFrame) -> DataFrame:
    """One item per relative path, the first listed, in path order."""
    return keep_first(items, ["relative_path"], "list_seq").drop("list_seq").orderBy("relative_path")


def manifest_items(items: DataFrame, artifact_path: Column, failed: Column) -> DataFrame:
    """Items with the path of their artifact, null where materialising failed."""
    return items.select("source", "relative_path", "local_path", F.when(~failed, artifact_path).alias("artifact_path"), "media_type", "content_hash")


def compare_items(prior: DataFrame, current: DataFrame, columns=COMPARED) -> DataFrame:
    """relative_path, status: unchanged, changed, added or removed."""
    p = prior.select("relative_path", F.struct(*columns).alias("was"))
    c = current.select("relative_path", F.struct(*columns).alias("is"))
    same = F.lit(True)
    for name in columns:
        same = same & F.col(f"was.{name}").eqNullSafe(F.col(f"is.{name}"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return p.join(c, "relative_path", "full_outer").select("relative_path", status.alias("status"))


def resume_verdict(prior: DataFrame, current: DataFrame, columns=COMPARED) -> DataFrame:
    """One row, ``reusable``: both hold the same items in the same order.

    Both sides are sorted by a unique path, so equal positions mean equal paths,
    and a join on the path decides without numbering all rows.  No items on
    either side are reusable.
    """
    return compare_items(prior, current, columns).agg(F.coalesce(F.bool_and(F.col("status") == "unchanged"), F.lit(True)).alias("reusable"))


def order_violations(items: DataFrame, groups: list[str], position: str, key: str) -> DataFrame:
    """Per group, how many adjacent rows do not rise strictly in ``key``.

    Rows are dealt by ranges of (group, position), so a group may span many
    tasks: each range is compared within itself, and the first key of each with
    the last of the one before.
    """
    ranged = items.select(*groups, position, key).repartitionByRange(*groups, position).withColumn("order_range", F.spark_partition_id())
    before = F.lag(key).over(Window.partitionBy(*groups, "order_range").orderBy(position))
    ends = (
        ranged.withColumn("not_rising", before >= F.col(key))
        .groupBy(*groups, "order_range")
        .agg(
            F.count_if("not_rising").alias("inside"),
            F.count(F.lit(1)).alias("here"),
            F.min_by(F.struct(key), position).alias("first_row"),
            F.max_by(F.struct(key), position).alias("last_row"),
        )
    )
    earlier = F.lag(F.col(f"last_row.{key}")).over(Window.partitionBy(*groups).orderBy("order_range"))
    marked = ends.withColumn("across", earlier >= F.col(f"first_row.{key}"))
    return marked.groupBy(*groups).agg((F.sum("inside") + F.count_if("across")).alias("violations"), F.sum("here").alias("n_items"))


# Rules on the header of a prior manifest, in the order of their precedence; 1 and 2 are about the file itself.
HEADER_RULES = {
    3: ("MalformedState", "the manifest has another version"),
    4: ("MalformedState", "the manifest is of an incomplete fetch"),
    5: ("MalformedState", "the manifest has a blank source, source path or artifact root"),
    6: ("MalformedState", "the manifest's artifacts lie outside of this destination"),
    7: ("InvalidCache", "the manifest's artifact root does not exist"),
}


def header_rule(version: int) -> Column:
    """The first rule that a manifest's header breaks, or null; over the columns of one row per manifest."""
    c = F.col
    blank = lambda n: c(n).isNull() | is_blank(c(n))
    return (
        F.when(c("version") != version, 3)
        .when(~c("complete"), 4)
        .when(blank("source") | blank("source_path") | blank("artifact_root"), 5)
        .when(c("copied") & (same_path(c("artifact_root")) != same_path(c("cache"))), 6)
        .when(~c("root_exists"), 7)
    )


# Validation rules of a prior manifest's items, in the order of their precedence.
RULES = {
    8: ("MalformedState", "an item has blank fields"),
    9: ("MalformedState", "an item's relative path is not normalized"),
    10: ("MalformedState", "an item has no artifact"),
    11: ("MalformedState", "an artifact is not where it belongs"),
    12: ("InvalidCache", "an artifact is missing"),
    13: ("InvalidCache", "an artifact cannot be read"),
    14: ("InvalidCache", "an artifact has changed"),
    15: ("MalformedState", "the manifest's items are not in strict order"),
}


def item_rule(copied: Column, root: Column) -> Column:
    """The first rule that an item breaks, or null; needs columns pos, exists, readable and actual_hash beside M6's."""
    rel = F.col("relative_path")
    blank = lambda c: F.col(c).isNull() | is_blank(F.col(c))
    expected = F.when(copied, F.concat_ws("/", root, rel)).otherwise(F.col("local_path"))
    return (
        F.when(blank("source") | blank("local_path") | blank("content_hash"), 8)
        .when(relative_path_error(rel, convert_first=True).isNotNull() | (relative_path(rel) != rel), 9)
        .when(blank("artifact_path"), 10)
        .when(same_path(F.col("artifact_path")) != same_path(expected), 11)
        .when(~F.col("exists"), 12)
        .when(~F.col("readable"), 13)
        .when(F.col("actual_hash") != F.col("content_hash"), 14)
    )


def validate_items(items: DataFrame, copied: Column, root: Column) -> DataFrame:
    """manifest_id, n_items, first_pos, first_rule: items are judged in order, the order of their keys after all of them."""
    judged = items.withColumn("rule", item_rule(copied, root))
    first = F.min(F.when(F.col("rule").isNotNull(), F.struct("pos", "rule")))
    judged = judged.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n_items"), first.alias("first_bad"))
    falls = order_violations(items, ["manifest_id"], "pos", "relative_path").select("manifest_id", (F.col("violations") > 0).alias("unordered"))
    rule = F.coalesce(F.col("first_bad.rule"), F.when(F.coalesce("unordered", F.lit(False)), 15))
    return judged.join(falls, "manifest_id", "left").select("manifest_id", "n_items", F.col("first_bad.pos").alias("first_pos"), rule.alias("first_rule"))


def outcome_counts(outcomes: DataFrame, groups: list[str]) -> DataFrame:
    """Completed, skipped and failed items of each group, and whether it is complete."""
    of = lambda s: F.count_if(F.col("status") == s)
    return outcomes.groupBy(*groups).agg(
        of("completed").alias("n_completed"), of("skipped").alias("n_skipped"), of("failed").alias("n_failed"), (of("failed") == 0).alias("complete")
    )


def first_error(rules: list[tuple[Column, str, str]]) -> Column:
    """The first rule that applies, as ``kind: message``; null if none does."""
    out = None
    for condition, kind, message in rules:
        out = (F.when if out is None else out.when)(condition, F.lit(f"{kind}: {message}"))
    return out


def request_error() -> Column:
    """Request validation over columns that describe a request; the first failure counts.

    process_content() judges its requests by the same rules.
    """
    c = F.col
    fetch, downstream = c("fetch"), c("sanitize") | c("ai_augment") | c("content_map")
    local = ~c("is_website")
    return first_error(
        [
            (~fetch & ~downstream, "InvalidConfiguration", "no stage is enabled"),
            (c("max_concurrency") <= 0, "InvalidConfiguration", "max_concurrency must be over 0"),
            (fetch & c("is_website") & ~c("same_host_only"), "InvalidConfiguration", "fetching a website needs same_host_only"),
            (fetch & local & ~c("source_exists"), "InvalidConfiguration", "the source is neither a file nor a directory"),
            (c("ai_augment") & (is_blank(c("augment_provider")) | is_blank(c("augment_model"))), "InvalidConfiguration", "AI augment needs a provider and a model"),
            (c("content_map") & (is_blank(c("map_provider")) | is_blank(c("map_model"))), "InvalidConfiguration", "the content map needs a provider and a model"),
            (~fetch & downstream & ~c("cache_exists") & ~c("manifest_exists"), "MalformedState", "there is no prior fetch at the destination"),
            (c("is_website") & ~fetch, "InvalidConfiguration", "a website needs the fetch stage"),
            (c("is_website"), "Unsupported", "websites are not fetched; use the page operators on a table of pages"),
        ]
    )
