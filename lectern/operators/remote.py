"""Planning the copy of a remote course tree into local folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import ensure_checkpoint_dir

MIN_RATIO = 0.85


def with_id(target: Column, content_id: Column) -> Column:
    """``a/b.pdf`` -> ``a/b (id).pdf``."""
    stem = F.regexp_replace(target, r"(?<=[^/])\.[^./]+$", "")
    suffix = F.substring(target, F.length(stem) + 1, F.length(target))
    return F.concat(stem, F.lit(" ("), content_id, F.lit(")"), suffix)


def target_path(module: Column, folders: Column, file_name: Column) -> Column:
    """Local path of a remote file: cleaned folder segments and file name below the module folder."""
    inner = F.transform(folders, lambda s: X.safe_segment(s))
    return F.array_join(F.concat(F.array(module), inner, F.array(X.safe_segment(file_name, 120))), "/")


def dedupe_targets(files: DataFrame, claimed: DataFrame, order: str = "ord") -> DataFrame:
    """Files whose target is taken (by earlier state, or by an earlier file of the listing) get their id in the name.

    Only the first claimant of each target is looked up, so a name shared by a third of all files stays one small row.
    """
    first = files.groupBy("target").agg(F.min(order).alias("_first"))
    taken = claimed.select(F.col("path").alias("target")).distinct().withColumn("_taken", F.lit(True))
    j = files.join(first, "target").join(taken, "target", "left")
    clash = F.coalesce("_taken", F.lit(False)) | (F.col(order) != F.col("_first"))
    return (j.withColumn("target", F.when(clash, with_id(F.col("target"), F.col("content_id")))
                         .otherwise(F.col("target"))).drop("_first", "_taken"))


def plan_sync(remote: DataFrame, state: DataFrame, local: DataFrame) -> DataFrame:
    """Add ``action`` and the resolved ``path`` to remote files.

    ``remote``: key, target, modified, text_sha (NULL for binary files). ``state``: key, path, modified of the last
    run. ``local``: path, sha. Actions: unchanged, deleted_locally, changed, new, adopt (a file of yours sits there).
    """
    s = state.select("key", F.col("path").alias("_path"), F.col("modified").alias("_modified"), F.lit(True).alias("_s"))
    j = remote.join(s, "key", "left").withColumn("path", F.coalesce("_path", "target"))
    j = j.join(local.select("path", F.col("sha").alias("_sha"), F.lit(True).alias("_l")), "path", "left")
    known, here = F.col("_s").isNotNull(), F.col("_l").isNotNull()
    same = F.col("_modified").eqNullSafe(F.col("modified"))
    kept = F.col("text_sha").isNull() | F.col("text_sha").eqNullSafe(F.col("_sha"))
    action = (F.when(known & same & ~here, "deleted_locally").when(known & same & kept, "unchanged")
              .when(known, "changed").when(here, "adopt").otherwise("new"))
    return j.withColumn("action", action).drop("_path", "_modified", "_s", "_sha", "_l")


def adopt_outcome(adopted: DataFrame, fetched: DataFrame, local: DataFrame) -> DataFrame:
    """What happens to files to adopt: identical ones are already there, others are saved beside yours.

    ``fetched``: key, sha of the downloaded content.
    """
    j = (adopted.join(fetched.select("key", F.col("sha").alias("_new")), "key")
         .join(local.select("path", F.col("sha").alias("_have")), "path", "left"))
    same = F.col("_new").eqNullSafe(F.col("_have"))
    return (j.withColumn("outcome", F.when(same, "already_had").otherwise("downloaded"))
            .withColumn("path", F.when(same, F.col("path")).otherwise(with_id(F.col("path"), F.col("content_id"))))
            .drop("_new", "_have"))


def clean_course_name(name: Column) -> Column:
    """Drop the class-group suffix: ``Probability 2__5DS1`` -> ``Probability 2``."""
    return F.trim(F.regexp_replace(name, r"__[A-Za-z0-9]+$", ""))


def _allowed(length: Column) -> Column:
    """Most edits a name of this length can differ by and still reach MIN_RATIO against the longer of the two."""
    return F.floor(F.floor(length / MIN_RATIO + 1e-9) * (1 - MIN_RATIO) + 1e-9).cast("int")


def _segment(i: Column, length: Column, n: Column) -> tuple[Column, Column]:
    start = F.floor(i * length / n).cast("int")
    return start, F.floor((i + 1) * length / n).cast("int") - start


def close_names(names: DataFrame, targets: DataFrame) -> DataFrame:
    """Best target per name with edit similarity of at least MIN_RATIO: name, target, ratio.

    Exact, without comparing everything with everything: a target cut into d + 1 segments keeps at least one of them
    intact under d edits, so names and targets meet in an equi-join on (target length, segment number, segment text).
    """
    t = targets.select(F.col("target"), F.length("target").alias("_l")).distinct()
    t = t.select("target", "_l", F.explode(F.sequence(F.lit(0), _allowed(F.col("_l")))).alias("_i"))
    start, size = _segment(F.col("_i"), F.col("_l"), _allowed(F.col("_l")) + 1)
    t = t.withColumn("_seg", F.substring(F.col("target"), start + 1, size))

    n = names.select("name", F.length("name").alias("_m")).distinct().filter("_m > 0")
    n = n.select("name", "_m", F.explode(F.sequence(F.ceil(F.col("_m") * MIN_RATIO - 1e-9).cast("int"),
                                                    F.floor(F.col("_m") / MIN_RATIO + 1e-9).cast("int"))).alias("_l"))
    n = n.withColumn("_d", _allowed(F.col("_l")))
    n = n.select("name", "_l", "_d", F.explode(F.sequence(F.lit(0), F.col("_d"))).alias("_i"))
    start, size = _segment(F.col("_i"), F.col("_l"), F.col("_d") + 1)
    n = n.withColumn("_size", size).select("name", "_l", "_i", "_size", F.explode(F.sequence(
        F.greatest(start - F.col("_d"), F.lit(0)), F.greatest(start, F.lit(0)) + F.col("_d"))).alias("_p"))
    n = n.withColumn("_seg", F.substring(F.col("name"), F.col("_p") + 1, F.col("_size")))
    n = n.filter(F.length("_seg") == F.col("_size")).select("name", "_l", "_i", "_seg").distinct()

    pairs = n.join(t, ["_l", "_i", "_seg"]).select("name", "target").distinct()
    ratio = 1 - F.levenshtein("name", "target") / F.greatest(F.length("name"), F.length("target"))
    scored = pairs.withColumn("ratio", ratio).filter(F.col("ratio") >= MIN_RATIO - 1e-9)
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "target")).alias("_b"))
    return best.select("name", F.col("_b.target").alias("target"), (-F.col("_b.r")).alias("ratio"))


def match_folders(courses: DataFrame, folders: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add the inbox ``folder`` of each course (id, name, course_id): override, then same name, then close name.

    ``overrides`` (key, folder) may name the full name, the cleaned name, the id or the course id, in that order.
    Close names use edit similarity.
    """
    c = courses.withColumn("_clean", clean_course_name(F.col("name"))).withColumn("_fold", F.lower("_clean"))
    keyed = overrides.groupBy("key").agg(F.min("folder").alias("folder"))
    tiers = []
    for i, col in enumerate(["name", "_clean", "id", "course_id"]):
        side = keyed.select(F.col("key").alias(f"_k{i}"), F.col("folder").alias(f"_f{i}"))
        c = c.join(side, F.col(col).cast("string") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        tiers.append(f"_f{i}")
    named = folders.groupBy(F.lower("folder").alias("_fold")).agg(F.max("folder").alias("_same"))
    c = c.join(named, "_fold", "left")
    c = c.withColumn("folder", F.coalesce(*tiers, "_same")).drop(*tiers, "_same")
    open_names = c.filter("folder IS NULL").select(F.col("_fold").alias("name"))
    close = close_names(open_names, named.select(F.col("_fold").alias("target"))).select(
        F.col("name").alias("_fold"), F.col("target").alias("_t"))
    names = named.select(F.col("_fold").alias("_t"), F.col("_same").alias("_near"))
    j = c.join(close, "_fold", "left").join(names, "_t", "left")
    return j.withColumn("folder", F.coalesce("folder", "_near")).drop("_t", "_near", "_clean", "_fold")


def select_courses(courses: DataFrame, only: str | None = None) -> DataFrame:
    """Courses to sync: available both ways (unknown counts as available), mapped, and matching ``only`` if given."""
    ok = [F.coalesce(F.col(c) != "No", F.lit(True)) for c in ("membership_available", "course_available")]
    rows = courses.filter(ok[0] & ok[1] & F.col("folder").isNotNull())
    if only:
        want = F.lower(F.lit(only))
        rows = rows.filter((F.lower("folder") == want) | (F.lower(clean_course_name(F.col("name"))) == want))
    return rows


def flatten_tree(items: DataFrame) -> DataFrame:
    """Items of a content tree with the titles of their ancestors: id, title, folders, depth.

    An unavailable item hides everything below it; so does a missing parent, or a circle. Pointer doubling: each round
    joins every item to the one its pointer names and takes over that one's pointer and titles, so that pointers reach
    twice as far each time. A tree of a thousand levels takes ten joins; rounds are checkpointed.
    """
    ensure_checkpoint_dir(items.sparkSession)
    live = items.filter(F.coalesce(F.col("available"), F.lit(True)))
    none = F.array().cast("array<string>")
    state = live.select("id", "title", F.col("parent_id").alias("up"), none.alias("folders")).checkpoint()
    most = state.count()
    reach = 1
    while reach <= most and not state.filter("up is not null").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.concat("folders", F.array("title")).alias("_folders"))
        moved = state.filter("up is not null").join(above, "up").select(
            "id", "title", F.col("_up").alias("up"), F.concat("_folders", "folders").alias("folders"))
        state = state.filter("up is null").unionByName(moved).checkpoint()
        reach *= 2
    return state.filter("up is null").select("id", "title", "folders", F.size("folders").alias("depth"))


def latest_by_key(items: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of every key; one aggregation, no window."""
    cols = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(key, "_r.*")
