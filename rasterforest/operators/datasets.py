"""Pairing, splits, manifests, content keys and fingerprints as relational operators."""

from __future__ import annotations

import functools
import json
import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import numbered_within
from ..sources.raster import image_header
from ..tables import KEY, portions


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "gif")) -> DataFrame:
    """path, name, stem and ext of the files below a folder; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    df = df.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return df.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))).where(F.col("ext").isin(*extensions))


def _refuse(df: DataFrame, column: str, message: str) -> None:
    if rows := df.select(column).take(3):
        raise ValueError(f"{message}: {', '.join(str(r[0]) for r in rows)}")


def _repeated(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().where("count > 1")


def pair_folders(inputs: DataFrame, targets: DataFrame, numeric: bool = False, unmatched: str = "error") -> DataFrame:
    """sample_id, input_path, target_path of the files (stem, path) of equal stems; numeric ids compare as numbers.

    Repeated ids in a role always fail; unmatched files fail, or are left
    out with 'ignore' and, named in a warning, with 'warn'.
    """
    key = F.col("stem").cast("long").cast("string") if numeric else F.col("stem")
    a, b = inputs.select(key.alias("sample_id"), F.col("path").alias("input_path")), targets.select(key.alias("sample_id"), F.col("path").alias("target_path"))
    _refuse(_repeated(a.unionByName(b.select("sample_id", F.lit(None).cast("string").alias("input_path"))).where("input_path IS NOT NULL"), "sample_id"), "sample_id", "repeated input ids")
    _refuse(_repeated(b, "sample_id"), "sample_id", "repeated target ids")
    both = a.join(b, "sample_id", "full")
    lost = both.where("input_path IS NULL OR target_path IS NULL")
    if unmatched not in ("error", "warn", "ignore"):
        raise ValueError(f"unknown rule for unmatched files: {unmatched!r}")
    if unmatched == "error":
        _refuse(lost, "sample_id", "unmatched ids")
    if unmatched == "warn" and (rows := lost.select("sample_id").orderBy("sample_id").take(3)):
        warnings.warn(f"unmatched ids are left out: {', '.join(str(r[0]) for r in rows)}", stacklevel=2)
    return both.where("input_path IS NOT NULL AND target_path IS NOT NULL")


def pair_suffixes(files: DataFrame, input_suffix: str, target_suffix: str, prefix: bool = False) -> DataFrame:
    """Pairs from one folder by literal suffixes (or prefixes) of the stem."""
    has = (lambda s: F.startswith("stem", F.lit(s))) if prefix else (lambda s: F.endswith("stem", F.lit(s)))
    cut = (lambda s: F.expr(f"substring(stem, {len(s) + 1})")) if prefix else (lambda s: F.expr(f"left(stem, length(stem) - {len(s)})"))
    f = files.withColumn("is_in", has(input_suffix)).withColumn("is_target", has(target_suffix))
    _refuse(f.where("is_in AND is_target"), "stem", "files of both roles")
    a, b = f.where("is_in").select(cut(input_suffix).alias("stem"), "path"), f.where("is_target").select(cut(target_suffix).alias("stem"), "path")
    _refuse(a.unionByName(b).where("stem = ''"), "path", "empty ids")
    return pair_folders(a, b)


def pair_first_match(inputs: DataFrame, targets: DataFrame, extensions: list[str]) -> DataFrame:
    """Each input with the target of the first listed extension that exists."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    t = targets.withColumn("rank", rank).where("rank > 0").groupBy("stem").agg(F.min_by("path", "rank").alias("target_path"))
    return inputs.select("stem", F.col("path").alias("input_path")).join(t, "stem").withColumnRenamed("stem", "sample_id")


def pair_explicit(pairs: DataFrame, ordering: str = "provided") -> DataFrame:
    """Explicit pairs (sample_id, input_path, target_path, position) ordered as provided, as text or as numbers."""
    _refuse(_repeated(pairs, "sample_id"), "sample_id", "repeated ids")
    order = {"provided": "position", "textual": "sample_id", "numeric": F.col("sample_id").cast("long")}[ordering]
    return pairs.orderBy(order)


def audit_pairs(spark: SparkSession, pairs: DataFrame, root: str, metadata: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """sample_id, role, path, sha256, length, n_rows, n_cols, n_channels and dtype of every paired file.

    Fails on paths outside root, files that are missing or no images by their first bytes, and
    pairs of different sides. metadata takes the audit and returns it with more columns.
    """
    long = pairs.select("sample_id", F.explode(F.array(F.struct(F.lit("input").alias("role"), F.col("input_path").alias("path")), F.struct(F.lit("target").alias("role"), F.col("target_path").alias("path")))).alias("f")).select("sample_id", "f.*")
    outside = F.coalesce(~F.startswith("path", F.lit(root.rstrip("/") + "/")) | F.contains("path", F.lit("/../")), F.lit(True))
    _refuse(long.where(outside), "path", "paths outside the root")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.join(long.select("path").distinct(), "path", "left_semi").select("path", F.sha2("content", 256).alias("sha256"), "length", image_header(F.col("content")).alias("h"))
    out = long.join(found.select("path", "sha256", "length", "h.*"), "path", "left").select("sample_id", "role", "path", "sha256", "length", "n_rows", "n_cols", "n_channels", "dtype")
    sides = F.array("n_rows", "n_cols")
    bad = out.groupBy("sample_id").agg(F.count_if(F.col("sha256").isNull()).alias("lost"), F.count_if(F.col("n_rows").isNull()).alias("odd"), (F.min(sides) != F.max(sides)).alias("unlike"))
    for rule, message in (("lost > 0", "missing files"), ("odd > 0", "files that are no images"), ("unlike", "pairs of different shapes")):
        _refuse(bad.where(rule), "sample_id", message)
    return metadata(out) if metadata else out


def validate_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """sample_id, role and issue of files (path, sha256) that are missing or changed."""
    f = files.select("path", F.col("sha256").alias("now"))
    issue = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return manifest.join(f, "path", "left").select("sample_id", "role", issue.alias("issue")).where("issue IS NOT NULL")


def resolve_pairs(samples: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """A split's samples in their saved order."""
    return splits.where(F.col("split") == split).join(samples, "sample_id").orderBy("position")


def validate_splits(samples: DataFrame, splits: DataFrame, groups: DataFrame | None = None, complete: bool = False, allow_empty: bool = True, names: list[str] | None = None, rows: int = 1 << 18) -> DataFrame:
    """Violations (issue, id): repeated, unknown, shared between splits, unassigned, groups that cross splits or miss ids, empty splits.

    A task holds about so many rows of each table.
    """
    issue = lambda df, c, text: df.select(F.lit(text).alias("issue"), F.col(c).cast("string").alias("id"))
    # Dealt by number of rows: ids compress so well that Spark would put most of a table into one task.
    n = max(portions(df, rows) for df in (samples, splits, groups) if df is not None)
    dealt = lambda df: df.repartition(n, "sample_id").hint("merge")
    samples, splits = dealt(samples), dealt(splits)
    out = issue(_repeated(samples, "sample_id"), "sample_id", "repeated sample")
    out = out.unionByName(issue(splits.groupBy("split", "sample_id").count().where("count > 1"), "sample_id", "repeated in split"))
    out = out.unionByName(issue(splits.join(samples, "sample_id", "left_anti"), "sample_id", "unknown"))
    out = out.unionByName(issue(splits.groupBy("sample_id").agg(F.count_distinct("split").alias("n")).where("n > 1"), "sample_id", "shared"))
    if complete:
        out = out.unionByName(issue(samples.join(splits, "sample_id", "left_anti"), "sample_id", "unassigned"))
    if groups is not None:
        groups = dealt(groups)
        met = splits.join(groups, "sample_id").select("group_id", "split", F.pmod(F.xxhash64("sample_id"), F.lit(32)).alias("_part"))
        # A group of very many samples is reduced in parts before it meets in one task.
        met = met.repartition(n, "group_id", "split", "_part").distinct().repartition(n, "group_id")
        crossing = met.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
        out = out.unionByName(issue(crossing, "group_id", "group crosses")).unionByName(issue(samples.join(groups, "sample_id", "left_anti"), "sample_id", "no group"))
    if not allow_empty and names:
        want = samples.sparkSession.createDataFrame([(n,) for n in names], "split string")
        out = out.unionByName(issue(want.join(splits, "split", "left_anti"), "split", "empty split"))
    return out


def split_report(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Number of samples by split; those of no split under 'unassigned'."""
    return samples.select("sample_id").distinct().join(splits, "sample_id", "left").groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def subsets_from_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the ids (sample_id, position), in the ids' order."""
    return table.join(ids, "sample_id").orderBy("position")


def split_by_group(groups: DataFrame, counts: dict[str, int], seed: int = 0) -> DataFrame:
    """sample_id, group_id, split: whole groups dealt to splits by a seeded hash; the counts, each at least 1, must add up to the number of groups."""
    names = groups.select("group_id").distinct()
    total = names.count()
    if min(counts.values(), default=0) < 1:
        raise ValueError("every split needs at least one group")
    if sum(counts.values()) != total:
        raise ValueError(f"the counts add up to {sum(counts.values())}, there are {total} groups")
    drawn = names.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), "group_id")))
    ranked = numbered_within(drawn, [], [F.col("_draw"), F.col("group_id")], "_at")
    split, reached = F.lit(None).cast("string"), 0
    for name in sorted(counts):
        reached += counts[name]
        split = F.coalesce(split, F.when(F.col("_at") < reached, name))
    return groups.join(ranked.select("group_id", split.alias("split")), "group_id").select("sample_id", "group_id", "split")


def train_test_split(samples: DataFrame, test_size: float | int, order: str = "sample_id", shuffle: bool = True, seed: int = 0) -> DataFrame:
    """samples with split: ceil(n * size) rows of test for a share; by a seeded hash, or the last in order."""
    n = samples.count()
    k = math.ceil(n * test_size) if isinstance(test_size, float) else int(test_size)
    if not 0 < k < n:
        raise ValueError(f"{k} of {n} samples can't be the test split")
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string")))
    keyed = samples.withColumn("_draw", drawn if shuffle else F.lit(""))
    at = numbered_within(keyed, [], [F.col("_draw"), F.col(order) if shuffle else F.desc(order)], "_at")
    return at.withColumn("split", F.when(F.col("_at") < k, "test").otherwise("train")).drop("_draw", "_at")


def attach_sample_ids(table: DataFrame, ids: Column) -> DataFrame:
    """table with sample_id; ids must be unique texts that aren't empty."""
    out = table.withColumn("sample_id", ids.cast("string"))
    _refuse(out.where("sample_id IS NULL OR sample_id = ''").limit(1), "sample_id", "empty ids")
    _refuse(_repeated(out, "sample_id"), "sample_id", "repeated ids")
    return out


def validate_manifest_schema(samples: DataFrame) -> DataFrame:
    """sample_id and issue of manifest rows that break a rule."""
    rules = {
        "sample_id": F.coalesce(F.col("sample_id"), F.lit("")) == "",
        "role": ~F.coalesce(F.col("role").isin("input", "target"), F.lit(False)),
        "path": F.coalesce(F.startswith("path", F.lit("/")) | F.contains("path", F.lit("\\")) | F.col("path").rlike(r"(^|/)\.\.(/|$)"), F.lit(True)),
        "sha256": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "shape": F.coalesce((F.size("shape") < 2) | F.exists("shape", lambda x: x < 1), F.lit(True)),
        "dtype": F.coalesce(F.col("dtype"), F.lit("")) == "",
    }
    issues = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return samples.select("sample_id", F.explode(issues).alias("issue"))


def save_manifest(samples: DataFrame, splits: DataFrame, path: str) -> None:
    _refuse(validate_manifest_schema(samples), "issue", "manifest issues")
    samples.write.mode("overwrite").json(f"{path}/samples")
    splits.write.mode("overwrite").json(f"{path}/splits")


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    samples = spark.read.schema("sample_id string, role string, path string, sha256 string, shape array<int>, dtype string").option("mode", "FAILFAST").json(f"{path}/samples")
    splits = spark.read.schema("split string, position int, sample_id string").option("mode", "FAILFAST").json(f"{path}/splits")
    _refuse(_repeated(samples.withColumn("k", F.concat_ws("|", "sample_id", "role")), "k"), "k", "repeated entries")
    return samples, splits


def align_source(manifest: DataFrame, source: DataFrame) -> DataFrame:
    """Positions where the two (position, sample_id) tables differ."""
    b = source.select("position", F.col("sample_id").alias("other"))
    return manifest.join(b, "position", "full").where(~F.col("sample_id").eqNullSafe(F.col("other")))


def pixel_digest(pixels: DataFrame) -> DataFrame:
    """key and sha256 of each raster's shape and values, by row first so that no list exceeds a row or a column of digests."""
    rows = pixels.groupBy(*KEY, "row").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: F.concat_ws("=", x["col"], x["value"])), ","), 256).alias("digest"), F.count(F.lit(1)).alias("n_cols"))
    return rows.groupBy(*KEY).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.max("n_cols"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "digest"))), lambda x: x["digest"]), ",")), 256).alias("sha256"))


def content_key(digests: DataFrame, tree_key: str, attributes: list[str], dtype: str = "double") -> DataFrame:
    return digests.withColumn("entry_key", F.sha2(F.concat_ws("|", "sha256", F.lit(tree_key), F.lit(",".join(sorted(attributes))), F.lit(dtype)), 256))


def dedupe_images(pixels: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels of one raster per content, and the bindings of all rasters to it."""
    first = digests.groupBy("sha256").agg(F.min(F.struct(*KEY)).alias("one"))
    bound = digests.join(first, "sha256").select(*KEY, "sha256", F.col("one.image_id").alias("entry_image"), F.col("one.channel").alias("entry_channel"))
    keep = bound.where("image_id = entry_image AND channel = entry_channel").select(*KEY)
    return pixels.join(keep, KEY, "left_semi"), bound


def prepare_missing(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Wanted entry keys without a valid entry."""
    return wanted.select("entry_key").distinct().join(entries.where("state = 'ready'"), "entry_key", "left_anti")


def size_estimate(entries: DataFrame, remaining: int, quota: int, safety: float = 1.2) -> DataFrame:
    """One row: the bytes that the remaining entries may take, and what is left of the quota."""
    top = F.coalesce(F.max("size_bytes"), F.lit(0))
    need = F.ceil(top * remaining * safety).cast("long")
    return entries.agg(need.alias("estimate"), (F.lit(quota) - F.coalesce(F.sum("size_bytes"), F.lit(0)) - need).cast("long").alias("quota_left"))


def digest_of_digests(rows: DataFrame, by: list, at: Column, digest: Column, name: str) -> DataFrame:
    """One row for each group of by: name, sha256 over the group's digests in the order of at."""
    held = F.array_sort(F.collect_list(F.struct(at.alias("at"), digest.alias("x"))))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(held, lambda s: s["x"]), ""), 256).alias(name))


def fingerprint(rows: DataFrame, order: list[str] | None = None, per_block: int = 4096, digits: int = 3) -> DataFrame:
    """One row: sha256 over the rows' digests, in the given order, or in any order (as a set with repeats).

    A tree of digests: the first digits of a row's digest name its block, as many as leave
    about per_block rows in each, and every level above takes `digits` of them off, so no
    list holds more than about per_block rows or 16**digits blocks, however many rows there
    are. Equal rows count as one with their number. An empty table has the digest of nothing.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    per = rows.select(digest.alias("d"), F.to_json(F.struct(*order)).alias("o") if order else F.lit("").alias("o")).groupBy("d", "o").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat("o", "d", F.when(F.col("n") > 1, F.concat(F.lit("*"), F.col("n").cast("string"))).otherwise(""))
    depth, n = digits, rows.count()
    while n > per_block * 16**depth:
        depth += digits
    level = digest_of_digests(per, [F.substring("d", 1, depth).alias("b")], entry, entry, "x")
    while depth > digits:
        depth -= digits
        level = digest_of_digests(level, [F.substring("b", 1, depth).alias("b")], F.col("b"), F.col("x"), "x")
    return digest_of_digests(level, [], F.col("b"), F.col("x"), "fingerprint")


def target_fingerprint(targets: DataFrame) -> DataFrame:
    """One row: the digest of all targets in order; targets has position, sample_id and sha256."""
    return fingerprint(targets.select("position", "sample_id", "sha256"), ["position"])


def fingerprints(samples: DataFrame, splits: DataFrame, preprocessing: dict[str, str], per_block: int = 4096) -> DataFrame:
    """name and fingerprint: input, target, splits, split:<name>, preprocessing, manifest.

    The order of samples within a split counts, that of splits, samples and settings doesn't.
    """
    named = lambda name, df: df.select(F.lit(name).alias("name"), "fingerprint")
    parts = [named(role, fingerprint(samples.where(F.col("role") == role))) for role in ("input", "target")]
    ordered = splits.select("split", "position", "sample_id")
    parts.append(named("splits", fingerprint(ordered)))
    digest = F.sha2(F.concat_ws("|", "position", "sample_id"), 256)
    each = ordered.select("split", F.col("position").alias("b"), digest.alias("d"))
    # Blocks of positions, blocks of these and so on, as many levels as the last position asks for.
    last = ordered.agg(F.max("position").alias("last")).first()["last"] or 0
    while (last := last // per_block) > 0:
        each = digest_of_digests(each, ["split", F.floor(F.col("b") / per_block).alias("b")], F.col("b"), F.col("d"), "d")
    each = digest_of_digests(each, ["split"], F.col("b"), F.col("d"), "fingerprint")
    parts.append(each.select(F.concat(F.lit("split:"), "split").alias("name"), "fingerprint"))
    settings = samples.sparkSession.range(1).select(F.sha2(F.lit(json.dumps(preprocessing, sort_keys=True)), 256).alias("fingerprint"))
    parts.append(named("preprocessing", settings))
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.unionByName(named("manifest", fingerprint(out)))


def inspect_manifest(samples: DataFrame, contributions: DataFrame, entries: DataFrame, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts and bytes by entry state, entry keys without an entry, and a page of samples by position.

    Each row of the page has next_offset, where the next page begins (null on the last one).
    """
    if not 0 < limit <= 1000 or offset < 0:
        raise ValueError("the limit must lie within 1 and 1000, the offset be 0 or more")
    wanted = contributions.select("entry_key").distinct()
    states = wanted.join(entries, "entry_key", "left").groupBy(F.coalesce("state", F.lit("missing")).alias("state"))
    following = samples.agg(F.when(F.max("position") >= offset + limit, offset + limit).alias("next_offset"))
    page = samples.where((F.col("position") >= offset) & (F.col("position") < offset + limit)).crossJoin(F.broadcast(following)).orderBy("position")
    missing = wanted.join(entries, "entry_key", "left_anti")
    return states.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")), missing, page


def inspect_dataset_cache(samples: DataFrame, contributions: DataFrame, entries: DataFrame, payload: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """scope, issue, id of a prepared data set: its metadata; with payload (entry_key of the stored
    rows), entries without rows; with source (position, sample_id), positions that differ from it."""
    at = lambda df, scope: df.select(F.lit(scope).alias("scope"), "issue", "id")
    out = at(validate_manifest(samples, contributions, entries, max_errors=None), "metadata")
    if payload is not None:
        hollow = entries.where("state = 'ready'").join(payload.select("entry_key").distinct(), "entry_key", "left_anti")
        out = out.unionByName(at(hollow.select(F.lit("no payload").alias("issue"), F.col("entry_key").cast("string").alias("id")), "payload"))
    if source is not None:
        moved = align_source(samples.select("position", "sample_id"), source)
        out = out.unionByName(at(moved.select(F.lit("moved").alias("issue"), F.col("position").cast("string").alias("id")), "source"))
    return out


def validate_manifest(samples: DataFrame, contributions: DataFrame, entries: DataFrame, max_errors: int | None = 100) -> DataFrame:
    """Errors (issue, id): gaps in positions, samples without contributions and the other way, entries missing or not ready."""
    issue = lambda df, c, text: df.select(F.lit(text).alias("issue"), F.col(c).cast("string").alias("id"))
    n = samples.agg((F.count(F.lit(1)) - 1 - F.max("position")).alias("gap"), F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("m"))
    out = issue(n.where("gap <> 0 OR n <> m"), "gap", "positions")
    out = out.unionByName(issue(samples.join(contributions, "position", "left_anti"), "sample_id", "no contribution"))
    out = out.unionByName(issue(contributions.join(samples, "position", "left_anti"), "position", "no sample"))
    bad = contributions.join(entries, "entry_key", "left").where("state IS NULL OR state <> 'ready'")
    out = out.unionByName(issue(bad.select("entry_key").distinct(), "entry_key", "entry"))
    return out if max_errors is None else out.limit(max_errors)


def distribution(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, median, min, max and median absolute deviation."""
    by = by or []
    mid = values.groupBy(*by).agg(F.count(column).alias("n"), F.percentile(column, 0.5).alias("median"), F.min(column).alias("low"), F.max(column).alias("high"))
    near = values.join(mid, by) if by else values.crossJoin(F.broadcast(mid))
    dev = near.groupBy(*by, "n", "median", "low", "high").agg(F.percentile(F.abs(F.col(column) - F.col("median")), 0.5).alias("mad"))
    return dev
