"""Secret scans: candidates weighed by how many owners and repositories hold them, native expressions only.

A value that many owners hold is an example that was copied from place to place; one that
a single owner holds and that looks random is likely to be a live credential. The scan
leaves only digests of values in its tables, never the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch


def either_case(pattern: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in pattern)


# The base kinds, in order, with their patterns and least lengths.
NAMES = either_case("(password|passwd|secret|token|api_?key)")
KINDS = (
    ("assign", NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]+", 16),
)
#: Any other run of characters that keys are made of; it counts only by what the corpus says of it.
LOOSE = ("owned", r"[A-Za-z0-9+/_=-]+", 20)
#: Runs beyond this length are data, not keys.
LONGEST = 128
#: Rows of a block that asks for a value's owners once.
BLOCK_BITS = 10
SPAN = "array<struct<gap:int,length:int,digest:string,live:boolean>>"


def looks_live(value: Column) -> Column:
    """Lower and upper case letters and digits, at least 12 characters of them different."""
    mixed = F.rlike(value, F.lit("[a-z]")) & F.rlike(value, F.lit("[A-Z]")) & F.rlike(value, F.lit("[0-9]"))
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= 12)


def least_run(pattern: str, least: int) -> str:
    """pattern for maximal runs of at least that length; the runs come out as from the shorter pattern, filtered."""
    return pattern.removesuffix("+") + f"{{{least - (4 if pattern.startswith('AKIA') else 0)},}}"


def hits(text: Column, kind: str, pattern: str, least: int) -> tuple[Column, Column]:
    """Matches of a kind in order, and the lengths of what lies before each."""
    if kind != "assign":
        pattern = least_run(pattern, least)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))


def described(found: Column, gaps: Column, kind: str, pattern: str) -> Column:
    def one(x: Column, i: Column) -> Column:
        value = F.regexp_extract(x, pattern, 2) if kind == "assign" else x
        return F.struct(F.get(gaps, i).alias("gap"), F.length(x).alias("length"), F.when(F.length(value) >= least, F.sha2(value, 256)).alias("digest"), looks_live(value).alias("live"))

    least = {k: n for k, _, n in (*KINDS, LOOSE)}[kind]
    return F.transform(found, one)


def scanned(docs: DataFrame, repository: Column, owner: Column, kinds: tuple[tuple[str, str, int], ...]) -> DataFrame:
    """_row, doc_id, repository, owner and the spans of each kind; one pass over the texts, which stay in the task."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", repository.alias("repository"), owner.alias("owner"), text.alias("text"))
    for kind, pattern, least in kinds:
        rows = rows.withColumn(f"{kind}_found", hits(F.col("text"), kind, pattern, least)[0])
    for kind, pattern, least in kinds:
        some = F.size(f"{kind}_found") > 0
        rows = rows.withColumn(f"{kind}_gaps", F.when(some, hits(F.col("text"), kind, pattern, least)[1]))
    spans = [F.when(F.size(f"{k}_found") > 0, described(F.col(f"{k}_found"), F.col(f"{k}_gaps"), k, p)).otherwise(F.array().cast(SPAN)).alias(k) for k, p, _ in kinds]
    return rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "repository", "owner", *spans)


def placed(rows: DataFrame, kinds: tuple[tuple[str, str, int], ...]) -> DataFrame:
    """A row for each span that is long enough: its start and end in code points, kind number, digest and looks."""
    parts = []
    for k, (kind, _, _) in enumerate(kinds):
        p = rows.where(F.size(kind) > 0).select("_row", "repository", "owner", F.posexplode(kind).alias("i", "s"))
        parts.append(p.select("_row", "repository", "owner", F.lit(k).alias("kind"), "i", "s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = W.partitionBy("_row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(w)).where("digest IS NOT NULL")
    return out.select("_row", "repository", "owner", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "digest", "live")


def ownership(spans: DataFrame) -> DataFrame:
    """digest, n_owners, n_repositories and whether a base kind has it anywhere; partial counts come before each shuffle.

    A null owner or repository counts as one of its own; a repository lies with its owner.
    """
    each = spans.groupBy("digest", "owner", "repository").agg(F.bool_or(F.col("kind") < len(KINDS)).alias("base"))
    owners = each.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"), F.bool_or("base").alias("base"))
    return owners.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"), F.bool_or("base").alias("base_somewhere"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k, _, _ in (*KINDS, LOOSE)])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, most_owners: int = 1, example_owners: int = 3) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, live, examples.

    docs: doc_id, text and what repository (by default doc_id) and owner (by default source)
    read; other columns are ignored. A base span is a whole match of its pattern (with the
    name and sign that stand before an assigned value). The kind owned is added for runs of
    key characters off the base spans that at most most_owners owners of the corpus hold and
    that look random or that a base kind has elsewhere. live lists the spans whose value
    stays with so few owners, examples those of values that example_owners owners or more
    hold; both, like spans, are kind:start:end in order, joined by commas. Null and empty
    texts have no span; a null doc_id keeps its row; repeated rows are each reported, and
    are one repository; an empty table gives no rows.
    """
    keep = Scratch(docs.sparkSession, "secrets")
    kinds = (*KINDS, LOOSE)
    repository = F.col("doc_id") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    rows = keep.keep(scanned(docs, repository, owner, kinds), "scanned")
    spans = keep.keep(placed(rows, kinds).withColumn("block", F.shiftright("_row", BLOCK_BITS)), "spans")
    # A block asks once for each value, so a value in every document comes once a block.
    told = keep.keep(spans.select("block", "digest").distinct().join(ownership(spans), "digest"), "told")
    known = spans.drop("repository", "owner").join(told, ["block", "digest"])
    # Off the base spans: none that starts before reaches in, none that starts later starts inside.
    ahead = W.partitionBy("_row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy("_row").orderBy(F.desc("start"), "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = F.col("kind") < len(KINDS)
    known = known.withColumn("reach", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(base, F.col("start"))).over(behind))
    off = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    own = F.col("n_owners") <= most_owners
    added = off & own & (F.col("live") | F.col("base_somewhere")) & (F.col("end") - F.col("start") <= LONGEST)
    span = F.struct("start", "kind", "end")
    by = known.where(base | added).groupBy("_row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, (k, _, _) in enumerate(KINDS)],
        joined(F.collect_list(F.when(base, span))).alias("base"),
        joined(F.collect_list(span)).alias("spans"),
        joined(F.collect_list(F.when(own, span))).alias("live"),
        joined(F.collect_list(F.when(F.col("n_owners") >= example_owners, span))).alias("examples"),
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    out = rows.select("_row", "doc_id").join(by, "_row", "left")
    out = out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k, _, _ in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), *[text(c).alias(c) for c in ("spans", "live", "examples")])
    return keep.result(out, "secrets")


def oracle() -> str:
    """The same rows for another engine: matches from splits, owners by distinct counts, overlaps by a join."""

    def part(k: int, kind: str, pattern: str, least: int) -> str:
        p = pattern.replace("'", "''")
        value = f"regexp_extract(m, '{p}', 2)" if kind == "assign" else "m"
        return f"""SELECT r, doc_id, source, {k} AS kind, (sum(len(g) + len(m)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS e, len(m) AS n, {value} AS v, {least} AS least
  FROM (SELECT r, doc_id, source, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(string_split_regex(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) AS g, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM d)"""

    parts = "\nUNION ALL ".join(part(k, *kind) for k, kind in enumerate((*KINDS, LOOSE)))
    name = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || s || ':' || e"
    line = lambda cond: f"coalesce(string_agg({name}, ',' ORDER BY s, kind) FILTER ({cond}), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
a AS ({parts}),
f AS (SELECT r, doc_id, source, kind, e - n AS s, e, v,
  regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 12 AS live FROM a WHERE len(v) >= least),
o AS (SELECT v, count(DISTINCT coalesce('s' || source, 'none')) AS n_owners, bool_or(kind < 3) AS known FROM f GROUP BY v),
j AS (SELECT f.*, n_owners, known, kind < 3 OR (n_owners <= 1 AND (live OR known) AND e - s <= {LONGEST} AND NOT EXISTS (SELECT 1 FROM f b WHERE b.r = f.r AND b.kind < 3 AND b.s < f.e AND b.e > f.s)) AS kept FROM f JOIN o ON f.v = o.v),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  {line("kind < 3")} AS base, {line("true")} AS spans, {line("n_owners <= 1")} AS live, {line("n_owners >= 3")} AS examples FROM j WHERE kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(live, '') AS live, coalesce(examples, '') AS examples FROM d LEFT JOIN g ON d.r = g.r
"""
