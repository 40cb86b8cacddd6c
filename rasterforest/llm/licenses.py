"""Licence scans by canonical digests, native expressions only.

A text is put into one canonical form (lower case, copyright lines gone, equivalent
spellings unified, punctuation and white space folded) and its digest is looked up among
those of known notices and licence texts. Whole documents and each of their lines are
looked up; complete licence texts are also found inside documents.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence notices, by their SPDX identifiers.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under Apache-2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-AllRightsReserved", "All rights reserved."),
)

# Titles above short licence texts; the line that ends the terms of long ones.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"

# Equivalent spellings, applied in this order to lower-case text. Each has a
# string that all its matches hold; '' where there is none.
SPELLINGS = (
    (r"\bcreative commons\b", "cc", "creative commons"),
    (r"\battribution\b", "by", "attribution"),
    (r"\bnon-?commercial\b", "nc", "commercial"),
    (r"\bno-?deriv(atives|s)\b", "nd", "deriv"),
    (r"\bshare-?alike\b", "sa", "alike"),
    (r"\bgnu general public license\b", "gpl", "gnu general public license"),
    (r"\bgnu lesser general public license\b", "lgpl", "gnu lesser general public license"),
    (r"\bgnu affero general public license\b", "agpl", "gnu affero general public license"),
    (r"\bmozilla public license\b", "mpl", "mozilla public license"),
    (r"\blicence(s|d)?\b", "license$1", "licence"),
    (r"\bv(ersion)?[. ]*([0-9])", "$2", ""),
    (r"\binternational\b", "", "international"),
    (r"\b(the|a|license)\b", "", ""),
    (r"\breleased\b", "licensed", "released"),
)
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"


def spelled(text: Column) -> Column:
    """Lower case, without copyright lines, spellings unified; the lines stay as they are dealt.

    No pattern crosses a line's end, so each line comes out as it would alone.
    """
    # An array of one text, so that each step reads the text before it once; a step whose
    # string a text doesn't hold leaves it as it is.
    marked = lambda x: F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("(c)")) | F.contains(x, F.lit("©"))
    out = F.transform(F.array(F.lower(text)), lambda x: F.when(marked(x), F.regexp_replace(x, COPYRIGHT, "")).otherwise(x))
    for pattern, to, held in SPELLINGS:
        out = F.transform(out, replacing(pattern, to, held))
    return out[0]


def replacing(pattern: str, to: str, held: str) -> Callable[[Column], Column]:
    return lambda x: F.when(F.contains(x, F.lit(held)), F.regexp_replace(x, pattern, to)).otherwise(x)


def words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form; null stays null, punctuation alone becomes ''."""
    return words(spelled(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(df: DataFrame, known: tuple[tuple[str, str], ...]) -> DataFrame:
    """A row for each digest; its size is that of the list of known licences."""
    rows = df.sparkSession.createDataFrame(list(known), "license string, known_text string")
    return rows.groupBy(digest(F.col("known_text")).alias("known_digest")).agg(F.min("license").alias("whole_license"))


def license_texts() -> list[tuple[str, str, bool]]:
    """Identifier, text and whether it is also looked for inside longer texts: every complete licence of the folder license_texts.

    A file counts in full and up to the end of its terms, as it is wrapped and on one line;
    short ones also below a title.
    """
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name, full = path.stem, path.read_text()
        terms = full.partition(END_OF_TERMS)
        inner = terms[0] + terms[1]
        for text in (inner, " ".join(inner.split())):
            out.append((name, text, True))
        titles = TITLES.get(name, ())
        out += [(name, text, False) for text in (full, " ".join(full.split()), *(f"{t}\n\n{inner}" for t in titles))]
    return out


def spans(joined: Column, flat: Column, form: str) -> Column:
    """Lines over which form stretches, all places together; joined is flat with \\n for the space after each line."""
    n = len(form)
    parts = F.split(flat, f"\\Q {form}\\E(?= )")

    def step(s: Column, part: Column) -> Column:
        at = s["at"] + F.length(part) + 1
        run = joined.substr(at + 1, F.lit(n))
        return F.struct((at + n).alias("at"), (s["n"] + 1 + n - F.length(F.replace(run, F.lit("\n"), F.lit("")))).alias("n"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda s: s["n"])


def scan_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """Per row of docs: doc_id, whole_license (of the entire text), n_lines, n_license_lines and licenses.

    docs: doc_id, text; other columns are ignored. Every text and every line of it is put
    into its canonical form and looked up; complete licence texts are looked up among the
    texts and found inside them too, however their lines are dealt. n_license_lines counts
    the lines that are a known notice and those that a licence text stretches over.
    licenses lists the distinct identifiers in order, joined by commas. Null and empty
    texts have no line and no licence; a null doc_id keeps its row; repeated rows are each
    reported; an empty table gives no rows.
    """
    texts = license_texts()
    digests = known_digests(docs, (*known, *((name, text) for name, text, _ in texts)))
    # As many rows as known notices: two constant arrays for the look-up of lines.
    rows = known_digests(docs, known).collect()
    keys, ids = (F.array(*[F.lit(r[c]) for r in rows]) for c in ("known_digest", "whole_license"))
    look = lambda x: F.get(ids, F.array_position(keys, F.sha2(x, 256)).cast("int") - 1)
    inner = docs.sparkSession.createDataFrame([t[:2] for t in texts if t[2]], "license string, known_text string")
    inner = sorted({(r[0], r[1]) for r in inner.select("license", canonical(F.col("known_text"))).collect()})
    # Steps of their own: the whole text and its lines are read from one spelled form.
    raw = F.col("text")
    forms = docs.select("doc_id", spelled(raw).alias("form"), raw.isNull().alias("none"), (F.coalesce(raw, F.lit("")) == "").alias("bare"))
    lines = F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(F.transform(F.split("form", "\n"), words))
    lined = forms.select("doc_id", "none", lines.alias("lines"))
    joined = F.concat(F.lit(" "), F.array_join(F.filter("lines", lambda x: x != ""), "\n"), F.lit(" "))
    hits = F.filter(F.transform("lines", look), lambda x: x.isNotNull())
    met = lined.select("doc_id", "none", F.size("lines").cast("long").alias("n_lines"), hits.alias("hits"), joined.alias("joined"))
    # A text that lacks a word of all complete licences holds none of them.
    common = max(set.intersection(*[set(form.split()) for _, form in inner]), key=lambda w: (len(w), w), default="")
    met = met.withColumn("flat", F.translate("joined", "\n", " ")).withColumn("may", F.contains("flat", F.lit(common)))
    there = [(name, form, F.col("may") & F.contains("flat", F.lit(f" {form} "))) for name, form in inner]
    found = met.select(
        "doc_id",
        "n_lines",
        F.concat("hits", F.filter(F.array(*[F.when(c, F.lit(name)) for name, _, c in there]), lambda x: x.isNotNull())).alias("hits"),
        (F.size("hits") + sum(F.when(c, spans(F.col("joined"), F.col("flat"), form)).otherwise(0) for _, form, c in there)).cast("long").alias("n_license_lines"),
        F.when(~F.col("none"), F.sha2(F.trim("flat"), 256)).alias("digest"),
    )
    # As many rows as known licences, whatever the size of docs.
    whole = found.join(F.broadcast(digests), F.col("digest") == F.col("known_digest"), "left")
    return whole.select("doc_id", "whole_license", "n_lines", "n_license_lines", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("licenses"))


def oracle(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same rows for another engine: every line is exploded, canonicalised and joined."""

    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), '(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
        for pattern, to, _ in SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"

    values = ", ".join(f"('{i}', '{t}')" for i, t in known)
    return f"""
WITH k AS (SELECT {form('t')} AS form, min(i) AS license FROM (VALUES {values}) v(i, t) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE coalesce(text, '') <> ''),
h AS (SELECT doc_id, count(*) AS n_lines, count(license) AS n_license_lines, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses FROM l LEFT JOIN k ON {form('line')} = form GROUP BY doc_id)
SELECT d.doc_id, k.license AS whole_license, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_license_lines, 0)::BIGINT AS n_license_lines, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON {form('d.text')} = form
"""
