"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (lower case, copyright notices gone, equivalent
spellings unified, punctuation and white space as single blanks) and hashed. Two units are
looked up: the entire text of a document (a licence file), and every entire line of it (a
licence notice). A unit matches if its digest is that of a known text, so the lookup is
one equi-join. The known texts are a table of bounded size (below: the bodies in
``BODIES`` and notices made from ``NAMES`` and ``NOTICES``), which is broadcast; a caller's own table has
no hint, so Spark broadcasts it only under its size threshold and AQE splits a hot digest otherwise.

A copyright notice is a line that begins with "copyright", "(c)" or the sign and goes on with a
year, "(c)" or a holder, that is with anything but a word that follows there in the prose of the
known bodies (``PROSE_WORDS``): a wrapped line "copyright holders be liable" stays.

Rows: null text is empty; empty units match nothing. A line that a document repeats is
reported once per line. Repeated rows and null ids are reported as they are. Empty tables
give no rows. Extra columns are not read.
"""

from __future__ import annotations

from itertools import product
from string import ascii_lowercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.llm.license_texts import BODIES, BODY_VARIANTS, NAMES, NOTICES, PROSE_WORDS, SPELLINGS


def _rest_but(words: set[str], first: bool = True) -> str:
    """Pattern for the rest of a line whose first word is none of ``words`` (RE2 has no look-ahead)."""
    heads = "".join(sorted({w[0] for w in words if w}))
    branches = [h + _rest_but({w[1:] for w in words if w[:1] == h}, False) for h in heads]
    if first:
        other = [rf"[^\P{{L}}{heads}][^\n]*", r"\p{N}[^\n]*"]
    elif "" in words:                      # the word may not end here
        other = ["[" + "".join(c for c in ascii_lowercase + digits if c not in heads) + r"][^\n]*"]
    else:
        other = [rf"[^{heads}\n][^\n]*", "$"]
    return "(?:" + "|".join(branches + other) + ")"


#: Lines that only name who holds a copyright, and the marks that become one blank.
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n]*(?:copyrighted[^\p{L}\p{N}\n]+(?:c\)|\p{N})[^\n]*|"
                  r"(?:copyrights?[^\p{L}\p{N}\n]+|(?:\(c\)|©)[^\p{L}\p{N}\n]*)"
                  r"(?:the [^\n]*(?:authors|contributors|developers|foundation)[^\n]*|[^\n]*all rights reserved[^\n]*|"
                  + _rest_but(PROSE_WORDS) + "))")
MARKS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Canonical form of every line, lines kept apart."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, MARKS, " ")
    for ours, theirs in SPELLINGS.items():
        out = F.regexp_replace(out, rf"\b(?:{theirs})\b", ours)
    return out


def canonical(lines: Column) -> Column:
    """Canonical form of the entire text, from ``canonical_lines``."""
    return F.trim(F.regexp_replace(lines, r"\s+", " "))


def known_texts() -> list[tuple[str, str, str]]:
    """(licence, kind, text) of all known bodies and notices."""
    out = [(name, "body", text) for name, text in [*BODIES.items(), *BODY_VARIANTS]]
    out += [(name, "notice", notice.format(label))
            for (name, labels), notice in product(NAMES.items(), NOTICES) for label in labels]
    return out + [(name, "notice", f"SPDX-License-Identifier: {name}") for name in NAMES]


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license) of a table (license, text); of texts with one canonical form the first name counts."""
    form = canonical(canonical_lines(F.col("text")))
    return (known.select("license", form.alias("form")).where("form <> ''")
            .groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license")))


def license_matches(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, line_no, license, digest) of every known unit; line_no counts from 0, null for a whole text."""
    if known is None:       # the fixed table of this module is small enough to send to all tasks
        known = docs.sparkSession.createDataFrame([(a, t) for a, _, t in known_texts()], "license string, text string")
        digests_of_known = F.broadcast(known_digests(known))
    else:
        digests_of_known = known_digests(known)
    forms = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    units = forms.select("doc_id", F.posexplode(F.concat(
        F.array(canonical(F.col("lines"))), F.transform(F.split("lines", "\n"), lambda x: F.trim(x)))).alias("at", "form"))
    digests = units.where("form <> ''").select("doc_id", "at", F.sha2("form", 256).alias("digest"))
    return (digests.join(digests_of_known, "digest")
            .select("doc_id", F.when(F.col("at") == 0, "text").otherwise("line").alias("unit"),
                    F.when(F.col("at") > 0, F.col("at") - 1).alias("line_no"), "license", "digest"))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(lower(coalesce(text, '')), {quote(COPYRIGHT_LINE)}, '', 'g')"
    form = f"regexp_replace({form}, {quote(MARKS)}, ' ', 'g')"
    for ours, theirs in SPELLINGS.items():
        form = f"regexp_replace({form}, {quote(rf'\b(?:{theirs})\b')}, {quote(ours)}, 'g')"
    whole = r"trim(regexp_replace(lines, '\s+', ' ', 'g'))"
    known = ", ".join(f"({quote(a)}, {quote(t)})" for a, _, t in known_texts())
    return f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(license) AS license
  FROM (SELECT license, {whole} AS form FROM (SELECT license, {form} AS lines FROM (VALUES {known}) k(license, text)))
  WHERE form <> '' GROUP BY 1),
forms AS (SELECT doc_id, {form} AS lines FROM documents),
units AS (
  SELECT doc_id, 'text' AS unit, NULL::INT AS line_no, {whole} AS form FROM forms
  UNION ALL
  SELECT doc_id, 'line', (i - 1)::INT, trim(parts[i])
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(lines, chr(10)) AS parts FROM forms)))
SELECT u.doc_id, u.unit, u.line_no, k.license, k.digest
FROM units u JOIN known k ON sha256(u.form) = k.digest WHERE u.form <> ''
"""
