"""Licence scan by canonical digests, in DataFrame functions only.

Canonical form of a text: lower case; lines joined; every run of white space one space; equivalent spellings made one; every
run of other characters than letters and digits one space. Copyright statements are left out before, in three ways, and an
entire text counts as a known one if its digest is that of a known text in any of them:

* every line that states a copyright is left out (a notice on lines of its own above the text);
* every paragraph that begins with a copyright statement and has at most STATEMENT words is left out (a notice that was wrapped
  at any width, also with the sentence that goes with it);
* nothing is left out (a text on one line).

Lines are joined before spellings are compared, so where lines break does not count. Digests of entire texts are
hash-joined with those of known licences (a constant table of less than two hundred rows, so it is broadcast); entire lines
are looked up among one-line notices in a constant map. Each row is read once and nothing is shuffled.

Known texts are those of license_texts.TEXTS (22 licences; each with and without its title line and the guidance after its
end) and notices those of NOTICES; both are parameters.

Defined cases: a null text is empty; a text without words has the digest of the empty string and no licence; null ids and
repeated rows give a row each; of two licences with one canonical text the name that sorts first is given; very long texts
are taken whole; an empty table gives no rows; extra columns are ignored, whatever their names. text_digest is that of the
first way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NOTICES, SPELLINGS, TEXTS, editions

#: A line that states a copyright, not one that only begins with the word.
COPYRIGHT_LINE = r"^[\s#*/;-]*(copyright[\s:]*(\(c\)|©|[0-9]|\[|<|by )|\(c\) *(copyright|[0-9])|©|all rights reserved).*"


#: Words of a paragraph that is a copyright statement, at most; what ends a paragraph; white space.
STATEMENT, PARAGRAPH, BLANKS = 40, r"\n[\t\x0B\f\r ]*\n", r"[\t\n\x0B\f\r ]+"


def canonical(text: Column) -> Column:
    """Lower-case text, with its lines joined -> its words in one spelling."""
    text = F.regexp_replace(text, BLANKS, " ")
    for spelling, kept in SPELLINGS:
        text = F.replace(text, F.lit(spelling), F.lit(kept))
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def own_lines(text: Column) -> Column:
    """The lines of a lower-case text that state no copyright."""
    return F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(COPYRIGHT_LINE)))


def _own_paragraphs(text: Column) -> Column:
    joined = F.transform(F.split(text, PARAGRAPH), lambda x: F.regexp_replace(x, BLANKS, " "))
    return F.filter(joined, lambda x: ~(F.rlike(x, F.lit(COPYRIGHT_LINE)) & (F.size(F.split(F.trim(x), " ")) <= STATEMENT)))


#: One of these is in every line that COPYRIGHT_LINE matches.
MARKERS = ("copyright", "(c)", "©", "all rights reserved")


def _digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def with_digests(rows: DataFrame, names: list[str], low: str) -> DataFrame:
    """rows with the SHA-256 of the canonical text: without copyright lines, without copyright paragraphs, with both.

    low: the column of lower-case texts. Where a text has no marker the three are one, which is found once.
    """
    text = F.col(low)
    marked = F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(text, m))
    rows = rows.withColumn(names[0], _digest(F.array_join(own_lines(text), " ")))
    forms = (F.array_join(_own_paragraphs(text), " "), text)
    return rows.withColumns({n: F.when(marked, _digest(x)).otherwise(F.col(names[0])) for n, x in zip(names[1:], forms)})


def _constants(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """name, text of a constant list, as literals."""
    if not rows:
        return spark.createDataFrame([], "name string, text string")
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in rows])))


def known_digests(spark: SparkSession, texts: dict[str, str] = TEXTS) -> DataFrame:
    """text_digest, license_id of entire texts, in all their editions."""
    rows = _constants(spark, [(n, t) for n in sorted(texts) for t in editions(texts[n])])
    forms = ["form0", "form1", "form2"]
    rows = with_digests(rows.withColumn("low", F.lower("text")), forms, "low")
    rows = rows.select(F.explode(F.array(*forms)).alias("text_digest"), F.col("name").alias("license_id"))
    return rows.where(F.col("text_digest") != F.sha2(F.lit(""), 256)).groupBy("text_digest").agg(F.min("license_id").alias("license_id"))


def known_lines(spark: SparkSession, notices: dict[str, list[str]] = NOTICES) -> dict[str, int]:
    """Canonical line -> bits of the notices (by their sorted names) that it is."""
    names = sorted(notices)
    rows = _constants(spark, [(n, x) for n in names for x in notices[n]])
    found: dict[str, int] = {}
    for r in rows.select("name", canonical(F.lower("text")).alias("line")).collect():  # the constant list
        found[r.line] = found.get(r.line, 0) | 1 << names.index(r.name)
    return found


def license_scan(docs: DataFrame, texts: dict[str, str] = TEXTS, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """doc_id, text_digest, license_id (of the entire text), notices (sorted, comma-joined), notice_lines: one row per row."""
    if len(notices) > 62:
        raise ValueError("at most 62 kinds of notices")
    known = known_lines(docs.sparkSession, notices)
    whole = known_digests(docs.sparkSession, texts)
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = with_digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low")), ["form0", "form1", "form2"], "low")
    rows = rows.withColumn("lines", F.transform(own_lines(F.col("low")), canonical)).drop("low")
    texts_, bits = F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values()))
    # a notice's line is found among few; most lines end this filter
    hits = F.filter("lines", lambda x: F.array_contains(texts_, x)) if known else F.array().cast("array<string>")
    rows = rows.withColumn("hits", hits).drop("lines")
    mask = F.aggregate("hits", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.element_at(bits.cast("array<long>"), F.array_position(texts_, x).cast("int")))) if known else F.lit(0).cast("long")
    rows = rows.select("doc_id", "form0", "form1", "form2", mask.alias("mask"), F.size("hits").cast("long").alias("notice_lines"))
    names = F.concat_ws(",", *[F.when(F.col("mask").bitwiseAND(F.lit(1 << n)) != 0, F.lit(name)) for n, name in enumerate(sorted(notices))])
    for k in range(3):
        rows = rows.join(F.broadcast(whole.select(F.col("text_digest").alias(f"form{k}"), F.col("license_id").alias(f"found{k}"))), f"form{k}", "left")
    return rows.select("doc_id", F.col("form0").alias("text_digest"), F.coalesce("found0", "found1", "found2").alias("license_id"), names.alias("notices"), "notice_lines")
