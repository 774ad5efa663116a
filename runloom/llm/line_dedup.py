"""Repeated lines by windows of three.

Every run of three consecutive lines is hashed. A window that occurs more than
once keeps its first occurrence, by document and position; the lines that later
occurrences cover are removed, overlapping occurrences as one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runloom.llm.stage import discard, documents, staged

WINDOW = 3


def lines_of(text: str = "text") -> Column:
    """Lines, without their ends. Null and empty texts have none."""
    return F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, at, h1, h2) of each window; two hashes make 128 bits."""
    rows = docs.select("doc_id", lines_of().alias("lines")).filter(F.size("lines") >= WINDOW)
    # Zipping the lines with their successors keeps each row as small as its window.
    ahead = [F.slice("lines", k + 1, F.size("lines") - WINDOW + 1).alias(f"l{k}") for k in range(WINDOW)]
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(*ahead)).alias("at", "w"))
    words = [F.col(f"w.l{k}") for k in range(WINDOW)]
    return rows.select("doc_id", "at", F.xxhash64(*words).alias("h1"), F.xxhash64(F.lit("second"), *words).alias("h2"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text.

    Lines end at line feeds and count as they are, blank ones too. Null and
    empty texts have no lines; texts of fewer than three lines have no window
    and stay whole. Repeats inside one document count like those across
    documents. Rows that repeat an id share its windows, so a repeated row is
    cut like the first and not against it. Rows without an id are left out; an
    empty table gives an empty one.
    """
    docs = documents(docs, id_col, text_col)
    windows = _windows(docs)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    first = staged(first.filter("n > 1").select("h1", "h2", "first"), "windows", free=True)
    later = windows.join(first, ["h1", "h2"]).filter(F.struct("doc_id", "at") > F.col("first"))
    later = staged(later.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("starts")), "repeats", free=True)
    discard(first)
    rows = docs.join(later, "doc_id", "left").select(
        "doc_id", lines_of().alias("lines"), F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    # All windows are equally long, so a covered stretch ends where the next start leaves a gap:
    # what stays lies between the end of one window and the start of the next.
    begins = F.concat(F.array(F.lit(0)), F.transform("starts", lambda s: s + WINDOW))
    ends = F.concat(F.col("starts"), F.array(F.size("lines")))
    rows = rows.select("doc_id", "lines", F.filter(
        F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))), lambda gap: gap["n"] > 0).alias("gaps"))
    kept = F.flatten(F.transform("gaps", lambda gap: F.slice(F.col("lines"), gap["a"] + 1, gap["n"])))
    rows = rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return rows.select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))
