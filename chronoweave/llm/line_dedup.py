"""Line dedup: windows of three lines that occurred before, in order of (doc_id, line), go.

Lines are what newlines separate, byte for byte. A window is three consecutive lines that are not all blank. Its first
occurrence stays; the lines that any later occurrence covers are removed, overlapping ones merged. The earliest
occurrence of a line is never covered by a later window whose first occurrence lies before it, so no line's content is
lost from the corpus. A text of fewer than three lines, an empty one and a null one have no window and stay as they
are. A null doc_id orders last; rows equal in both doc_id and text count as one document and get the same result;
rows equal in doc_id only are ordered by a hash of their text. Texts are taken whole, however long; an empty table gives
an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, materialise, own_names, row_key


SEED = 1


def _line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(key columns, __p, __w): each window's first line and two 64-bit hashes of its lines."""
    d = docs.filter(F.length("__t") - F.length(F.replace("__t", F.lit("\n"), F.lit(""))) >= width - 1)
    # Two hashes of each line, of different seeds, so that lines which one confuses the other tells apart; the first one's
    # lowest bit says whether the line is not blank.
    one = lambda x: F.when(F.trim(x) != "", F.xxhash64(x).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(x).bitwiseAND(F.lit(-2)))
    arrays = d.select(*KEY, _line_array(F.col("__t")).alias("__l"))
    lines = arrays.select(*KEY, F.transform("__l", one).alias("__l"), F.transform("__l", lambda x: F.xxhash64(F.lit(SEED), x)).alias("__m"))
    at = lines.select(*KEY, "__l", "__m", F.explode(F.sequence(F.lit(0), F.size("__l") - width)).alias("__p"))
    h, g = ([F.col(c)[F.col("__p") + i] for i in range(width)] for c in ("__l", "__m"))
    return at.filter(reduce(lambda a, b: a.bitwiseOR(b), h).bitwiseAND(F.lit(1)) == 1).select(*KEY, "__p", F.struct(F.xxhash64(*h).alias("a"), F.xxhash64(F.lit(SEED), *g).alias("b")).alias("__w"))


@own_names
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """All rows and columns of docs, with text_col deduplicated, and __n_lines, __removed (sorted line numbers)."""
    d = docs.withColumn("__t", F.col(text_col)).withColumns(dict(zip(KEY, row_key(id_col, text_col), strict=True)))
    # Whoever repeats a window pre-aggregates it: a hot window is one row of each task before the shuffle.
    first = F.struct(*KEY, "__p")
    w = windows(d, width)
    seen = w.groupBy("__w").agg(F.min(first).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").select("__w", "__first")
    seen = materialise(seen, "windows")
    later = w.join(seen, "__w").filter(first != F.col("__first"))
    cover = F.flatten(F.transform(F.collect_set("__p"), lambda p: F.sequence(p, p + width - 1)))
    gone = later.groupBy(*KEY).agg(F.array_sort(F.array_distinct(cover)).alias("__removed"))
    out = d.join(gone, KEY, "left")
    lines = _line_array(F.col("__t"))
    kept = F.array_compact(F.zip_with(lines, F.col("__mask"), lambda x, m: F.when(F.coalesce(m, F.lit(False)), None).otherwise(x)))
    # __removed is sorted: cut the array at each run's ends instead of testing each line against all numbers.
    mask = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__removed") - 1), lambda i: F.concat(
        F.array_repeat(F.lit(False), F.col("__removed")[i] - F.when(i > 0, F.col("__removed")[F.greatest(i - 1, F.lit(0))] + 1).otherwise(F.lit(0))), F.array(F.lit(True)))))
    out = out.withColumn("__mask", F.when(F.col("__removed").isNotNull(), mask))
    text = F.when(F.col("__removed").isNull(), F.col("__t")).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.length("__t") - F.length(F.replace("__t", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    keep = [c for c in docs.columns if c != text_col]
    out = out.select(*keep, text.alias(text_col), n.alias("__n_lines"), F.coalesce("__removed", F.array().cast("array<int>")).alias("__removed"))
    return out.select(*docs.columns, "__n_lines", "__removed")


@own_names
def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's form: same columns; a document of which every line was removed is a copy and goes."""
    out = line_dedup(docs).filter(F.size("__removed") < F.greatest("__n_lines", F.lit(1)))
    cols = {c: F.col(c) for c in docs.columns}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.size("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[v.alias(c) for c, v in cols.items()])
