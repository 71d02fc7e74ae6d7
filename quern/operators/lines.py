"""Window rules over the lines of bounded texts.

A text is one cell of a row, so a window over its lines is no larger than that
cell; what has no such bound (scores per tag, events per user) goes through
plans/skew.py instead.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions import words as W
from quern.plans.skew import running_totals


def lines_table(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, i, line): the non-blank lines of whole texts."""
    return (docs.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
            .filter(F.trim("line") != "").withColumn("i", F.col("i").cast("bigint")))


def by_doc(doc: str = "doc_id") -> Window:
    return Window.partitionBy(doc).orderBy("i")


def neighbours(lines: DataFrame, shape: Column) -> DataFrame:
    """Adds the shape of the lines at -2, -1, +1, +2, first / last, and the tenth
    of the text the line is in."""
    w, all_w = by_doc(), Window.partitionBy("doc_id")
    d = lines.withColumn("shape", shape)
    rn, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(all_w)
    return d.withColumns({"pp": F.lag("shape", 2).over(w), "p": F.lag("shape", 1).over(w), "n": F.lead("shape", 1).over(w), "nn": F.lead("shape", 2).over(w),
                          "is_first": rn == 0, "is_last": rn == n - 1, "tenth": F.least(F.floor(rn * 10 / n), F.lit(9)).cast("bigint")})


def seen_before(lines: DataFrame, flag: Column) -> DataFrame:
    w = by_doc().rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("seen", F.coalesce(F.max(flag).over(w), F.lit(False)))


def carry_heading(lines: DataFrame, is_heading: Column) -> DataFrame:
    w = by_doc().rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(w))


def islands(lines: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    """Running number of rows that start something new."""
    w = by_doc().rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w))


def joined(lines: DataFrame, ends: Column) -> DataFrame:
    """Wrapped lines joined: a line whose predecessor has not ended goes on."""
    d = islands(lines.withColumn("_ends", ends), F.lag("_ends").over(by_doc()))
    return d.groupBy("doc_id", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ").alias("text"))


def parts(lines: DataFrame, kind: Column) -> DataFrame:
    """Documents laid out in parts: two or more runs of method text right after a
    run of two or more items. (doc_id, n_parts)."""
    w = by_doc()
    d = lines.withColumn("kind", kind)
    d = islands(d, F.col("kind") != F.lag("kind").over(w))
    runs = d.groupBy("doc_id", "island").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    wr = Window.partitionBy("doc_id").orderBy("island")
    hit = (F.col("kind") == "prose") & (F.lag("kind").over(wr) == "ing") & (F.lag("n").over(wr) >= 2)
    return runs.withColumn("hit", hit).groupBy("doc_id").agg(F.count_if("hit").alias("n_parts")).filter("n_parts >= 2")


def fill_labels(lines: DataFrame) -> DataFrame:
    """lines(doc_id, i, label, best): label null = fits both sections. A run of such
    lines takes the section of the line before, else of the next line in one,
    else its first line's best."""
    w = by_doc()
    amb = F.col("label").isNull()
    d = lines.withColumns({"_amb": amb, "_new": amb & ~F.coalesce(F.lag(amb).over(w), F.lit(False))})
    d = islands(d, F.col("_new") | ~F.col("_amb"), "_run")
    sec = F.when(F.col("label").isin("ingredient", "step"), F.col("label"))
    d = d.withColumns({"_prev": F.lag(sec).over(w), "_next": F.first(sec, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    wr = Window.partitionBy("doc_id", "_run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.first(F.coalesce("_prev", "_next", "best")).over(wr)
    return d.withColumn("label", F.coalesce("label", head)).drop("_amb", "_new", "_run", "_prev", "_next", "best")


def counts_up(numbers: DataFrame, key: str, n: str) -> DataFrame:
    """Whether the numbers of each key are distinct and follow one another, by
    aggregates alone: (key, counts_up)."""
    return numbers.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.count_distinct(n).alias("d"), F.min(n).alias("lo"), F.max(n).alias("hi")).select(
        key, ((F.col("c") >= 2) & (F.col("c") == F.col("d")) & (F.col("hi") - F.col("lo") + 1 == F.col("c"))).alias("counts_up"))


def repeated_line(lines: DataFrame, above: Column | None = None) -> DataFrame:
    """First line per document that occurs more than once: (doc_id, line)."""
    d = lines if above is None else lines.filter(above)
    g = d.groupBy("doc_id", F.lower("line").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("i", "line")).alias("first"))
    return g.filter("n >= 2").groupBy("doc_id").agg(F.min("first").alias("f")).select("doc_id", F.col("f.line").alias("line"))


def best_block(lines: DataFrame, is_heading: Column, counts: Column) -> DataFrame:
    """The heading followed by most counted lines, the first on ties."""
    w = by_doc().rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumns({"_h": is_heading, "_c": counts})
    d = d.withColumn("block", F.sum(F.col("_h").cast("int")).over(w)).filter("block > 0")
    b = d.groupBy("doc_id", "block").agg(F.count_if(F.col("_c") & ~F.col("_h")).alias("hits"), F.min("i").alias("at"))
    return b.groupBy("doc_id").agg(F.max(F.struct("hits", -F.col("at"))).alias("m")).select("doc_id", F.col("m.hits").alias("hits"), (-F.col("m.col2")).alias("at"))


# --- precision over scores, any number of rows per tag -----------------------------------------

def _precision(scores: DataFrame, key: str) -> DataFrame:
    """Rows (key, p) with hits and rank counted down to p. Equal probabilities are
    one cut; the running sums go cell by cell over a grid of probabilities."""
    at_p = (scores.filter(F.col("p") >= W.FLOOR).groupBy(key, "p")
            .agg(F.sum("truth").alias("h"), F.count(F.lit(1)).alias("c")))
    grid = F.floor((1 - F.col("p")) * 1024)
    return running_totals(at_p, [key], F.desc("p"), grid, {"hits": F.col("h"), "rank": F.col("c")})


def threshold(scores: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the lowest probability whose suggestions are right often enough."""
    ok = (F.col("hits") >= W.MIN_HITS) & (F.col("hits") / F.col("rank") >= W.PRECISION)
    return _precision(scores, key).filter(ok).groupBy(key).agg(F.min("p").alias("threshold"))


def best_precision(scores: DataFrame, key: str) -> DataFrame:
    return (_precision(scores, key).filter(F.col("hits") >= W.MIN_HITS)
            .groupBy(key).agg(F.max(F.col("hits") / F.col("rank")).alias("best_precision")))


# --- log files ----------------------------------------------------------------------------------

def log_records(text: DataFrame, key: str, start: str, problems: list[str] | None = None) -> DataFrame:
    """(key, i, level, record): a line that starts a record and those after it."""
    d = text.select(key, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("rec", F.sum(F.col("line").rlike(start).cast("int")).over(w))
    r = d.groupBy(key, "rec").agg(F.min("i").cast("bigint").alias("i"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    r = r.select(key, "i", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("record"))
    r = r.withColumn("level", F.nullif(F.regexp_extract("record", start, 1), F.lit("")))
    return r if problems is None else r.filter(F.col("level").isin(problems))


def newest_records(records: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` last records in the order of ``by``, with their place from the newest: each task keeps so many, and those are merged."""
    last = records.orderBy(*[F.desc(c) for c in by]).limit(most)
    return last.withColumn("place", F.row_number().over(Window.orderBy(*[F.desc(c) for c in by])))      # ``most`` rows
