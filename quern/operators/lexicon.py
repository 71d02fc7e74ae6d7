"""Lexicon joins: dictionary annotation of texts by token n-grams.

A lexicon is a DataFrame of names. One of up to FEW names (counted) goes to every task as a trie
of words, which is walked along the words of a text in its row: no n-gram leaves the row. For a larger one texts
are cut into n-grams of the lengths it holds and met by an equi join. Both give the same rows.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import fold

WORD = "[a-z0-9]+"
MAX_WORDS = 6
#: Names of a lexicon that a task holds as a trie: some tens of MB.
FEW = 100_000


class Trie:
    """Names as paths of words; each ends in the numbers of its entries."""

    END = ""        # no word is empty

    def __init__(self):
        self.root: dict = {}

    def add(self, words: list[str], entry: int) -> None:
        node = self.root
        for w in words:
            node = node.setdefault(w, {})
        if words:
            node.setdefault(self.END, []).append(entry)

    def starting(self, words, at: int) -> list[int]:
        """Entries of the names that start at a place."""
        node, found = self.root.get(words[at]), []
        while node is not None:
            found += node.get(self.END, ())
            at += 1
            node = node.get(words[at]) if at < len(words) else None
        return found

    def first(self, words, order: list) -> int | None:
        """The entry that comes first in ``order`` of those at the leftmost place with any."""
        for at in range(len(words)):
            if words[at] in self.root and (found := self.starting(words, at)):
                return min(found, key=order.__getitem__)
        return None

    def all(self, words) -> list[int]:
        return sorted({e for at in range(len(words)) if words[at] in self.root for e in self.starting(words, at)})


def _entries(lexicon: DataFrame, few: int) -> list | None:
    """The rows of a lexicon small enough for every task, numbered by their place; None of a larger one."""
    rows = lexicon.limit(few + 1).collect()
    return rows if len(rows) <= few else None


def _numbered(lexicon: DataFrame, rows: list) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lexicon.schema), "_entry int"])
    return F.broadcast(lexicon.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema))


def grams(toks: Column, longest: int = MAX_WORDS) -> Column:
    """array<struct<pos, gram>> of all runs of 1..longest tokens."""
    def of_length(n):
        starts = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(p.alias("pos"), F.array_join(F.slice(toks, p, n), " ").alias("gram")))
    return F.concat(*[of_length(n) for n in range(1, longest + 1)])


def lexicon_words(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def longest_name(lexicon: DataFrame, column: str) -> int:
    """Words in the longest name; a lexicon is small, its size checked here."""
    row = lexicon.agg(F.max(F.size(lexicon_words(F.col(column)))).alias("n")).first()
    return max(1, int(row["n"] or 1))


def keyword_hits(docs: DataFrame, doc_id: str, text: str, keywords: DataFrame) -> DataFrame:
    """First keyword (lowest ord) per (doc, tag): (doc_id, tag_name, category, keyword).
    keywords: (tag_name, category, ord, keyword)."""
    lexicon = keywords.select("tag_name", "category", "ord", "keyword").withColumn("_words", lexicon_words(F.col("keyword")))
    rows = _entries(lexicon, FEW)
    if rows is not None:
        trie = Trie()
        for k, r in enumerate(rows):
            trie.add(r["_words"] or [], k)

        @F.pandas_udf("array<int>")
        def found(words: pd.Series) -> pd.Series:
            return pd.Series([None if w is None else trie.all(w) for w in words])
        hits = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found(lexicon_words(F.col(text)))).alias("_entry"))
        return (hits.join(_numbered(lexicon, rows), "_entry").groupBy("doc_id", "tag_name", "category")
                .agg(F.min_by("keyword", F.struct("ord", "keyword")).alias("keyword")))
    k = keywords.withColumn("gram", F.array_join(lexicon_words(F.col("keyword")), " "))
    n = longest_name(keywords, "keyword")
    g = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.transform(
        grams(lexicon_words(F.col(text)), n), lambda x: x["gram"]))).alias("gram"))
    return (g.join(k, "gram").groupBy("doc_id", "tag_name", "category").agg(F.min_by("keyword", F.struct("ord", "keyword")).alias("keyword")))


def expand_plurals(lexicon: DataFrame, name: str) -> DataFrame:
    """Each name with its plural endings as extra rows: (…, form, name_len)."""
    f = F.array_join(F.regexp_extract_all(fold(F.col(name)), F.lit(WORD), F.lit(0)), " ")
    forms = F.array_distinct(F.transform(F.array(F.lit(""), F.lit("s"), F.lit("es"), F.lit("x")), lambda e: F.concat(f, e)))
    return lexicon.withColumn("name_len", F.length(fold(F.col(name)))).withColumn("form", F.explode(forms))


def annotate(lines: DataFrame, key: str, text: Column, lexicon: DataFrame, name: str, payload: list[str]) -> DataFrame:
    """Leftmost, then longest lexicon name in each distinct line: the key columns
    plus the payload of the winner; lines without a name are left out.
    ``text`` is the folded part of the line that may hold a name."""
    lex = expand_plurals(lexicon, name).withColumn("_lex_name", F.col(name))
    toks = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = _entries(lex, FEW)
    if rows is not None:
        trie, order = Trie(), [(-r["name_len"], r["_lex_name"]) for r in rows]
        for k, r in enumerate(rows):
            trie.add(r["form"].split(), k)

        @F.pandas_udf("int")
        def first(words: pd.Series) -> pd.Series:
            return pd.Series([None if w is None else trie.first(w, order) for w in words], dtype="Int32")
        hits = lines.select(F.col(key).alias("_key"), first(toks).alias("_entry")).filter("_entry IS NOT NULL")
        table = _numbered(lex, rows).select("_entry", F.struct(*payload).alias("_hit"))
        found = hits.join(F.broadcast(table), "_entry")
        return found.select(F.col("_key").alias(key), *[F.col(f"_hit.{c}").alias(c if c != key else f"{c}_found") for c in payload])
    n = longest_name(lexicon, name)
    g = lines.select(F.col(key).alias("_key"), F.inline(grams(toks, n)))
    best = F.min_by(F.struct(*payload), F.struct("pos", -F.col("name_len"), "_lex_name"))
    hits = g.join(lex, g["gram"] == lex["form"]).groupBy("_key").agg(best.alias("_hit"))
    return hits.select(F.col("_key").alias(key), *[F.col(f"_hit.{c}").alias(c if c != key else f"{c}_found") for c in payload])
