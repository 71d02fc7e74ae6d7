"""Batch search: a postings table, and a table of queries joined to it.

Everything is keyed joins and partial aggregates: a common word's postings are
never gathered, prefixes and typos are matched by equality on prefix and
deletion keys against the vocabulary (one row per term), not against postings.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import text as T, words as W
from quern.operators.selection import top_k
from quern.session import by_document, cut_lineage, kept_by_document, small


#: Deletion keys of words, as numbers, that are sent to every task; more meet by a shuffle.
FEW_KEYS = 1_000_000


# --- index -------------------------------------------------------------------------

def postings(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, col, term, tf). Only the texts are shuffled: the postings of a document stay in one task, and so do the steps
    of a search, which are all by document once a query's few terms are sent to the postings."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), T.tokens(F.col(c)).alias("toks")) for c in columns])
    return (by_document(docs.select("doc_id", *columns)).select("doc_id", F.inline(each)).select("doc_id", "col", F.explode("toks").alias("term"))
            .groupBy("doc_id", "col", "term").agg(F.count(F.lit(1)).alias("tf")))


def write_postings(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Sorted by term inside term-hash folders: a prefix read prunes by file
    statistics. Common terms spread over several files of their bucket."""
    (index.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
     .repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, docs) from one row per (doc_id, term)."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


def vocabulary_of(index: DataFrame) -> DataFrame:
    """(term, docs). A document's terms are told apart in its task, so no more than counts are shuffled."""
    return by_document(index.select("doc_id", "term")).distinct().groupBy("term").agg(F.count("doc_id").alias("docs"))


# --- queries ------------------------------------------------------------------------

def parse(queries: DataFrame, most_words: int | None = None) -> DataFrame:
    """queries(qid, q) -> (qid, n, typed, word, leave_out): all words, or the first ``most_words``; "-word"
    leaves out, control characters are blanks. ``word`` is the folded form."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("q", "\\p{Cc}", " "), "(?U)\\s+", " "))
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    words = words if most_words is None else F.slice(words, 1, most_words)
    w = queries.select("qid", F.posexplode(words).alias("n", "w")).filter("w <> '-'")
    out = F.col("w").startswith("-") & (F.length("w") > 1)
    typed = F.when(out, F.substring("w", F.lit(2), F.length("w"))).otherwise(F.col("w"))
    return w.select("qid", F.col("n").cast("bigint").alias("n"), typed.alias("typed"), T.fold(typed).alias("word"), out.alias("leave_out"))


def _prefix_keys(term: Column) -> Column:
    return F.array_distinct(F.array(F.substring(term, 1, 1), F.substring(term, 1, 2), F.substring(term, 1, 3)))


def by_prefix(words: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """words joined to every vocabulary term they start: an equality on the first
    one to three letters, then the exact test."""
    v = vocab.withColumn("pk", F.explode(_prefix_keys(F.col("term"))))
    w = words.filter(F.col(word) != "").withColumn("pk", F.substring(word, 1, 3))
    return w.join(v, "pk").filter(F.col("term").startswith(F.col(word))).drop("pk")


def by_start(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """rows(term, ...) joined to every one of prefixes(prefix) that starts their term. A term gives a key for each length that a prefix has, so
    what is sent to the tasks grows with the prefixes and not with the terms they start."""
    px = small(prefixes.filter("prefix <> ''").select("prefix").distinct())
    lengths = sorted(r[0] for r in px.select(F.length("prefix")).distinct().collect())      # lengths of a query's words
    of = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("term"))
    return rows.withColumn("prefix", F.explode(F.transform(of, lambda n: F.substring("term", F.lit(1), n)))).join(px, "prefix")


def _asked(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prefixes(qid, n, prefix) -> (qid, n, word), (prefix, word): what a word of a query may start with is one word for all queries that have it.
    A prefix that a shorter one of the same word starts is left out, so a term has one prefix of a word at most."""
    p = prefixes.filter("prefix <> ''").groupBy("qid", "n").agg(F.array_sort(F.collect_set("prefix")).alias("ps"))
    apart = F.filter("ps", lambda x: ~F.exists("ps", lambda y: (y != x) & x.startswith(y)))
    words = cut_lineage(p.select("qid", "n", apart.alias("ps")).withColumn("word", F.array_join("ps", " ")))      # no prefix has a blank
    return small(words.select("qid", "n", "word")), small(words.select(F.explode("ps").alias("prefix"), "word").distinct())


def commonest(words: DataFrame, vocab: DataFrame, word: str) -> DataFrame:
    """(word, shown): the term with most documents that starts with the word, first
    alphabetically on ties."""
    hit = by_prefix(words.select(word).distinct(), vocab, word)
    return hit.groupBy(word).agg(F.min_by("term", F.struct(-F.col("docs"), "term")).alias("shown"))


def _deletes(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def deletion_keys(c: Column, edits: Column) -> Column:
    """All strings left by taking up to ``edits`` (1 or 2) letters out: words within
    that many edits, swaps included, always share one."""
    one = _deletes(c)
    two = F.when(edits >= 2, F.flatten(F.transform(one, _deletes))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), one, two))


def _hashed(keys: Column) -> Column:
    """A row for each key, as a number: what meets by chance is told apart by the distance, which is taken of all pairs."""
    return F.explode(F.transform(keys, lambda x: F.xxhash64(x)))


def _spread(vocab: DataFrame) -> DataFrame:
    """The vocabulary is small but each term fans out to a hundred keys: keep all
    tasks busy instead of letting small partitions be merged."""
    return vocab.repartition(int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")), "term")


def fuzzy(words: DataFrame, vocab: DataFrame, distance: str = "osa") -> DataFrame:
    """words(word) -> (word, term, docs, d): terms of three letters or more within
    the edits a word's length allows."""
    w = words.select("word").distinct().withColumn("k", T.allowed_edits(F.col("word"))).filter("k > 0")
    v = _spread(vocab).filter(F.length("term") >= 3).withColumn("vk", F.when(F.length("term") >= 6, 2).otherwise(1))
    pairs = (small(w.withColumn("key", _hashed(deletion_keys(F.col("word"), F.col("k")))), FEW_KEYS)
             .join(v.withColumn("key", _hashed(deletion_keys(F.col("term"), F.col("vk")))), "key")
             .select("word", "k", "term", "docs").distinct()
             .filter(F.abs(F.length("word") - F.length("term")) <= F.col("k"))
             .filter(F.levenshtein("word", "term") <= 2 * F.col("k")))
    d = T.osa_distance(F.col("word"), F.col("term")) if distance == "osa" else F.levenshtein("word", "term")
    return pairs.withColumn("d", d).filter("d <= k").select("word", "term", "docs", "d")


def fuzzy_starts(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Misspelt starts of longer terms: same first letter, one edit in as many
    letters as the word has. (word, term, docs, d) with d past the whole-word limit."""
    w = words.select("word").distinct().withColumn("k", T.allowed_edits(F.col("word"))).filter("k > 0")
    lengths = w.select(F.length("word").alias("n")).distinct()
    v = (_spread(vocab).filter(F.length("term") > 4)
         .withColumn("n", F.explode(F.sequence(F.lit(4), F.length("term") - 1))).join(lengths, "n", "left_semi")
         .withColumn("head", F.expr("substring(term, 1, n)"))
         .withColumn("key", F.explode(deletion_keys(F.col("head"), F.lit(1)))))
    wk = w.withColumn("n", F.length("word")).withColumn("key", F.explode(deletion_keys(F.col("word"), F.lit(1))))
    pairs = (wk.join(v, ["n", "key"]).filter(F.substring("word", 1, 1) == F.substring("term", 1, 1))
             .select("word", "k", "term", "docs", "head").distinct().filter(F.levenshtein("word", "head") <= 2))
    return (pairs.filter(T.osa_distance(F.col("word"), F.col("head")) <= 1)
            .select("word", "term", "docs", (F.col("k") + 1).alias("d")))


def corrections(words: DataFrame, vocab: DataFrame, most: int = W.MAX_CORRECTIONS) -> DataFrame:
    """The ``most`` closest spellings of words nothing starts with: (word, rank, term)."""
    w = words.select("word").distinct().filter(F.col("word").rlike("^[\\p{L}\\p{N}_]+$"))
    lost = cut_lineage(w.join(by_prefix(w, vocab).select("word").distinct(), "word", "left_anti"))
    found = (fuzzy(lost, vocab).unionByName(fuzzy_starts(lost, vocab)).groupBy("word", "term", "docs").agg(F.min("d").alias("d")))
    return top_k(found, ["word"], [F.asc("d"), F.desc("docs"), F.asc("term")], most).select("word", "rank", "term")


def expand(words: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """words(qid, n, typed, word) -> (prefixes, corrected). prefixes(qid, n, prefix):
    the starts a word may match by; corrected(qid, typed, used, ord)."""
    w = words.select("word").distinct()
    hit = by_prefix(w, vocab).select("word").distinct()
    lost = cut_lineage(w.join(hit, "word", "left_anti"))
    stems = lost.select("word", T.stem(F.col("word")).alias("alt")).filter("alt <> word")
    stems = stems.join(by_prefix(stems.select("alt").distinct(), vocab, "alt").select("alt").distinct(), "alt", "left_semi")
    alts = (stems.select("word", "alt", F.lit(0).alias("rank"))
            .unionByName(corrections(lost, vocab).select("word", F.col("term").alias("alt"), "rank")))
    starts = (w.select("word", F.col("word").alias("prefix"))
              .unionByName(alts.select("word", T.stem(F.col("alt")).alias("prefix"))).distinct())
    shown = alts.join(commonest(alts, vocab, "alt"), "alt").groupBy("word", "shown").agg(F.min("rank").alias("ord"))
    return (words.join(starts, "word").select("qid", "n", "prefix"),
            words.join(shown, "word").select("qid", "typed", F.col("shown").alias("used"), "ord"))


def corrected_report(corrected: DataFrame) -> DataFrame:
    """(qid, corrected): {typed: [used]} per query."""
    per_word = corrected.groupBy("qid", "typed").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "used"))), lambda x: x["used"]).alias("used"))
    return per_word.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("typed", "used")))).alias("corrected"))


# --- matching and ranking ------------------------------------------------------------

def matches(prefixes: DataFrame, index: DataFrame, weights: dict[str, float], n_docs: Column,
            lengths: DataFrame, mean_length: Column) -> DataFrame:
    """(qid, doc_id, score, n_terms): documents where every word of the query starts
    some term. BM25 over weighted term counts (Robertson and Zaragoza 2009); a word
    is one search item whatever terms it starts, as a prefix search counts it."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    asks, starts = _asked(prefixes)
    # per document and word first, however many queries have the word: the weighted count over the columns
    held = by_start(index.filter(F.col("col").isin(list(weights))), starts)
    per_prefix = held.groupBy("doc_id", "prefix").agg(F.sum(F.col("tf") * F.element_at(weight, F.col("col"))).alias("wtf"))
    # counted and scored: kept, as it is a small part of the postings
    per_word = kept_by_document(per_prefix.join(starts, "prefix").groupBy("doc_id", "word").agg(F.sum("wtf").alias("wtf")))
    idf = F.greatest(F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    known = small(per_word.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf).select("word", "idf"))
    need = small(prefixes.groupBy("qid").agg(F.count_distinct("n").alias("need")))
    k1, b = W.BM25_K1, W.BM25_B
    part = F.col("idf") * F.col("wtf") * (k1 + 1) / (F.col("wtf") + k1 * (1 - b + b * F.col("dl") / mean_length))
    parts = per_word.join(known, "word").join(lengths.hint("shuffle_hash"), "doc_id").select("doc_id", "word", part.alias("part"))
    return (parts.join(asks, "word").groupBy("doc_id", "qid").agg(F.count(F.lit(1)).alias("n_words"), F.sum("part").alias("score"))
            .join(need, "qid").filter("n_words = need").select("qid", "doc_id", "score"))


def document_lengths(index: DataFrame) -> DataFrame:
    return index.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def _left_out(words: DataFrame) -> DataFrame:
    """(qid, term): the words to leave out and their plural forms."""
    forms = F.array_distinct(F.transform(F.array(F.lit(""), F.lit("s"), F.lit("es"), F.lit("x")), lambda e: F.concat("word", e)))
    return words.filter("leave_out").select("qid", F.explode(forms).alias("term")).distinct()


def excluded(words: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, doc_id) to leave out: the word or its plural forms, whole."""
    return index.select("doc_id", "term").join(small(_left_out(words)), "term").select("qid", "doc_id").distinct()


def search(queries: DataFrame, docs: DataFrame, index: DataFrame, columns: dict[str, float], typos: bool = True) -> DataFrame:
    """(qid, doc_id, score): every word must match, exclusions taken out, typos
    corrected. Sort by score, newest first on ties. ``index`` is read several
    times: pass a written or checkpointed one."""
    index = by_document(index)      # a checkpoint forgets how its rows were dealt
    words = parse(queries)
    wanted = words.filter("NOT leave_out")
    prefixes = cut_lineage(expand(wanted, cut_lineage(vocabulary_of(index)))[0]) if typos else wanted.select("qid", "n", F.col("word").alias("prefix"))
    lengths = document_lengths(index)
    n_docs, mean = docs.agg(F.count(F.lit(1))).scalar(), lengths.agg(F.avg("dl")).scalar()
    hits = matches(prefixes, index, columns, n_docs, lengths, mean)
    gone = index.select("doc_id", "term").join(small(_left_out(words)), "term").groupBy("doc_id").agg(F.collect_set("qid").alias("_gone"))
    return (hits.join(gone.hint("shuffle_hash"), "doc_id", "left").filter(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("qid")))
            .select("qid", "doc_id", "score"))


def provenance(prefixes: DataFrame, index: DataFrame, vocab: DataFrame, tag_columns: list[str]) -> DataFrame:
    """(qid, doc_id, via): text, tag, or both when only together every word matches."""
    terms = small(by_prefix(prefixes, vocab, "prefix").select("qid", "n", "term").distinct())
    is_tag = F.col("col").isin(tag_columns)
    hit = (index.join(terms, "term").groupBy("doc_id", "qid", "n").agg(F.max(is_tag).alias("in_tag"), F.max(~is_tag).alias("in_text")))
    need = small(prefixes.groupBy("qid").agg(F.count_distinct("n").alias("need")))
    d = (hit.groupBy("doc_id", "qid").agg(F.count(F.lit(1)).alias("k"), F.count_if("in_tag").alias("t"), F.count_if("in_text").alias("x"))
         .join(need, "qid").filter("k = need"))
    return d.select("qid", "doc_id", F.when((F.col("t") == F.col("need")) & (F.col("x") == F.col("need")), "tag,text")
                    .when(F.col("x") == F.col("need"), "text").when(F.col("t") == F.col("need"), "tag").otherwise("tag,text").alias("via"))


def excerpts(prefixes: DataFrame, index: DataFrame, vocab: DataFrame, docs: DataFrame, columns: list[str],
             size: int = W.EXCERPT_TOKENS) -> DataFrame:
    """(qid, doc_id, excerpt) of documents matching all words: the run of ``size``
    words with most matches in the first of ``columns`` that has one, matches
    marked; none where the title matches. The index decides which column, so only the
    texts shown are read, and each is cut into words once for all queries."""
    asked, starts = _asked(prefixes)
    need = small(prefixes.groupBy("qid").agg(F.count_distinct("n").alias("need"), F.collect_set(F.when(F.col("prefix") != "", F.col("prefix"))).alias("starts")))
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(["title", *columns]) for x in (c, i)])
    place = F.try_element_at(rank, F.col("col"))
    hit = by_start(by_document(index), starts).groupBy("doc_id", "prefix").agg(F.min(place).alias("place"))
    word = hit.join(starts, "prefix").groupBy("doc_id", "word").agg(F.min("place").alias("place"))
    chosen = (word.join(asked, "word").groupBy("doc_id", "qid").agg(F.count(F.lit(1)).alias("k"), F.min("place").alias("best"))
              .join(need.select("qid", "need"), "qid").filter("k = need AND best > 0"))
    asks = chosen.groupBy("doc_id", "best").agg(F.collect_list("qid").alias("asks"))
    text = F.coalesce(*[F.when(F.col("best") == i + 1, F.col(c)) for i, c in enumerate(columns)])
    d = by_document(docs.select("doc_id", *columns)).join(asks.hint("shuffle_hash"), "doc_id").select("doc_id", "asks", text.alias("text"))
    # folded words decide; the written ones are shown (folding keeps their number)
    d = d.withColumns({"folded": T.tokens(F.col("text")), "written": F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))})
    d = d.select("doc_id", "folded", "written", F.explode("asks").alias("qid")).join(need.select("qid", "starts"), "qid")
    d = d.withColumn("at", F.array_compact(F.transform("folded", lambda w, i: F.when(F.exists("starts", lambda p: w.startswith(p)), i))))
    # a run starts at a match; the next few matches tell how many it holds
    best = F.array_max(F.transform("at", lambda p, j: F.struct(
        F.size(F.filter(F.slice("at", j + 1, F.lit(size)), lambda q: q < p + size)).alias("hits"), (-p).alias("at"))))
    d = d.withColumn("start", -best["at"])
    shown = F.when(F.size("written") == F.size("folded"), F.col("written")).otherwise(F.col("folded"))
    d = d.withColumn("run", F.slice(shown, F.col("start") + 1, F.lit(size)))
    show = F.transform("run", lambda w, i: F.when(F.array_contains("at", F.col("start") + i), F.concat(
        F.lit(W.MARK_START), w, F.lit(W.MARK_END))).otherwise(w))
    return d.select("qid", "doc_id", F.array_join(show, " ").alias("excerpt"))
