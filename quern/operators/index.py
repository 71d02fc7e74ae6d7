"""A stored search index: immutable segments of postings in blocks, and ranked top-k that skips blocks.

A segment holds, in folders by the hash of the term, rows of up to BLOCK postings of one term, the
strongest first, with the largest weight and the shortest document of the block: a bound of what any
of its documents can score. A change of documents writes one more segment and marks their earlier versions; no file of
an earlier segment is touched. Compaction merges segments into one.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions import text as T, words as W
from quern.operators import manifest as M, search as S
from quern.operators.selection import top_k
from quern.session import by_document, checkpoint_dir, cut_lineage, kept_by_document, small

BLOCK = 128
#: Postings of a term that one task puts in order; a commoner term is cut into parts by document.
PART_ROWS = 100_000
FOLDERS = 32


def weighted_postings(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, dl, term, wtf): words of a document's columns by weight, and its length in words. Only the texts are shuffled."""
    toks = by_document(docs.select("doc_id", *weights)).select("doc_id", *[T.tokens(F.col(c)).alias(c) for c in weights])
    dl = sum((F.size(c) for c in weights), F.lit(0)).cast("bigint")
    each = F.concat(*[F.transform(c, _weigher(w)) for c, w in weights.items()])
    return (toks.select("doc_id", dl.alias("dl"), F.inline_outer(each)).filter("term IS NOT NULL").groupBy("doc_id", "dl", "term").agg(F.sum("w").alias("wtf")))


def _weigher(w: float):
    def add(t):
        return F.struct(t.alias("term"), F.lit(w).alias("w"))
    return add


def _folder(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(FOLDERS)).cast("int")


def blocks_of(postings: DataFrame) -> DataFrame:
    """(folder, term, top_wtf, low_dl, n, posts array<struct<doc_id, wtf, dl>>) of (doc_id, dl, term, wtf)."""
    common = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PART_ROWS)
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / PART_ROWS).cast("int")
    # fewer terms than there are postings for each PART_ROWS of them
    p = postings.join(F.broadcast(common), "term", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    # strength is taken after the shuffle, which carries no more than the postings
    strong = lambda x: F.struct((-(x["wtf"] / (x["wtf"] + x["dl"] / 100))).alias("s"), x["doc_id"].alias("doc_id"), x["wtf"].alias("wtf"), x["dl"].alias("dl"))
    listed = p.groupBy("term", "part").agg(F.collect_list(F.struct("doc_id", "wtf", "dl")).alias("ps")).select("term", F.sort_array(F.transform("ps", strong)).alias("ps"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ps") - 1) / BLOCK).cast("int")), lambda b: F.struct(F.slice("ps", b * BLOCK + 1, F.lit(BLOCK)).alias("b")))
    b = listed.select("term", F.inline(cut))
    return b.select(_folder(F.col("term")).alias("folder"), "term", F.array_max(F.transform("b", lambda x: x["wtf"])).alias("top_wtf"),
                    F.array_min(F.transform("b", lambda x: x["dl"])).alias("low_dl"), F.size("b").alias("n"),
                    F.transform("b", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["wtf"].alias("wtf"), x["dl"].alias("dl"))).alias("posts"))


class SearchIndex:
    """The index under ``root``; every read sees one committed state."""

    def __init__(self, spark: SparkSession, root: str, state: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.state = state or M.newest(spark, self.root)[1]
        if self.state is None:
            raise FileNotFoundError(f"no index at {root}")

    # --- writing ---------------------------------------------------------------------------
    @staticmethod
    def build(docs: DataFrame, weights: dict[str, float], root: str) -> SearchIndex:
        """A new index of ``docs``(doc_id and the weighted columns); later identifiers must not repeat within one call."""
        spark, root = docs.sparkSession, root.rstrip("/")
        name = _write_segment(docs, weights, root)
        _, state = M.update(spark, root, lambda old: {"weights": weights, "segments": [name], "marks": [], "id": docs.schema["doc_id"].dataType.simpleString()})
        return SearchIndex(spark, root, state)

    def change(self, docs: DataFrame | None = None, gone: DataFrame | None = None) -> SearchIndex:
        """The index with ``docs`` in place of their earlier versions and without the documents in ``gone``(doc_id): one segment and one
        table of marks are added. A mark holds for the segments that were there before it."""
        ids = [d.select("doc_id") for d in (docs, gone) if d is not None]
        marked = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
        marks = f"marks-{uuid.uuid4().hex}"
        marked.distinct().write.parquet(f"{self.root}/{marks}")
        name = _write_segment(docs, self.state["weights"], self.root) if docs is not None else None

        def add(old: dict) -> dict:
            return old | {"marks": [*old["marks"], {"name": marks, "segments": old["segments"]}], "segments": [*old["segments"], *([name] if name else [])]}
        return SearchIndex(self.spark, self.root, M.update(self.spark, self.root, add)[1])

    def compact(self) -> SearchIndex:
        """All segments as one, without what is marked. Files of the old ones stay for readers of earlier states."""
        mine = self.state
        name = f"segment-{uuid.uuid4().hex}"
        blocks_of(self.postings()).write.partitionBy("folder").parquet(f"{self.root}/{name}/blocks")
        self.lengths().write.parquet(f"{self.root}/{name}/lengths")

        def swap(old: dict) -> dict:
            if old["segments"][:len(mine["segments"])] != mine["segments"] or old["marks"][:len(mine["marks"])] != mine["marks"]:
                raise RuntimeError("the index was compacted meanwhile")
            later = [m | {"segments": [name, *(s for s in m["segments"] if s not in mine["segments"])]} for m in old["marks"][len(mine["marks"]):]]
            return old | {"segments": [name, *old["segments"][len(mine["segments"]):]], "marks": later}
        return SearchIndex(self.spark, self.root, M.update(self.spark, self.root, swap)[1])

    # --- reading ---------------------------------------------------------------------------
    def _marked(self, segment: str) -> DataFrame | None:
        marks = [m["name"] for m in self.state["marks"] if segment in m["segments"]]
        return self.spark.read.parquet(*[f"{self.root}/{m}" for m in marks]).distinct() if marks else None

    def _written(self, terms: DataFrame | None) -> Iterator[tuple[str, DataFrame]]:
        """Each segment and its blocks as they were written, of ``terms``(term) only where given: just the folders of these are scanned."""
        folders = None
        if terms is not None:
            folders = [r[0] for r in terms.select(_folder(F.col("term"))).distinct().collect()]     # FOLDERS numbers at most
        for s in self.state["segments"]:
            b = self.spark.read.schema(f"folder int, term string, top_wtf double, low_dl bigint, n int, posts array<struct<doc_id:{self.state['id']},wtf:double,dl:bigint>>").parquet(f"{self.root}/{s}/blocks")
            if terms is not None:
                b = b.filter(F.col("folder").isin(folders)).join(terms.select("term").distinct(), "term", "left_semi")
            yield s, b.select("term", "top_wtf", "low_dl", "n", "posts")

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, top_wtf, low_dl, n, posts) of all segments, of ``terms``(term) only where given. Of a
        block with marked documents the others are left, and the bounds hold for them."""
        out = None
        for s, b in self._written(terms):
            marked = self._marked(s)
            if marked is not None:
                left = b.withColumn("block", F.xxhash64(F.lit(s), "term", "posts")).select("block", "term", "top_wtf", "low_dl", F.inline("posts")).join(marked, "doc_id", "left_anti")
                b = (left.groupBy("block", "term", "top_wtf", "low_dl").agg(F.count(F.lit(1)).cast("int").alias("n"), F.collect_list(F.struct("doc_id", "wtf", "dl")).alias("posts"))
                     .select("term", "top_wtf", "low_dl", "n", "posts"))
            out = b if out is None else out.unionByName(b)
        return out

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(doc_id, dl, term, wtf) of the live documents."""
        out = None
        for s, b in self._written(terms):
            p, marked = b.select("term", F.inline("posts")), self._marked(s)
            p = (p if marked is None else p.join(marked, "doc_id", "left_anti")).select("doc_id", "dl", "term", "wtf")
            out = p if out is None else out.unionByName(p)
        return out

    def lengths(self) -> DataFrame:
        """(doc_id, dl) of the live documents, those without words too."""
        out = None
        for s in self.state["segments"]:
            d, marked = self.spark.read.parquet(f"{self.root}/{s}/lengths"), self._marked(s)
            d = d if marked is None else d.join(marked, "doc_id", "left_anti")
            out = d if out is None else out.unionByName(d)
        return out

    def vocabulary(self) -> DataFrame:
        """(term, docs): a document has its words in one segment, so the blocks' sizes add up."""
        return self.blocks().groupBy("term").agg(F.sum("n").alias("docs"))

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, doc_id, score, rank): the ``k`` best documents of queries(qid, q) in which every word starts some term, without excluded ones;
        equal scores (to six digits) by the higher identifier.

        Candidates are the documents of the query's rarest word. The strongest blocks of its terms give k scores to beat; a block whose
        bound plus those of the other words stays below the k-th is never opened."""
        words = cut_lineage(S.parse(queries))
        wanted = words.filter("NOT leave_out").select("qid", "n", F.col("word").alias("prefix"))
        n_docs, mean = self.lengths().agg(F.count(F.lit(1)), F.avg("dl")).first()
        if not n_docs:
            return queries.select("qid", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)        # no documents
        k1, b = W.BM25_K1, W.BM25_B
        gain = lambda wtf, dl: wtf * (k1 + 1) / (wtf + k1 * (1 - b + b * dl / (mean or 1.0)))
        # the blocks of the words' terms, numbered, as files: bounds are read without the documents
        blocks = self._kept(S.by_start(self._numbered(), wanted))
        bounds = blocks.select("prefix", "term", "block", gain(F.col("top_wtf"), F.col("low_dl")).alias("g"))
        per_term = bounds.groupBy("prefix", "term").agg(F.max("g").alias("tg"))
        per_word = kept_by_document(self._live(blocks.select("segment", "prefix", F.inline("posts"))).groupBy("doc_id", "prefix", "dl").agg(F.sum("wtf").alias("wtf")))
        # what several terms of a word give together is less than the sum of what each can give, and never more than k1 + 1
        best = per_term.groupBy("prefix").agg(F.least(F.sum("tg"), F.lit(k1 + 1.0)).alias("most"), F.sum("tg").alias("all_terms"), F.count(F.lit(1)).alias("terms"))
        held = per_word.groupBy("doc_id", "prefix").agg(F.count(F.lit(1)).alias("rows")).groupBy("prefix").agg(F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("rows"))
        df = F.when(F.col("terms") > 1, F.col("docs")).otherwise(F.col("rows"))
        idf = F.greatest(F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        stats = cut_lineage(held.join(best, "prefix").select("prefix", "most", "all_terms", df.alias("df")).withColumn("idf", idf))
        asked = cut_lineage(wanted.join(stats, "prefix", "left").withColumn("need", F.count(F.lit(1)).over(_by("qid")))
                            .withColumn("bound", F.sum(F.col("idf") * F.col("most")).over(_by("qid"))))
        rarest = asked.groupBy("qid").agg(F.min_by(F.struct("n", "prefix", "idf", "most", "bound", "need", "all_terms"), F.struct("df", "n")).alias("r"), F.count_if(F.col("df").isNull()).alias("lost"))
        rarest = small(rarest.filter("lost = 0").select("qid", "r.*"))
        gone = small(self._excluded(words))

        # the bounds of the blocks alone, without their documents
        candidates = blocks.join(small(rarest.select("prefix").distinct()), "prefix", "left_semi")
        opened = (bounds.join(per_term, ["prefix", "term"]).join(rarest, "prefix")
                  .withColumn("limit", F.col("bound") - F.col("idf") * F.col("most") + F.col("idf") * F.least(F.col("g") + F.col("all_terms") - F.col("tg"), F.lit(k1 + 1.0))))
        first = opened.filter(F.col("g") >= F.col("tg") - 1e-12)      # each term's strongest block
        seeds = cut_lineage(self._scored(self._documents(first, candidates).join(gone, ["qid", "doc_id"], "left_anti"), asked, per_word, gain))
        bar = small(top_k(seeds, ["qid"], [F.desc("score"), F.desc("doc_id")], k).groupBy("qid").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("have")))
        more = (opened.filter(F.col("g") < F.col("tg") - 1e-12).join(bar.filter(F.col("have") == k), "qid", "left")
                .filter(F.col("bar").isNull() | (F.col("limit") >= F.col("bar") - 1e-6)))
        found = self._documents(more, candidates).join(seeds.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").join(gone, ["qid", "doc_id"], "left_anti")
        every = seeds.unionByName(self._scored(found, asked, per_word, gain))
        return top_k(every, ["qid"], [F.desc("score"), F.desc("doc_id")], k).select("qid", "doc_id", "score", "rank")

    def _numbered(self) -> DataFrame:
        """(segment, block, term, top_wtf, low_dl, posts) as written. Bounds hold for marked documents, too, so a block is not put together again without them."""
        out = None
        for k, (_, b) in enumerate(self._written(None)):
            b = b.select(F.lit(k).alias("segment"), "term", "top_wtf", "low_dl", "posts")
            out = b if out is None else out.unionByName(b)
        return out.withColumn("block", F.monotonically_increasing_id())

    def _kept(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _live(self, posts: DataFrame) -> DataFrame:
        """posts(segment, doc_id, ...) without what a later mark takes out of its segment."""
        marked = None
        for k, s in enumerate(self.state["segments"]):
            if (m := self._marked(s)) is not None:
                m = m.select(F.lit(k).alias("segment"), "doc_id")
                marked = m if marked is None else marked.unionByName(m)
        return posts if marked is None else posts.join(small(marked), ["segment", "doc_id"], "left_anti")

    def _documents(self, opened: DataFrame, blocks: DataFrame) -> DataFrame:
        """(qid, doc_id) of the live documents of opened(qid, block, prefix, ...)."""
        posts = blocks.select("segment", "block", "prefix", F.col("posts.doc_id").alias("ids"))
        return self._live(opened.select("qid", "block", "prefix").join(posts, ["block", "prefix"]).select("qid", "segment", F.explode("ids").alias("doc_id"))).select("qid", "doc_id").distinct()

    def _scored(self, candidates: DataFrame, asked: DataFrame, per_word: DataFrame, gain) -> DataFrame:
        """(qid, doc_id, score) of the candidates that have every word."""
        hits = candidates.join(small(asked.select("qid", "n", "prefix", "idf", "need")), "qid").join(per_word, ["prefix", "doc_id"])
        return (hits.groupBy("qid", "doc_id", "need").agg(F.count(F.lit(1)).alias("have"), F.sum(F.col("idf") * gain(F.col("wtf"), F.col("dl"))).alias("score"))
                .filter("have = need").select("qid", "doc_id", F.round("score", 6).alias("score")))

    def _excluded(self, words: DataFrame) -> DataFrame:
        forms = F.array_distinct(F.transform(F.array(F.lit(""), F.lit("s"), F.lit("es"), F.lit("x")), lambda e: F.concat("word", e)))
        f = cut_lineage(words.filter("leave_out").select("qid", F.explode(forms).alias("term")).distinct())
        return cut_lineage(self.postings(f.select("term")).select("term", "doc_id").join(f, "term").select("qid", "doc_id").distinct())


def _by(key: str):
    from pyspark.sql import Window
    return Window.partitionBy(key)


def _write_segment(docs: DataFrame, weights: dict[str, float], root: str) -> str:
    name = f"segment-{uuid.uuid4().hex}"
    blocks_of(weighted_postings(docs, weights)).write.partitionBy("folder").parquet(f"{root}/{name}/blocks")
    lengths = sum((F.size(T.tokens(F.col(c))) for c in weights), F.lit(0)).cast("bigint")
    docs.select("doc_id", lengths.alias("dl")).write.parquet(f"{root}/{name}/lengths")
    return name
