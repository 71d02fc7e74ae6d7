"""Same link or same title: first of each key, lookups, connected groups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import link_key, title_key
from quern.operators.selection import top_k
from quern.plans.skew import salted_lookup
from quern.session import cut_lineage

MAX_FOUND = 5


def keyed(records: DataFrame) -> DataFrame:
    """(id, title, link_key, title_key)."""
    return records.select("id", "title", link_key(F.col("source_url")).alias("link_key"),
                          title_key(F.col("title")).alias("title_key"))


def index(k: DataFrame) -> DataFrame:
    """First (lowest id) record per key: (kind, key, id, title)."""
    pairs = k.select("id", "title", F.inline(F.array(
        F.struct(F.lit("link").alias("kind"), F.col("link_key").alias("key")),
        F.struct(F.lit("title").alias("kind"), F.col("title_key").alias("key")))))
    return (pairs.filter("key IS NOT NULL").groupBy("kind", "key")
            .agg(F.min_by(F.struct("id", "title"), "id").alias("first")).select("kind", "key", "first.*"))


def _first_ids(k: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """The n lowest ids per key; each partition drops the rest before the shuffle."""
    return (top_k(k.filter(F.col(key).isNotNull()).select(key, "id", "title"), [key], [F.asc("id")], n)
            .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias(name)))


def lookup(probes: DataFrame, library: DataFrame, limit: int = MAX_FOUND) -> DataFrame:
    """Records that look like each probe, link matches before title matches, the
    probe itself left out, at most ``limit``: (probe_id, rank, id, title, reason).

    Pairs inside a group are never formed: per key the few lowest ids decide.
    ``limit + 1`` of a link (one may be the probe) and ``2 * limit + 1`` of a title
    (``limit`` more may already be link matches) always suffice."""
    by_link = _first_ids(library, "link_key", limit + 1, "links")
    by_title = _first_ids(library, "title_key", 2 * limit + 1, "titles")
    p = probes.select(F.col("id").alias("probe_id"), "link_key", "title_key")
    p = salted_lookup(p, by_link, ["link_key"], "left")
    p = salted_lookup(p, by_title, ["title_key"], "left")
    none = F.array().cast("array<struct<id:bigint,title:string>>")
    tag = lambda arr, why: F.transform(arr, lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), F.lit(why).alias("reason")))
    links = F.filter(F.coalesce("links", none), lambda x: x["id"] != F.col("probe_id"))
    titles = F.filter(F.coalesce("titles", none), lambda x: (x["id"] != F.col("probe_id"))
                      & ~F.array_contains(F.transform(links, lambda y: y["id"]), x["id"]))
    found = F.slice(F.concat(tag(links, "link"), tag(titles, "title")), 1, limit)
    return p.select("probe_id", F.posexplode(found).alias("pos", "hit")).select(
        "probe_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "hit.*")


def groups(k: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected sets over both keys: (group_id, id, title) of sets of two or more.

    Equal (link, title) pairs fold into one node first, so a mass of copies is one
    node. Labels then move over shared keys: minimum per key (a partial aggregate),
    back to the nodes by a salted lookup, then a jump to the label's own label, so
    long chains close in few rounds. Each round ends in a reliable checkpoint."""
    nodes = cut_lineage(k.groupBy("link_key", "title_key").agg(F.min("id").alias("node")))
    member = nodes.select("node", F.explode(F.array_compact(F.array(
        F.when(F.col("link_key").isNotNull(), F.concat(F.lit("l:"), "link_key")),
        F.when(F.col("title_key").isNotNull(), F.concat(F.lit("t:"), "title_key"))))).alias("key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    member = cut_lineage(salted_lookup(member, shared, ["key"]))
    labels = member.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(max_rounds):
        # a node has at most two keys: no skew on this side
        at_key = member.join(labels, "node").groupBy("key").agg(F.min("label").alias("key_label"))
        moved = (salted_lookup(member, at_key, ["key"]).groupBy("node").agg(F.min("key_label").alias("near")))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        nxt = (salted_lookup(moved, jump, ["near"], "left")
               .select("node", F.least("near", F.coalesce("far", "near")).alias("new_label")))
        step = cut_lineage(nxt.join(labels, "node").select("node", "new_label", (F.col("new_label") < F.col("label")).alias("changed")))
        labels = step.select("node", F.col("new_label").alias("label"))
        if step.filter("changed").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    # null keys are not equal to each other: a stand-in makes the pair a plain key
    pair = [F.coalesce("link_key", F.lit("\0")).alias("lk"), F.coalesce("title_key", F.lit("\0")).alias("tk")]
    placed = nodes.join(labels, "node", "left").select(*pair, F.coalesce("label", "node").alias("group_id"))
    rows = salted_lookup(k.select("id", "title", *pair), placed, ["lk", "tk"])
    # records without any key stand alone
    rows = rows.filter((F.col("lk") != "\0") | (F.col("tk") != "\0")).select("group_id", "id", "title")
    big = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group_id")
    return salted_lookup(rows, big, ["group_id"])


def import_batch(library: DataFrame, batch: DataFrame) -> DataFrame:
    """Outcome per batch row (seq order): skipped when its link is in the library
    or an earlier saved row; else saved, noting an earlier record of its title.
    library, batch: (id, title, link_key, title_key), batch also seq."""
    lib = library.select("id", "title", "link_key", "title_key", F.lit(0).alias("src"), F.col("id").alias("seq"))
    all_rows = lib.unionByName(batch.select("id", "title", "link_key", "title_key", F.lit(1).alias("src"), "seq"))
    place = F.struct("src", "seq")
    first_link = (all_rows.filter("link_key IS NOT NULL").groupBy("link_key")
                  .agg(F.min(F.struct("src", "seq", "id")).alias("fl")))
    b = salted_lookup(all_rows.filter("src = 1"), first_link, ["link_key"], "left")
    b = b.withColumn("link_of", F.when(F.col("fl").isNotNull() & (F.col("fl.id") != F.col("id")), F.col("fl.id"))).drop("fl")
    saved = b.filter("link_of IS NULL")
    titled = lib.drop("link_key").unionByName(saved.select("id", "title", "title_key", "src", "seq"))
    first_title = (titled.filter("title_key IS NOT NULL").groupBy("title_key")
                   .agg(F.min(F.struct("src", "seq", "id")).alias("ft")))
    out = salted_lookup(b, first_title, ["title_key"], "left")
    dup = F.when(F.col("ft").isNotNull() & (F.struct("ft.src", "ft.seq") < place), F.col("ft.id"))
    return out.select("id", "title", F.when(F.col("link_of").isNotNull(), "skipped").otherwise("saved").alias("status"),
                      F.coalesce("link_of", dup).alias("existing_id"))


def latest(changes: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Last value per key, by a partial aggregate."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("value")), F.struct(*order)).alias("last")).select(*keys, "last.value")
