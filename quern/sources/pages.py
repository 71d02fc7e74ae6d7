"""Web pages to records: structured data first, then headings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions import patterns as P, text as T
from quern.session import cut_lineage

LD_BLOCK = r'(?is)<script\b[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script\s*>'
#: Lists and objects inside each other beyond this many are reported, not opened.
MOST_DEPTH = 200
#: Levels that a round opens: pages seldom have more.
AT_ONCE = 4


def get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def as_list(v: Column, path: str = "$") -> Column:
    return get(v, path, "array<variant>")


def kinds(v: Column) -> Column:
    return F.coalesce(get(v, "$['@type']", "array<string>"), F.array_compact(F.array(get(v, "$['@type']", "string"))))


def kinds_of(type_: Column) -> Column:
    return F.coalesce(get(type_, "$", "array<string>"), F.array_compact(F.array(get(type_, "$", "string"))))


def clean_text(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)<\s*(?:br|/p|/li|/div|/h[1-6])\b[^>]*>", " "), "<[^>]+>", "")
    t = F.when(c.contains("<"), bare).otherwise(c)
    return F.nullif(T.squeeze(F.translate(T.unescape(t), " ", " ")), F.lit(""))


def text_at(v: Column, path: str) -> Column:
    """A text field: a string (numbers too), or the first string of a list."""
    return clean_text(F.coalesce(F.get(F.filter(get(v, path, "array<string>"), lambda s: F.trim(s) != ""), F.lit(0)), get(v, path, "string")))


def text_lines(c: Column) -> Column:
    return F.array_compact(F.transform(F.split(c, "\n"), clean_text))


_ITEM = "array<struct<v:variant,line:string,level:int>>"


#: What is asked of an object among the steps, taken in one pass over its fields.
_FIELDS = "struct<`@type`:variant,text:string,name:string,itemListElement:variant>"


def _opened(items: Column) -> Column:
    """The items of a step list, opened one level: a list gives its members, a section its heading and
    members one level deeper, anything else its text. Texts are taken as they are and cleaned at the end.

    A lambda computes a value each time it is named, so what is asked of a variant more than once is a field first."""
    item = lambda value, line, at: F.struct(value.alias("v"), line.alias("line"), at.cast("int").alias("level"))
    no_line, no_value = F.lit(None).cast("string"), F.lit(None).cast("variant")
    inner = lambda x: x["o"]["itemListElement"]
    parts = lambda x: F.coalesce(as_list(inner(x)), F.when(get(inner(x), "$", "struct<name:string>").isNotNull(), F.array(inner(x))))
    read = F.transform(items, lambda x: F.struct(x.alias("x"), get(x["v"], "$", _FIELDS).alias("o"), as_list(x["v"]).alias("list")))
    read = F.transform(read, lambda x: F.struct(x["x"].alias("x"), x["o"].alias("o"), x["list"].alias("list"), parts(x).alias("parts")))

    def open_(r):
        x, o = r["x"], r["o"]
        section = o.isNotNull() & F.coalesce((r["parts"].isNotNull() & o["text"].isNull()) | F.array_contains(kinds_of(o["@type"]), "HowToSection"), F.lit(False))
        heading = F.array(item(no_value, o["name"], -(x["level"] + 1)))
        members = lambda of, deeper: F.transform(F.coalesce(of, F.array().cast("array<variant>")), lambda m: item(m, no_line, x["level"] + deeper))
        plain = F.array(item(no_value, F.when(o.isNotNull(), F.coalesce(o["text"], o["name"])).otherwise(get(x["v"], "$", "string")), x["level"]))
        return F.when(x["v"].isNull(), F.array(x)).when(section, F.concat(heading, members(r["parts"], 1))).when(r["list"].isNotNull(), members(r["list"], 0)).otherwise(plain)
    return F.flatten(F.transform(read, open_))


def _cleaned(items: Column) -> Column:
    """(line, level) of opened items: headings as "Name:", texts line by line, nothing of empty ones."""
    line = lambda text, level: F.struct(text.alias("line"), level.alias("level"))
    split = F.flatten(F.transform(F.filter(items, lambda x: x["line"].isNotNull()), lambda x: F.transform(
        F.when(x["level"] < 0, F.array(x["line"])).otherwise(F.split(x["line"], "\n")), lambda l: line(l, x["level"]))))
    clean = F.filter(F.transform(split, lambda x: line(clean_text(x["line"]), x["level"])), lambda x: x["line"].isNotNull())
    return F.transform(clean, lambda x: line(F.when(x["level"] < 0, F.concat(F.rtrim(x["line"], F.lit(":")), F.lit(":"))).otherwise(x["line"]), x["level"]))


def _in_order(items: Column) -> Column:
    """Lines of cleaned items; a heading at level n is kept as level -n and stays only with a step below it."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("below"))

    def keep(acc, x):
        # from the last item to the first: a heading stays if what follows it is deeper
        level = F.abs(x["level"])
        stays = (x["level"] >= 0) | (acc["below"] >= level)
        below = F.when(x["level"] >= 0, level).otherwise(level - 1)
        return F.when(stays, F.struct(F.array_append(acc["lines"], x["line"]).alias("lines"), below.alias("below"))).otherwise(acc)
    return F.reverse(F.aggregate(F.reverse(items), start, keep)["lines"])


def flat_steps(rows: DataFrame, column: str, into: str = "steps", most_depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(rows with ``into`` in place of the variant ``column``, problems): the flat step texts of instructions. A
    section gives "Name:" and its steps, one without steps nothing; null gives an empty list.

    Rows whose items are not all texts yet form the frontier: each round opens a few levels inside
    the row and takes the finished rows out, until no row is left. There is no shuffle, and the plan of a
    round does not grow with the depth. What lies deeper than ``most_depth`` lists and sections (one with its own list) is
    left out and its row is also in the problems, with a column ``problem``."""
    others = [c for c in rows.columns if c != column]
    first = F.array(F.struct(F.col(column).alias("v"), F.lit(None).cast("string").alias("line"), F.lit(0).alias("level"))).cast(_ITEM)
    frontier, done, opened = rows.select(*others, first.alias("_items")), [], 0
    step = [F.col("_items")]
    for _ in range(AT_ONCE):
        step.append(_opened(step[-1]))
    is_open = F.exists("_items", lambda x: x["v"].isNotNull()).alias("_open")
    while opened <= most_depth:
        n = min(AT_ONCE, most_depth + 1 - opened)
        after = cut_lineage(frontier.select(*others, step[n].alias("_items")).select("*", is_open))
        opened += n
        done.append(after.filter("NOT _open"))
        frontier = after.filter("_open").drop("_open")
        if frontier.isEmpty():
            break
    left = frontier.select(*others, F.lit(f"lists or sections inside each other beyond {most_depth}").alias("problem"))
    every = done[0]
    for d in [*done[1:], frontier.withColumn("_open", F.lit(True))]:
        every = every.unionByName(d)
    # the cleaned items are a column of their own: inside the fold the expression would run per line
    return every.select(*others, _cleaned(F.col("_items")).alias("_items")).select(*others, _in_order(F.col("_items")).alias(into)), left


def recipe_objects(json: DataFrame, key: str, column: str, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """((key, ord, v), problems): the Recipe objects of JSON texts, found in lists, @graph and main entities.

    The frontier is the values that are no recipes and may hold some; each round opens them one level, with the
    path as order key, until none is left. Problems are (key, ord, problem): texts that are no JSON, and values
    deeper than ``most_depth``."""
    v = F.col("v")
    is_recipe = F.coalesce(F.array_contains(kinds(v), "Recipe"), F.lit(False))
    main = F.array_compact(F.array(get(v, "$.mainEntity", "variant"), get(v, "$.mainEntityOfPage", "variant")))
    graph = get(v, "$['@graph']", "variant")
    members = F.coalesce(as_list(v), F.concat(F.coalesce(as_list(graph), F.array_compact(F.array(graph))), main))
    parsed = cut_lineage(json.select(key, F.array().cast("array<int>").alias("ord"), F.try_parse_json(column).alias("v"), F.col(column).isNull().alias("_none")))
    bad = parsed.filter("v IS NULL AND NOT _none").select(key, "ord", F.lit("not readable as JSON").alias("problem"))
    frontier, found = parsed.filter("v IS NOT NULL").drop("_none").withColumn("hit", is_recipe), []
    for _ in range(most_depth + 1):
        found.append(frontier.filter("hit").drop("hit"))
        frontier = cut_lineage(frontier.filter("NOT hit").select(key, "ord", F.posexplode(members).alias("p", "v"))
                               .select(key, F.array_append("ord", F.col("p")).alias("ord"), "v").withColumn("hit", is_recipe))
        if frontier.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every, bad.unionByName(frontier.select(key, "ord", F.lit(f"lists or graphs inside each other beyond {most_depth}").alias("problem")))


def structured(pages: DataFrame, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(records, problems): the first recipe of the structured data per page (page_id, title, ingredients, steps, servings,
    prep_time, cook_time, total_time), and (page_id, problem) of what could not be read."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LD_BLOCK), F.lit(1))).alias("b", "body"))
    found, bad = recipe_objects(blocks.select(F.struct("page_id", "b").alias("k"), "body"), "k", "body", most_depth)
    first = found.select("k.page_id", F.struct("k.b", "ord").alias("at"), "v").groupBy("page_id").agg(F.min_by("v", "at").alias("v"))
    v = F.col("v")
    items = F.coalesce(get(v, "$.recipeIngredient", "array<string>"), get(v, "$.ingredients", "array<string>"), F.array_compact(F.array(get(v, "$.recipeIngredient", "string"))))
    r = first.select(
        "page_id", F.coalesce(text_at(v, "$.name"), F.lit("Untitled Recipe")).alias("title"), F.array_compact(F.transform(items, clean_text)).alias("ingredients"),
        get(v, "$.recipeInstructions", "variant").alias("_steps"), text_at(v, "$.recipeYield").alias("servings"),
        text_at(v, "$.prepTime").alias("prep_time"), text_at(v, "$.cookTime").alias("cook_time"), text_at(v, "$.totalTime").alias("total_time"))
    records_, deep = flat_steps(r, "_steps", "steps", most_depth)
    return (records_.select("page_id", "title", "ingredients", "steps", "servings", "prep_time", "cook_time", "total_time"),
            bad.select("k.page_id", "problem").unionByName(deep.select("page_id", "problem")))


def from_structured(pages: DataFrame) -> DataFrame:
    return structured(pages)[0]


def from_headings(pages: DataFrame) -> DataFrame:
    """Lists and paragraphs under headings that name ingredients or steps. Works on the
    page's elements in order, inside the row of the page."""
    block = r"(?is)<(h[1-6]|li|p)\b[^>]*>(.*?)(?=</\1\s*>|<(?:h[1-6]|li|p|ul|ol)\b|$)"
    html = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|nav|footer)\b[^>]*>.*?</\1\s*>", "")
    d = pages.select("page_id", "html", F.regexp_extract_all(html, F.lit(block), F.lit(1)).alias("tags"), F.regexp_extract_all(html, F.lit(block), F.lit(2)).alias("bodies"))
    d = d.select("page_id", "html", F.posexplode(F.zip_with("tags", "bodies", lambda t, b: F.struct(F.lower(t).alias("tag"), F.coalesce(clean_text(b), F.lit("")).alias("text")))).alias("i", "e"))
    is_head = F.col("e.tag").startswith("h")
    names = lambda p: F.col("e.text").rlike(p) & ~F.col("e.text").rlike(P.HTML_TIME) & (F.length("e.text") <= 60)
    kind = F.when(is_head, F.when(names(P.HTML_INGREDIENTS), "ingredients").when(names(P.HTML_STEPS), "steps").otherwise("-"))
    w = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)   # the elements of one page
    d = d.withColumn("section", F.last(kind, ignorenulls=True).over(w)).withColumn("h1", F.when(F.col("e.tag") == "h1", F.col("e.text")))
    rows = lambda s: F.array_compact(F.transform(F.array_sort(F.collect_list(F.when((F.col("section") == s) & ~is_head & (F.col("e.text") != ""), F.struct("i", F.col("e.text").alias("t"))))), lambda x: x["t"]))
    g = d.groupBy("page_id").agg(F.first("h1", ignorenulls=True).alias("h1"), rows("ingredients").alias("ingredients"), rows("steps").alias("steps"))
    return g.filter((F.size("ingredients") > 0) | (F.size("steps") > 0)).select("page_id", F.coalesce("h1", F.lit("Untitled Recipe")).alias("title"), "ingredients", "steps")


def records(pages: DataFrame) -> DataFrame:
    """(page_id, method, title, ingredients, steps): the first tier with a result."""
    cols = ["page_id", "title", "ingredients", "steps"]
    tiers = (from_structured(pages).select(*cols).withColumn("tier", F.lit(0))
             .unionByName(from_headings(pages).select(*cols).withColumn("tier", F.lit(1))))
    best = tiers.groupBy("page_id").agg(F.min_by(F.struct("tier", "title", "ingredients", "steps"), "tier").alias("r"))
    return best.select("page_id", F.when(F.col("r.tier") == 0, "structured").otherwise("headings").alias("method"), "r.title", "r.ingredients", "r.steps")
