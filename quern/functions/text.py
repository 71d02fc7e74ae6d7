"""Text keys and small column builders: all native expressions, no UDFs."""
from __future__ import annotations

import html.entities
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from quern.functions import words as W


def _accent_map() -> tuple[str, str]:
    """Letters of the Latin blocks -> their base letter, derived from Unicode."""
    src, dst = [], []
    for code in list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch)[0]
        if base != ch and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _accent_map()


def strip_accents(c: Column) -> Column:
    # plain ASCII, most of an English corpus, skips the letter-by-letter map
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(F.translate(c, _FROM, _TO), "\\p{M}+", "")).otherwise(c)


def fold(c: Column) -> Column:
    """Lower case, ligatures spelled out, quotes straight, accents off."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.replace(F.replace(t, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return strip_accents(F.translate(t, "’‘`", "'''"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once a row: an expression that is named several times in nested functions is
    computed as often, and one inside a lambda for each item, also when it was a column that the optimizer moved there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def title_key(c: Column) -> Column:
    """Accents, case and punctuation do not count; null when nothing is left."""
    t = F.replace(F.lower(strip_accents(c)), F.lit("ß"), F.lit("ss"))
    return F.nullif(F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", " ")), F.lit(""))


_LINK = r"(?i)^\s*(https?)://(?:[^/?#]*@)?([^/?#:@\s]+)(?::([0-9]*))?(/[^?#\s]*)?(?:\?([^#\s]*))?(?:#.*)?\s*$"


def link_key(c: Column) -> Column:
    """A web address without scheme, www., default port, trailing slash,
    fragment and tracking parameters; the rest of the query sorted."""
    part = lambda n: F.regexp_extract(c, _LINK, n)
    host = F.regexp_replace(F.lower(part(2)), "^www\\.", "")
    port = part(3).try_cast("int")
    default = F.when(F.lower(part(1)) == "http", 80).otherwise(443)
    shown_port = F.when((port > 0) & (port != default), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    path = F.regexp_replace(part(4), "/+$", "")
    dec = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(
        F.filter(F.split(part(5), "&"), lambda p: p != ""),
        lambda p: F.struct(dec(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
                           dec(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike("(?i)" + W.TRACKING_PARAM)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    bad_port = (part(3) != "") & (port.isNull() | (port > 65535))
    return F.when(c.rlike(_LINK) & ~bad_port,
                  F.concat(host, shown_port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def tokens(c: Column) -> Column:
    """Folded words of a text, in order."""
    return F.regexp_extract_all(fold(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n")


def bounded_text(c: Column) -> Column:
    """At most 400k characters, 4k lines, 2k characters a line."""
    cut = F.slice(F.split(F.substring(c, 1, W.TEXT_MAX_CHARS), "\n"), 1, W.TEXT_MAX_LINES)
    return F.array_join(F.transform(cut, lambda l: F.substring(l, 1, W.TEXT_MAX_LINE)), "\n")


def text_was_cut(c: Column) -> Column:
    return (F.length(c) > 0) & (bounded_text(c) != c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def word_count(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), "(?U)\\s+")))


def guess_language(c: Column) -> Column:
    """French when its function words outnumber the English ones."""
    t = F.coalesce(c, F.lit(""))
    fr = F.regexp_count(t, F.lit("(?iU)\\b(?:" + "|".join(W.FRENCH_WORDS) + ")\\b"))
    en = F.regexp_count(t, F.lit("(?iU)\\b(?:" + "|".join(W.ENGLISH_WORDS) + ")\\b"))
    return F.when(fr > en, "fr").otherwise("en")


def record_language(language: Column, title: Column, content: Column) -> Column:
    return F.coalesce(F.when(language.isin(W.LANGUAGES), language),
                      guess_language(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))))


def is_part_name(c: Column) -> Column:
    """A short line ending in ":" that is not an ingredient with a tail."""
    t = F.trim(F.coalesce(c, F.lit("")))
    tail_after_start = F.regexp_instr(t, F.lit(W.INGREDIENT_TAIL)) > 1
    return t.endswith(":") & (word_count(t) <= 6) & ~tail_after_start


def safe_cell(c: Column) -> Column:
    """A cell a spreadsheet would read as a formula gets a leading quote."""
    return F.when(c.rlike(W.FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def slug(c: Column) -> Column:
    ascii_only = F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), "[^\\x00-\\x7f]", "")
    s = F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 40), F.lit("")), F.lit("recipe"))


def file_stem(title: Column, rid: Column) -> Column:
    s = F.regexp_replace(F.coalesce(title, F.lit("")), "(?U)[^\\w\\- ]+", "")
    s = F.substring(F.replace(F.trim(s), F.lit(" "), F.lit("-")), 1, 60)
    return F.concat(rid.cast("string"), F.lit("-"), F.coalesce(F.nullif(s, F.lit("")), F.lit("recipe")))


_ADDRESS = r"(?i)(https?)://(?:[^\s/?#'\"<>)]*@)?([^\s/?#:'\"<>)@]+)(:[0-9]+)?(/[^\s?#'\"<>)]*)?(?:[?#][^\s'\"<>)]*)"
_ADDRESS_PLAIN = r"(?i)(https?)://(?:[^\s/?#'\"<>)]*@)([^\s/?#:'\"<>)@]+)"


def redact_links(c: Column) -> Column:
    """Every address without credentials, query and fragment."""
    t = F.regexp_replace(c, _ADDRESS, "$1://$2$3$4?…")
    t = F.regexp_replace(t, _ADDRESS_PLAIN, "$1://$2")
    return F.regexp_replace(t, r"(with url: )([^\s?#]*)[?#]\S*", "$1$2?…")


def strip_footer(c: Column) -> Column:
    """Signature after "-- " and mail-client footers removed."""
    body = F.element_at(F.split(c, "(?m)^-- ?$", 2), 1)
    return F.regexp_replace(body, W.CLIENT_FOOTER, "")


def links_in(c: Column) -> Column:
    """Distinct addresses of a text in order, trailing punctuation off."""
    found = F.regexp_extract_all(c, F.lit(W.URL_IN_TEXT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,;:!?"))))


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance where a swap of neighbours costs one (optimal string
    alignment), as a fold over the letters of ``a`` that keeps two rows."""
    n = F.length(b)
    first = F.sequence(F.lit(0), n)
    letters_a = F.filter(F.split(a, ""), lambda x: x != "")
    letters_b = F.filter(F.split(b, ""), lambda x: x != "")
    zero = F.struct(F.lit("").alias("ch"), F.lit(0).alias("i"), first.alias("prev2"), first.alias("prev"))

    def step(acc, ch):
        i = acc["i"] + 1
        empty = F.slice(F.array(i), 1, 1)

        def cell(row, j):
            up = F.element_at(acc["prev"], j + 1) + 1
            left = F.element_at(row, j) + 1
            same = F.element_at(letters_b, j) == ch
            diag = F.element_at(acc["prev"], j) + F.when(same, 0).otherwise(1)
            swap = F.when((j > 1) & (i > 1) & (F.try_element_at(letters_b, j - 1) == ch)
                          & (F.element_at(letters_b, j) == acc["ch"]),
                          F.try_element_at(acc["prev2"], j - 1) + 1)
            return F.concat(row, F.array(F.least(up, left, diag, swap)))

        row = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), empty, cell)
        return F.struct(ch.alias("ch"), i.alias("i"), acc["prev"].alias("prev2"), row.alias("prev"))

    return F.aggregate(letters_a, zero, step, lambda acc: F.element_at(acc["prev"], -1))


def stem(c: Column) -> Column:
    """Plural or final-vowel ending off, never shorter than four letters."""
    out = None
    for ending in ("ies", "es", "s", "y", "e", "x"):
        hit = c.endswith(ending) & (F.length(c) - len(ending) >= 4)
        cut = F.substring(c, F.lit(1), F.length(c) - len(ending))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(c)


def allowed_edits(c: Column) -> Column:
    return F.when(F.length(c) < 4, 0).when(F.length(c) < 8, 1).otherwise(2)


#: Names of HTML's characters, from the language's own table; a no-break space is a blank here.
_NAMED = {n: chr(p) for n, p in html.entities.name2codepoint.items()} | {"apos": "'", "nbsp": " "}
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _character(entity: Column) -> Column:
    """The character of one entity; unknown ones stay as they are."""
    body = F.substring(entity, F.lit(2), F.length(entity) - 2)
    is_hex = F.lower(F.substring(body, 2, 1)) == "x"
    digits = F.when(is_hex, F.substring(body, F.lit(3), F.length(body))).otherwise(F.substring(body, F.lit(2), F.length(body)))
    point = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
    valid = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    named = F.try_element_at(F.map_from_arrays(F.lit(list(_NAMED)), F.lit(list(_NAMED.values()))), body)
    return F.coalesce(F.when(body.startswith("#"), numbered).otherwise(named), entity)


def unescape(c: Column) -> Column:
    """Named and numeric entities decoded once: what becomes "&" comes last, so it
    begins no new entity. The text is bound by a list of one, so what makes it runs once, and one without "&" stays as it is."""
    def decoded(t):
        found = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0))), lambda e: F.struct(e.alias("e"), _character(e).alias("c")))
        ordered = F.concat(F.filter(found, lambda x: x["c"] != "&"), F.filter(found, lambda x: x["c"] == "&"))
        return F.aggregate(ordered, t, lambda done, x: F.replace(done, x["e"], x["c"]))
    return F.get(F.transform(F.array(c), lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t)), F.lit(0))


def html_to_text(c: Column) -> Column:
    """Script, style and head dropped, block ends to new lines, link targets
    that the visible text hides kept, tags off, entities decoded."""
    t = F.regexp_replace(c, "(?is)<!--.*?-->|<!DOCTYPE[^>]*>", "")
    t = F.regexp_replace(t, "(?is)<(script|style|head)\\b[^>]*>.*?</\\1\\s*>", "")
    for target in (r'"(https?://[^"]*)"', r"'(https?://[^']*)'", r"(https?://[^\s\"'>]+)"):
        t = F.regexp_replace(t, rf"(?is)<a\b[^>]*?href\s*=\s*{target}[^>]*>((?:(?!\1).)*?)</a>", "$2 $1")
    t = F.regexp_replace(t, "(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-4])\\s*>", "\n")
    t = unescape(F.regexp_replace(t, "(?s)<[^>]+>", ""))
    t = F.array_join(F.transform(F.split(t, "\r?\n"), lambda l: F.trim(l)), "\n")
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def markdown_to_text(c: Column) -> Column:
    """Marks off, words kept; fences and rules dropped."""
    rows = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")
    kept = F.filter(rows, lambda l: ~l.rlike(r"^\s{0,3}(```|~~~)") & ~l.rlike(r"^\s{0,3}([-*_])(\s*\1){2,}\s*$"))

    def clean(l):
        t = F.regexp_replace(l, r"^\s{0,3}>\s?", "")
        t = F.regexp_replace(t, r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", "$1")
        t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", "")
        t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
        t = F.regexp_replace(t, r"(\*\*|__)(.+?)\1|(?U)(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?!\w)", "$2$3")
        return F.trim(t)

    return F.trim(F.array_join(F.transform(kept, clean), "\n"), F.lit(" \n\t"))
