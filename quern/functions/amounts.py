"""Quantities, durations and unit conversion as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import words as W
from quern.functions.text import is_part_name

_SEP = "\u0001"

# quantity, bracket, unit, name of an ingredient line
_LINE = (r"(?iU)^\s*(" + W.QUANTITY + r")?\s*(?:\(([^)]*)\)\s*)?(" + W.UNIT_PATTERN + r")?\.?\s+(.+?)\s*$")


def groups(c: Column, pattern: str, n: int) -> Column:
    """The first n groups of an anchored pattern (and the rest of the text after
    it) as an array from one pass; null without a match."""
    marks = _SEP.join(f"${i}" for i in range(1, n + 1)) + _SEP
    got = F.split(F.regexp_replace(c, pattern, marks), _SEP)
    return F.when(c.contains(_SEP), F.lit(None)).when(c.rlike(pattern), got)


def canonical_unit(u: Column) -> Column:
    u = F.lower(F.trim(u))
    out = None
    for unit, pattern in W.CANONICAL_UNITS.items():
        hit = u.rlike("(?iU)^(?:" + pattern + ")$")
        out = F.when(hit, unit) if out is None else out.when(hit, unit)
    return out.otherwise(u)


def with_parsed(df: DataFrame, raw: str) -> DataFrame:
    """Adds quantity, unit and name of an ingredient line, in stages so that
    each regular expression runs once per row."""
    line = F.trim(F.ltrim(F.trim(F.col(raw) if isinstance(raw, str) else raw), F.lit("-*•")))
    d = df.withColumn("_line", line)
    d = d.withColumn("_g", F.when(F.col("_line") != "", groups(F.col("_line"), _LINE, 4)))
    g = lambda i: F.trim(F.get("_g", F.lit(i)))
    paren = F.get("_g", F.lit(1))
    d = d.withColumns({"_qty": F.nullif(g(0), F.lit("")), "_unit": F.nullif(g(2), F.lit("")), "_name": F.when(
        paren != "", F.concat(g(3), F.lit(" ("), F.trim(paren), F.lit(")"))).otherwise(g(3))})
    moved = F.regexp_replace("_name", r"^\(\s*([^)]*?)\s*\)\s*(.+)$", "$2 ($1)")
    d = d.withColumn("_moved", F.when(F.col("_unit").isNotNull(), moved))
    bare = F.nullif(F.regexp_replace("_moved", r"(?iU)^(?:de\s+|d['’]\s*)", ""), F.lit(""))
    return d.withColumns({
        "quantity": F.col("_qty"), "unit": canonical_unit(F.col("_unit")),
        "name": F.coalesce(bare, "_moved", "_name", "_line")}).drop("_line", "_g", "_qty", "_unit", "_name", "_moved")


_LEADING = (r"(?i)^(\s*)(" + W.AMOUNT + r")(?:(\s*(?:-|–|—|to|à|a|or|ou)\s*)(" + W.AMOUNT + r"))?"
            r"(?=[\s(]|[^\d\s/.,]|$)")
_SLASH = r"^(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)$"
_UNI = r"^(\d*)\s*([" + W.FRACTION_CHARS + r"])$"


def amount_value(c: Column) -> Column:
    """The number an amount means: "1 1/2", "1½", "3/4", "1,5", "2"."""
    num = lambda s: s.try_cast("double")
    x = lambda p, n: num(F.regexp_extract(c, p, n))
    values = F.create_map(*[F.lit(v) for kv in W.FRACTION_VALUES.items() for v in kv])
    ratio = F.try_divide(x(_SLASH, 2), x(_SLASH, 3))
    whole = x(_SLASH, 1)
    return (F.when(c.contains("/"), F.when(whole.isNull(), ratio).otherwise(whole + F.coalesce(ratio, F.lit(0.0))))
            .when(c.rlike(_UNI), F.coalesce(x(_UNI, 1), F.lit(0.0)) + F.try_element_at(values, F.regexp_extract(c, _UNI, 2)))
            .otherwise(num(F.replace(c, F.lit(","), F.lit(".")))))


def with_leading(df: DataFrame, line: str) -> DataFrame:
    """Adds what a line starts with: _lead, _low_text, _sep, _high_text, _rest
    (null without an amount), _low and _high as numbers, and _unsure: a thousands
    sign or a second amount, so that nothing is converted."""
    d = df.withColumn("_g", F.when(~is_part_name(F.col(line)), groups(F.col(line), _LEADING, 4)))
    g = lambda i: F.get("_g", F.lit(i))
    d = d.withColumns({"_lead": g(0), "_low_text": F.trim(g(1)), "_sep": g(2), "_high_text": F.nullif(F.trim(g(3)), F.lit("")), "_rest": g(4)})
    odd = F.col("_low_text").rlike(W.AMBIGUOUS_THOUSANDS) | F.coalesce(F.col("_high_text").rlike(W.AMBIGUOUS_THOUSANDS), F.lit(False))
    return d.withColumns({"_low": amount_value(F.col("_low_text")), "_high": amount_value(F.col("_high_text")), "_odd": odd,
                          "_second": F.col("_rest").rlike(W.SECOND_AMOUNT),
                          "_times": F.lower(F.regexp_extract("_rest", r"(?i)^\s*([a-zA-ZÀ-ÿ×]+)", 1)).isin("x", "×")}).drop("_g")


LEADING_COLUMNS = ["_lead", "_low_text", "_sep", "_high_text", "_rest", "_low", "_high", "_odd", "_second", "_times"]


_NICE = [(1 / 8, "1/8", "⅛"), (1 / 6, "1/6", "⅙"), (1 / 4, "1/4", "¼"), (1 / 3, "1/3", "⅓"), (3 / 8, "3/8", "⅜"),
         (1 / 2, "1/2", "½"), (5 / 8, "5/8", "⅝"), (2 / 3, "2/3", "⅔"), (3 / 4, "3/4", "¾"), (5 / 6, "5/6", "⅚"),
         (7 / 8, "7/8", "⅞")]


def _plain(v: Column) -> Column:
    r = F.round(v, 2)
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string"))


def show_amount(v: Column, original: Column) -> Column:
    """A scaled amount written the way the original was."""
    src = F.trim(original)
    whole = F.floor(v + 1e-9)
    rest = v - whole
    nice = F.array(*[F.struct(F.abs(rest - n).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(u).alias("u"))
                     for i, (n, a, u) in enumerate(_NICE)])
    near = F.array_min(nice)
    uni = src.rlike("[" + W.FRACTION_CHARS + "]")
    frac = F.when(uni, near["u"]).otherwise(near["a"])
    fraction = (F.when(whole == 0, frac).when(uni, F.concat(whole.cast("string"), frac))
                .otherwise(F.concat(whole.cast("string"), F.lit(" "), frac)))
    return (F.when(src.rlike(r"^\d+,\d+$"), F.replace(_plain(v), F.lit("."), F.lit(",")))
            .when(src.rlike(r"^\d+\.\d+$"), _plain(v))
            .when(src.rlike(r"^\d+$") & (src.try_cast("double") >= 10), F.round(v).cast("bigint").cast("string"))
            .when(rest < 0.04, whole.cast("string")).when(rest > 0.96, (whole + 1).cast("string"))
            .when(near["d"] >= 0.03, _plain(v)).otherwise(fraction))


def _unit_columns(df: DataFrame, table: list) -> DataFrame:
    """Adds _factor and _after for the first unit that starts _rest."""
    d = df.withColumn("_spaced", F.ltrim("_rest"))
    factor = F.lit(None).cast("double")
    for pattern, value in reversed(table):
        factor = F.when(F.col("_spaced").rlike("^" + pattern), float(value)).otherwise(factor)
    d = d.withColumn("_factor", factor)
    any_unit = "^(?:" + "|".join(p for p, _v in table) + ")"
    return d.withColumn("_after", F.when(F.col("_factor").isNotNull(), F.regexp_replace("_spaced", any_unit, ""))).drop("_spaced")


def with_volume_unit(df: DataFrame) -> DataFrame:
    table = [("(?i:" + p + ")", f) for p, f in W.VOLUME_UNITS]
    return _unit_columns(df, table[:4] + W.VOLUME_LETTERS + table[4:])


def with_weight_unit(df: DataFrame) -> DataFrame:
    return _unit_columns(df, [("(?i:" + p + ")", f) for p, f in W.WEIGHT_UNITS])


def name_part(rest: Column) -> Column:
    """The ingredient's name: up to the first comma, bracket, slash or "or"."""
    t = F.regexp_replace(rest, r"(?i)^\s*\([^)]*\)\s*(?:of\s+|de\s+|d['’]\s*)?", " ")
    t = F.regexp_replace(t, r"(?i)\bhalf[\s-]*(?:and|&)[\s-]*half\b", "half-and-half")
    return F.element_at(F.split(t, W.NAME_END, 2), 1)


def round_grams(g: Column) -> Column:
    """Display rounding: tenths under 1, halves under 10, then 1s, then 5s."""
    half_up = lambda v: F.floor(v + 0.5)
    return (F.when(g <= 0, 0.0).when(g < 1, F.greatest(F.lit(0.1), half_up(g * 10) / 10))
            .when(g < 10, half_up(g * 2) / 2).when(g < 100, half_up(g).cast("double"))
            .otherwise((half_up(g / 5) * 5).cast("double")))


_FRACTIONS = {"cup": [0, 1 / 4, 1 / 3, 1 / 2, 2 / 3, 3 / 4, 1], "tbsp": [0, 1 / 2, 1], "tsp": [0, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1]}
_CUPS = {"en": {"cup": 1.0, "tbsp": 1 / 16, "tsp": 1 / 48},
         "fr": {"cup": 250 / W.US_CUP_ML, "tbsp": 15 / W.US_CUP_ML, "tsp": 5 / W.US_CUP_ML}}


def kitchen_unit(cups: Column, lang: str = "en") -> Column:
    size = _CUPS[lang]
    return (F.when(cups / size["cup"] >= 0.25 - 1e-9, "cup")
            .when(cups / size["tbsp"] >= 1 - 1e-9, "tbsp").otherwise("tsp"))


def kitchen_amount(cups: Column, unit: Column, lang: str = "en") -> Column:
    """Nearest whole-and-fraction of the unit, never zero."""
    size = F.when(unit == "cup", _CUPS[lang]["cup"]).when(unit == "tbsp", _CUPS[lang]["tbsp"]).otherwise(_CUPS[lang]["tsp"])
    as_array = lambda n: F.array(*[F.lit(float(f)) for f in _FRACTIONS[n]])
    steps = F.when(unit == "cup", as_array("cup")).when(unit == "tbsp", as_array("tbsp")).otherwise(as_array("tsp"))
    v = cups / size
    part = v - F.floor(v)
    near = F.array_min(F.transform(steps, lambda f: F.struct(F.abs(part - f).alias("d"), f.alias("f"))))["f"]
    return F.greatest(F.floor(v) + near, F.element_at(steps, 2))


# --- durations -----------------------------------------------------------------

_ISO = r"(?i)^P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$"
_PART = r"(?i)(\d+(?:[.,]\d+)?)\s*(days?|d|jours?|j|hours?|heures?|hrs?|h|minutes?|mins?|m)\b"


def bound(c: Column, use) -> Column:
    """``use`` of a value that is named more than once there and computed once: an item of a list of one."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def text_minutes(c: Column) -> Column:
    """Minutes of "1 hr 20 min", "45", "1 h 30"; null when unreadable."""
    t = F.trim(c)
    nums = F.regexp_extract_all(t, F.lit(_PART), F.lit(1))
    units = F.regexp_extract_all(t, F.lit(_PART), F.lit(2))
    total = F.aggregate(
        F.zip_with(nums, units, lambda n, u: F.replace(n, F.lit(","), F.lit(".")).try_cast("double")
                   * F.when(F.lower(u).rlike("^[dj]"), 1440.0).when(F.lower(u).startswith("h"), 60.0).otherwise(1.0)),
        F.lit(0.0), lambda a, x: a + x)
    short = r"(?i)^(\d+)\s*h\s*(\d+)$"
    exact = (F.regexp_extract(t, short, 1).try_cast("double") * 60 + F.regexp_extract(t, short, 2).try_cast("double"))
    positive = lambda x: F.when(x > 0, x)
    return F.when(t.rlike(r"^\d+$"), t.try_cast("double")).when(t.rlike(short), bound(exact, positive)).otherwise(bound(total, positive))


def iso_duration(c: Column) -> Column:
    t = F.trim(c)
    part = lambda n, letter: F.when(n > 0, F.concat(n.cast("string"), F.lit(letter))).otherwise("")
    iso = lambda n: F.when(n.isNotNull(), F.concat(F.lit("PT"), part(F.floor(n / 60), "H"), part(n % 60, "M")))
    return (F.when(t.rlike(_ISO) & ~F.upper(t).isin("P", "PT"), F.upper(t))
            .when(t.rlike(r"^\d+$"), F.concat(F.lit("PT"), t.try_cast("bigint").cast("string"), F.lit("M")))
            .otherwise(bound(F.rint(text_minutes(t)).cast("bigint"), iso)))


_DDHHMM = r"^\s*(?:(\d+):)?(\d+):(\d+)\s*$"


def ddhhmm_minutes(c: Column) -> Column:
    x = lambda n: F.coalesce(F.regexp_extract(c, _DDHHMM, n).try_cast("bigint"), F.lit(0))
    total = x(1) * 1440 + x(2) * 60 + x(3)
    return F.when(c.rlike(_DDHHMM) & (x(3) < 60) & (x(2) < 24) & (total <= W.MAX_COOK_MINUTES), total)


def minutes_ddhhmm(m: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(m / 1440), F.floor(m % 1440 / 60), m % 60)


def minutes_label(m: Column) -> Column:
    d, h, mm = F.floor(m / 1440), F.floor(m % 1440 / 60), m % 60
    s = lambda v, u: F.concat(v.cast("string"), F.lit(u))
    return (F.when((m >= 1440) & (h > 0), F.concat(s(d, "d "), s(h, "h"))).when(m >= 1440, s(d, "d"))
            .when((h > 0) & (mm > 0), F.concat(s(h, "h "), s(mm, "m"))).when(h > 0, s(h, "h")).otherwise(s(mm, "m")))


def cook_time_label(m: Column, lang: str = "en") -> Column:
    d, h, mm = F.floor(m / 1440), F.floor(m % 1440 / 60), m % 60
    part = lambda v, u: F.when(v > 0, F.concat(v.cast("string"), F.lit(" " + u)))
    return F.when(m > 0, F.concat_ws(" ", part(d, "j" if lang == "fr" else "d"), part(h, "h"), part(mm, "min")))
