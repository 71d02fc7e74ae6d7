"""Credentials in texts, and the parts of credentials that only count together.

A pass over the texts finds spans of certain forms (assignments of secrets, access keys,
long hex strings) and weak ones: user names, endpoints, mixed strings. A weak span is
reported where its complements are near: within ``REACH`` characters and in the same
paragraph. That interval join is two running windows over the few texts that have weak
spans, so it lists no pairs.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.scratch import settled, text_of

#: Kinds in their order, and what part of a credential each one is.
BASE = {"assign": "secret", "access": "identifier", "hex": "secret"}
WEAK = {"user": "identifier", "mixed": "secret", "endpoint": "endpoint"}
KINDS = [*BASE, *WEAK]
ROLES = BASE | WEAK
#: A weak span needs these parts near it.
NEEDS = {"user": ["secret"], "mixed": ["identifier"], "endpoint": ["identifier", "secret"]}
#: Characters between a span and its complement.
REACH = 300
#: Bits per character of a mixed string.
ENTROPY = 3.5

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_USER = re.compile(rb"""(?<![a-z0-9])(?:user(?:name)?|login|client_?id|account|key_?id)["']?\x20*[:=]\x20*["']?([a-z0-9._@-]{3,})""")
_MIXED = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(rb"[a-z][a-z0-9+.-]*://[^\s\"'<>|\\^`{}]+")
_PARAGRAPH = re.compile(rb"\n[\x20\t\r]*\n")


def entropy(data: bytes) -> float:
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())


def _is_mixed(data: bytes) -> bool:
    return (any(48 <= c < 58 for c in data) and any(65 <= c < 91 for c in data) and any(97 <= c < 123 for c in data)
            and entropy(data) >= ENTROPY)


def found_spans(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, paragraph) of the spans of a whole text, in code points. The letters
    of an assignment are matched in either case (ASCII); a match whose value is short
    is passed over, as are weak spans that meet a certain one."""
    data = (text or "").encode()
    lower = data.lower()        # ASCII letters only, so places stay
    sure = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(lower) if len(m[2]) >= 12]
    if b"AKIA" in data:
        sure += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 18]
    sure += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    weak = [(m.start(1), 3, m.end(1)) for m in _USER.finditer(lower)]
    weak += [(m.start(), 4, m.end()) for m in _MIXED.finditer(data) if _is_mixed(m[0])]
    if b"://" in data:
        weak += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(lower)]
    if weak:
        covered = sorted((a, z) for a, _, z in sure)
        weak = _apart(sorted(weak), covered)
    spans = sorted(sure + weak)
    if not spans:
        return []
    breaks = [m.start() for m in _PARAGRAPH.finditer(data)] if weak else []
    places = sorted({p for a, _, z in spans for p in (a, z)})
    if data.isascii():
        point = dict(zip(places, places, strict=True))
    else:                       # spans start and end at ASCII characters or beside them
        point, at, n = {}, 0, 0
        for p in places:
            n += len(data[at:p].decode(errors="replace"))
            point[p], at = n, p
    out, k = [], 0
    for a, kind, z in spans:
        while k < len(breaks) and breaks[k] < a:
            k += 1
        out.append((point[a], kind, point[z], k))
    return out


def _apart(weak: list[tuple[int, int, int]], covered: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Weak spans that meet no certain one; both in order of their starts."""
    out, k, reach = [], 0, -1
    for a, kind, z in weak:
        while k < len(covered) and covered[k][0] < z:
            reach = max(reach, covered[k][1])
            k += 1
        if reach <= a:
            out.append((a, kind, z))
    return out


_SPANS = "array<struct<start:bigint,kind:int,end:bigint,scope:int>>"


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, found): the spans of every text, certain and weak."""
    kind = docs.schema[id_col].dataType.simpleString()
    made = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "kind", "end", "scope")
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in found_spans(t.as_py())] for t in batch.column("text")]
            yield pa.record_batch([batch.column("id"), pa.array(found, made)], names=["id", "found"])
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, found {_SPANS}")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, extra): the weak spans of each row that have their complements near."""
    role = F.element_at(F.lit([ROLES[k] for k in KINDS]), F.col("s.kind") + 1)
    spans = (found.filter(F.exists("found", lambda s: s["kind"] >= len(BASE)) & (F.size("found") > 1))
             .select("row", F.explode("found").alias("s")).select("row", "s", F.col("s.scope").alias("scope"), F.col("s.start").alias("start"), role.alias("role")))
    # running values in both directions: the furthest end of what starts before, the next start
    before, after = (Window.partitionBy("row", "scope").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))
    far = lambda r: F.max(F.when(F.col("role") == r, F.col("s.end"))).over(before)
    next_ = lambda r: F.min(F.when(F.col("role") == r, F.col("start"))).over(after)
    has = {r: (F.coalesce(far(r) >= F.col("start") - reach, F.lit(False)) | F.coalesce(next_(r) <= F.col("s.end") + reach, F.lit(False))).alias(f"has_{r}")
           for r in ("identifier", "secret", "endpoint")}
    seen = spans.select("row", "s", *has.values())
    met = F.lit(False)
    for kind, needs in NEEDS.items():
        ok = F.col("s.kind") == KINDS.index(kind)
        for r in needs:
            ok = ok & F.col(f"has_{r}")
        met = met | ok
    return seen.filter(met).groupBy("row").agg(F.collect_list("s").alias("extra"))


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.lit(KINDS)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, base, spans): arrays of (start, kind, end, scope), kind the number in KINDS.

    ``base`` has the certain spans, ``spans`` also the weak ones that are linked. Null and empty
    texts have none. Rows stay as they are, repeated and null identifiers too; other
    columns go. An empty table gives no rows.
    """
    found = settled(scanned(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.join(linked(found, reach), "row", "left").select(
        "id", base.alias("base"), F.concat(base, F.coalesce("extra", F.array().cast(_SPANS))).alias("spans"))
