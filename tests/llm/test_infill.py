import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.llm.infill import SkipList, infilled, line_widths, restored

from .common import empty, odd_texts, table

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text):
    """The stated result, from joined lists of lines."""
    text = text or ""
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.integers(0, 9), max_size=400))
@settings(max_examples=150, deadline=None)
def test_reach_equals_running_sums(widths):
    units, ends = SkipList(np.array(widths, np.int64)), [0]
    for w in widths:
        ends.append(ends[-1] + w)
    assert [units.reach(r) for r in range(len(widths) + 1)] == ends


def test_lanes_are_express():
    units = SkipList(np.full(200_000, 3))
    sizes = [len(a) for a, _, _ in units.lanes]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and 6 <= len(sizes) <= 14
    assert all(int(a.sum()) == 200_000 and int(b.sum()) == 600_000 for a, b, _ in units.lanes)
    assert units.reach(123_457) == 3 * 123_457


@given(st.text(alphabet="a\nßé中\r", max_size=60))
@settings(max_examples=150, deadline=None)
def test_lines(text):
    assert line_widths(text).tolist() == [len(u) for u in UNITS.findall(text)]


def test_documents(spark):
    texts = [*odd_texts(), "\n", "\n\n\n", "no end", "a\n<S>b\nc\n", "<", "a<\n<\nS>\n<P\n>M>\n", "x\r\ny\r\n", "ä\n" * 30_000, "z" * 400_000]
    ids = [*range(len(texts) - 3), None, -4, 0]
    made = infilled(table(spark, texts, ids)).withColumn("back", restored(F.col("output"), F.col("form")))
    found = [(r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in made.collect()]
    want = [(i, *plain(i, t), t or "") for i, t in zip(ids, texts, strict=True)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert {f[2] for f in found} == {"plain", "psm", "spm"}


def test_parameters(spark):
    texts = [f"line {k}\n" * (k % 7 + 1) for k in range(300)]
    forms = [r["form"] for r in infilled(table(spark, texts), cut_percent=40, spm_percent=0).select("form").collect()]
    assert set(forms) == {"plain", "psm"} and 90 <= forms.count("psm") <= 150


def test_empty(spark):
    assert infilled(empty(spark)).collect() == []
