"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text, one on what sets toxic text
apart; a window of text is compressed with the first alone and with both. Where the
toxic dictionary helps, the window gets shorter. The savings of a document's windows,
counted against thresholds calibrated on ordinary text, give its score.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from quern.llm.scratch import settled, text_of

#: Bytes of a window and from one window to the next; what is shorter than their
#: difference is whole in some window.
WINDOW, STEP = 48, 32
#: Bound of the labelled sample that dictionaries and thresholds are fitted on.
SAMPLE_PER_CLASS = 3_000
#: Bytes of the sample of each label; its texts are whole ones.
SAMPLE_BYTES = 16_000_000
ORDINARY_BYTES = 100_000
TOXIC_BYTES = 16_384
LEVEL = 6
#: A word or pair of words sets toxic text apart if so many toxic sample texts that are no
#: copies of each other have it, if it is this many times likelier there, and if that is
#: no chance: of all that are in so many toxic texts, this many may be expected by chance.
LEAST_TEXTS, LEAST_RATIO, BY_CHANCE = 3, 8.0, 0.1
#: Texts are calibrated on savings by dictionaries that were made without them.
FOLDS = 4
#: zstandard finds no match below this length at LEVEL.
GRAM = 4
#: zstandard seeks no match in the last bytes of its input.
TAIL = b" " * 8

_SEPARATORS = re.compile(rb"[^a-z0-9\x80-\xff]+")


def plain(text: str | None) -> bytes:
    return b" " + _SEPARATORS.sub(b" ", (text or "").lower().encode()).strip() + b" "


def windows(data: bytes) -> list[bytes]:
    return [data[i:i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def _grams(data: np.ndarray) -> np.ndarray:
    """A 16-bit hash of the GRAM bytes at each place."""
    a = data.astype(np.uint32)
    key = a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24
    return (key * np.uint32(2654435761)) >> np.uint32(16)


class Compressor:
    def __init__(self, dictionary: bytes):
        size = WINDOW + len(TAIL)
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(dictionary), source_size=size, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_checksum=False, write_content_size=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        self._it = zstandard.ZstdCompressor(compression_params=how, dict_data=held)

    def length(self, window: bytes) -> int:
        return len(self._it.compress(window + TAIL))


def trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where all of them fit in it:
    training chooses what to leave out."""
    whole = b"".join(samples)
    return whole if len(whole) <= size else zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()


def _units(words: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """The words and pairs of words of a text, each with its first place and the one behind it."""
    for i, w in enumerate(words, 1):
        yield w, i - 1, i
        if i < len(words):
            yield w + b" " + words[i], i - 1, i + 1


def _sides(words: list[bytes], a: int, z: int) -> list[tuple]:
    """The two words before and the two behind; an edit in a near copy leaves one side as it is."""
    left, right = tuple(words[max(0, a - 2):a]), tuple(words[z:z + 2])
    return [side for side in ((0, left), (1, right)) if side[1]] or [(2,)]


def telling_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words typical of toxic text, and pairs of words of which none is typical itself. A text counts for a
    word unless it stands beside the same two words in an earlier text, in half of its places; so copies
    and near copies of one text don't make its words typical. The most frequent ones are last."""
    n_t, n_o = max(1, len(toxic)), len(ordinary)
    t = Counter(u for x in toxic for u in {u for u, _, _ in _units(x.split())})
    candidates = sum(n >= LEAST_TEXTS for n in t.values())
    share, surprise = n_t / (n_t + n_o), math.log(max(1, candidates) / BY_CHANCE)

    def telling(n: int, others: int) -> bool:
        if n < LEAST_TEXTS or n / n_t < LEAST_RATIO * (others + 1) / (n_o + 1):
            return False
        # Chernoff's bound of n or more among n + others
        rest = others * math.log(others / (n + others) / (1 - share)) if others else 0.0
        return n * math.log(n / (n + others) / share) + rest >= surprise
    t = {u: n for u, n in t.items() if telling(n, 0)}
    o = Counter(u for x in ordinary for u in {u for u, _, _ in _units(x.split())} if u in t)
    likely = {u for u, n in t.items() if telling(n, o[u])}
    seen, apart = set(), Counter()
    for x in toxic:
        here, words = {}, x.split()
        for u, a, z in _units(words):
            if u in likely:
                here.setdefault(u, []).append([(u, side) for side in _sides(words, a, z)])
        for u, places in here.items():
            apart[u] += 2 * sum(any(side in seen for side in p) for p in places) < len(places)
            seen.update(side for p in places for side in p)
    found = {u for u in likely if telling(apart[u], o[u])}
    found = [u for u in found if b" " not in u or not found.intersection(u.split())]
    return sorted(found, key=lambda u: (apart[u], u))


def toxic_dictionary(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """What sets toxic text apart; trained on how it stands in windows where not all of it fits."""
    found = telling_words(toxic, ordinary)
    whole = b"".join(b" " + u + b" " for u in found)
    if len(whole) <= TOXIC_BYTES:
        return whole
    wanted = set(found)
    cut = ([u for u, _, _ in _units(w.split()) if u in wanted] for x in toxic for w in windows(x))
    return trained([b" " + b"  ".join(units) + b" " for units in cut if units], TOXIC_BYTES)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: savings in bytes that few windows of ordinary text reach
    thresholds: tuple[float, ...]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes, thresholds: tuple[float, ...] = (4, 6, 8)):
        self._base, self._both = Compressor(ordinary), Compressor(ordinary + toxic)
        self._known = np.zeros(1 << 16, bool)
        if len(toxic) >= GRAM:
            self._known[_grams(np.frombuffer(toxic, np.uint8))] = True
        self.thresholds = thresholds

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window. A window that has no
        GRAM bytes in common with it can't gain and isn't compressed."""
        return self.savings_of(plain(text))

    def savings_of(self, data: bytes) -> np.ndarray:
        cut = windows(data)
        saved = np.zeros(len(cut))
        if len(data) >= GRAM:
            hits = np.flatnonzero(self._known[_grams(np.frombuffer(data, np.uint8))])
            near = np.unique(np.concatenate([hits // STEP, np.maximum(hits - (WINDOW - STEP), 0) // STEP])) if len(hits) else hits
            for i in near[near < len(cut)]:
                saved[i] = self._base.length(cut[i]) - self._both.length(cut[i])
        return np.maximum(saved, 0)

    def features(self, text: str | None) -> list[float]:
        return features_of(self.savings(text), self.thresholds)


def features_of(s: np.ndarray, thresholds: tuple[float, ...]) -> list[float]:
    top = np.sort(s)[::-1][:3]
    counts = [float((s >= t).sum()) for t in thresholds]
    return [top[0], top[:2].mean(), top.mean(), *np.log1p(counts), *(c / len(s) for c in counts), np.log(len(s))]


def calibrated(x: np.ndarray, labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (the last one constant) of a ridge logistic regression."""
    y = np.array(labels, float)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, ridge = np.zeros(a.shape[1]), np.r_[np.full(a.shape[1] - 1, 0.1), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + np.diag(ridge)
        w += np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return mean, spread, w


def fit(sample: Iterable[tuple[str, int]]) -> Model | None:
    """None where the labelled sample lacks a class."""
    rows = [(plain(t), int(y)) for t, y in sample]
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    if not toxic or not ordinary:
        return None
    usual = trained([w for x in ordinary[:1000] for w in windows(x)], ORDINARY_BYTES)
    # equal texts are in one fold
    fold = [zlib.crc32(t) % FOLDS for t, _ in rows]
    savings = [np.zeros(0)] * len(rows)
    for k in range(FOLDS):
        others = [[t for (t, y), f in zip(rows, fold, strict=True) if y == c and f != k] for c in (1, 0)]
        scorer = Scorer(usual, toxic_dictionary(*others))
        for i, (t, _) in enumerate(rows):
            if fold[i] == k:
                savings[i] = scorer.savings_of(t)
    saved = np.concatenate([s for s, (_, y) in zip(savings, rows, strict=True) if y == 0])
    thresholds = tuple(float(max(low, np.quantile(saved, q))) for low, q in ((3, 0.99), (4, 0.999), (6, 0.9999)))
    x = np.array([features_of(s, thresholds) for s in savings])
    return Model(usual, toxic_dictionary(toxic, ordinary), thresholds, *calibrated(x, [y for _, y in rows]))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> list[tuple[str, int]]:
    """At most ``per_class`` whole texts of each label, by a hash of the identifier, and no more of a label
    once they have SAMPLE_BYTES: every fifth identifier (crc32 of it as text, modulo 5, is 0) is held out."""
    learn = F.crc32(F.col(id_col).cast("string")) % 5 != 0
    marks = (labels.filter(F.col(label_col).isin(0, 1) & learn)
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y")).withColumn("_order", F.xxhash64("_id")))
    few = settled(marks.filter("_y = 1").orderBy("_order", "_id").limit(per_class)
                  .unionByName(marks.filter("_y = 0").orderBy("_order", "_id").limit(per_class)))
    found = (docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
             .join(F.broadcast(few), "_id").groupBy("_id", "_order", "_y").agg(F.min("_text").alias("_text")).orderBy("_order", "_id"))
    # two limits above bound the rows, SAMPLE_BYTES what is held of them
    rows, held = [], [0, 0]
    for r in found.select("_text", "_y").toLocalIterator():
        if held[r["_y"]] < SAMPLE_BYTES:
            rows.append((r["_text"], r["_y"]))
            held[r["_y"]] += len((r["_text"] or "").encode())
    return rows


def score_texts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): higher is likelier toxic. A null text scores as the empty one; with
    no model (labels of one class, or none) every score is 0. Rows stay as they are."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.ordinary, model.toxic, model.thresholds) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if scorer is None:
                    scores = np.zeros(part.num_rows)
                else:
                    x = np.array([scorer.features(t.as_py()) for t in part.column("text")])
                    z = np.c_[(x - model.mean) / model.spread, np.ones(len(x))] @ model.weights
                    scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.record_batch([part.column("id"), pa.array(np.round(scores, 9))], ["id", "score"])
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
