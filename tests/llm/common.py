"""Small tables with the odd rows that every operator has to take."""
import random

NAMES = "doc_id long, text string, id string, block int, row string, kept string, key string, node string, digest string, rate string"


def rows_of(texts, first=0):
    """Rows with columns whose names clash with those of the operators' own."""
    return [(first + n, t, "x", 7, None, "no", "k", "n", "d", None) for n, t in enumerate(texts)]


def odd_texts(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    return [None, "", "  ", "Ä", "one", base, base, base.upper(), base + " tail", prose(60), prose(3), "a\0b\r\n\tc",
            "é" * 50 + " 中文 text", prose(20_000), "aaaa" * 400, *[f"copy {base}"] * 8]


def table(spark, texts, ids=None):
    rows = rows_of(texts)
    if ids is not None:
        rows = [(i, *r[1:]) for i, r in zip(ids, rows, strict=True)]
    return spark.createDataFrame(rows, NAMES).repartition(3)


def empty(spark):
    return spark.createDataFrame([], NAMES)
