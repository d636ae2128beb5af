"""Small document tables with the awkward cases: nulls, empty and very long texts, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "re", "lo", "Mi", "ser", "an", "é", "st"]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def texts(seed=1, n=60):
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    out += [None, "", " ", "\n\n", "one", "two words", "\t x \n", "é" * 50, "漢字 かな 　全角", "a\x1cb\x85c\xa0 d", "\0 zero", "emoji 👩‍👩‍👧 x", prose(rng, 30_000), "word" * 20_000, " " * 5000 + "end", "same text here again"]
    for base in (out[3], out[7]):
        out += [base, base + " more", base.replace(" ", "  "), base.upper()]
    return out


def documents(spark, rows=None, extra=True):
    """Documents from texts; the ids aren't in order, one row is repeated, one has no id."""
    rows = texts() if rows is None else rows
    data = [((k * 7919) % 100_003, t, ("en", "de", None)[k % 3], "src", None if t is None else len(t)) for k, t in enumerate(rows)]
    data += [data[0], data[5], (None, "no id here", "en", None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    if extra:  # names that operators use inside
        for name in ("fp", "row", "drop", "lines", "line", "h", "id", "n", "least", "component_id", "score", "ids", "n_tokens", "part", "start", "spans", "toxic", "item_id", "key", "pos", "k"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(f"mine {name}"))
    return df, data


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
