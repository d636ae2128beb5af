import hashlib
from collections import defaultdict

from slidestream.llm import line_dedup
from tests.llm import data

SPACE = " \t\n\x0b\f\r"
COMMON = "This line is in very many documents."


def key(line):
    return line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})


def plain(rows, min_chars=20, min_docs=3):
    docs = defaultdict(set)
    low = -(1 << 63)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(low if i is None else i)
    common = {k: max(d) for k, d in docs.items() if len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in common and len(key(x)) >= min_chars and (low if i is None else i) < common[key(x)])]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.line_dedup(df).collect())


def test_cases(spark):
    rows = [f"first {k}\n {COMMON.upper()}\t\nother line number {k} of the text\n{COMMON}\n" for k in range(8)]
    rows += [COMMON, f"{COMMON}\n{COMMON}", "Élan of a line that only É changes", "élan of a line that only É changes", "short\nshort", "short", "short", "x" * 19, "x" * 19, "x" * 19, "y" * 20, "y" * 20, "y" * 20, "\n" * 50 + COMMON, *data.texts()]
    df, full = data.documents(spark, rows)
    assert run(df) == plain([(i, t) for i, t, *_ in full])


def test_other_columns_stay(spark):
    df, full = data.documents(spark)
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(r.row + r.lines + r.drop for r in out.collect()) == ["mine row" + "mine lines" + "mine drop"] * len(full)


def test_same_id_counts_once(spark):
    df = spark.createDataFrame([(1, COMMON), (1, COMMON + "\nmore"), (1, COMMON), (2, COMMON)], "doc_id int, text string")
    assert sum(r.n_dropped for r in line_dedup.line_dedup(df).collect()) == 0


def test_all_lines_go(spark):
    df = spark.createDataFrame([(k, COMMON) for k in range(5)], "doc_id int, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(df).collect()) == [(k, "") for k in range(4)] + [(4, COMMON)]


def test_many_lines(spark):
    long = "\n".join(f"{COMMON} {k % 50}" for k in range(20_000))
    df = spark.createDataFrame([(k, long) for k in range(4)], "doc_id int, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(df).collect()) == [(0, 20_000), (1, 20_000), (2, 20_000), (3, 0)]


def test_empty(spark):
    assert line_dedup.line_dedup(data.empty(spark)).count() == 0


def test_no_python_in_plan(spark):
    df, _ = data.documents(spark)
    plan = line_dedup.line_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_column_names_with_dots(spark):
    from pyspark.sql import functions as F

    from slidestream.llm import line_dedup, simhash

    df = spark.createDataFrame([(k, "a line that is shared by three\nown " + str(k)) for k in range(3)], "doc_id long, text string")
    df = df.withColumn("a.b", F.lit(1)).withColumn("c`d", F.col("doc_id"))
    got = line_dedup.line_dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"] and sorted(tuple(r) for r in got.collect()) == [(0, "own 0", 1, 0, 2, 1), (1, "own 1", 1, 1, 2, 1), (2, "a line that is shared by three\nown 2", 1, 2, 2, 0)]
    assert simhash.near_dedup(df).columns == df.columns and simhash.near_dedup(df).count() >= 1
