"""Line dedup against a plain loop over all lines."""

import hashlib
import random

import duckdb
import pytest

from docscope.llm import line_dedup, oracle

BLANKS = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def key(line):
    return line.strip(BLANKS).translate(UPPER)


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    common = {k: max((x for x in ds if x is not None), default=None)
              for k, ds in holders.items() if len(k) >= 20 and len(ds) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in common and common[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, **options))
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()], key=repr)


EDGES = [
    (1, None), (2, ""), (3, "\n"), (4, "a line that is common to many\nshort\nshort"),
    (5, " A Line that is common to MANY\t\r\nother"), (6, "x\na line that is common to many\na line that is common to many"),
    (6, "a second row of document six\na line that is common to many"), (None, "a line that is common to many\nÉté"),
    (7, "ÄPFEL UND BIRNEN UND ANDERES"), (8, "ÄPFEL und birnen und anderes"), (9, "äpfel und birnen und anderes"),
    (10, "nineteen characters"), (11, "nineteen characters"), (12, "nineteen characters"),
    (13, "exactly twenty chars"), (14, "exactly twenty chars  "), (15, "EXACTLY twenty chars"),
    (15, "EXACTLY twenty chars"), (None, None)]


def test_edges(spark):
    assert run(spark, EDGES) == brute(EDGES)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_random_and_split_hot_lines(spark):
    rng = random.Random(5)
    pool = [f"shared line number {i} of the pool" for i in range(12)] + ["tiny", ""]
    hot = "the line that a third of all the rows hold"
    rows = [(rng.randrange(150), "\n".join([hot] * rng.randrange(2) + rng.choices(pool, k=rng.randrange(9))
                                           + [f"own line {i} of this document"])) for i in range(300)]
    rows.append((997, "\n".join(pool * 900)))  # very long: 12,600 lines
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, range_rows=97) == want  # the hot line lies over several ranges


def test_native_plan_with_no_shuffle_for_the_first_occurrences(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    plan = line_dedup.keep_bitmaps(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_bitmaps_hold_no_text_and_extra_columns_stay(spark):
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in EDGES], "doc_id long, text string, n_lines string, word int")
    bitmaps = line_dedup.keep_bitmaps(docs)
    assert bitmaps.columns == ["doc_id", "row", "n_dropped", "bits"]
    out = line_dedup.apply_bitmaps(docs, bitmaps)
    assert out.columns == ["doc_id", "text", "n_lines", "word", "kept_text", "n_lines_", "n_dropped"]
    assert out.count() == len(EDGES)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_matches_sql(spark, sf):
    import __spark_entry__ as E

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/{sf}/documents.parquet')")
    got = {tuple(r) for r in E.queries()["op13_line_dedup"](spark, f"/root/testdata/{sf}").collect()}
    assert got == set(con.execute(oracle.LINE_DEDUP).fetchall())
    empty = hashlib.sha256(b"").hexdigest()
    assert all(len(r[3]) == len(empty) for r in got)
