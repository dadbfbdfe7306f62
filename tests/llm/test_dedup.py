"""Suffix-array, substring, line and near-duplicate operators against plain versions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionlab.llm.chosen_path import deduplicate, similar
from sessionlab.llm.line_dedup import line_dedup
from sessionlab.llm.queries import QUERIES, SQL
from sessionlab.llm.substring_dedup import substring_dedup
from sessionlab.llm.suffix_dedup import suffix_dedup
from tests.llm.brute import classes, earlier_bytes, earlier_words

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, "ab" * 300), (9004, "é" * 200), (9005, "ab " * 300), (9006, " \t\n"), (9007, "a b c"), (9008, "a  b c")]


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + ODD


def table(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("tag", "anchor", "places", "node", "host", "line")})


@pytest.mark.parametrize("most", [16_384, 2])
def test_suffix_dedup(spark, rows, most):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(table(spark, rows), most_segments=most).collect()}
    assert got == earlier_bytes(rows, 100)


@pytest.mark.parametrize("most", [16_384, 2])
def test_periodic_bytes(spark, most):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice(["ab", "c", " the ", "xyz"]) for _ in range(draw.randrange(60)))) for i in range(200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(table(spark, rows), length=20, most_segments=most).collect()}
    assert got == earlier_bytes(rows, 20)


@pytest.mark.parametrize("most", [16_384, 2])
def test_substring_dedup(spark, rows, most):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(table(spark, rows), most_segments=most).collect()}
    assert got == earlier_words(rows, 13)


@pytest.mark.parametrize("most", [16_384, 2])
def test_periodic_words(spark, most):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(["ab", "c", "the", "xyz"]) for _ in range(draw.randrange(60)))) for i in range(200)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(table(spark, rows), window=6, most_segments=most).collect()}
    assert got == earlier_words(rows, 6)


def test_rows_without_id_are_told_apart_by_the_whole_hash(spark):
    """Two different texts without doc_id whose hashes agree in the low 26 bits."""
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.hex(F.xxhash64("id", F.lit(i)))) for i in range(20)])
    drawn = spark.range(60_000).select(text.alias("text")).withColumn("low", F.xxhash64("text").bitwiseAND((1 << 26) - 1))
    first, second = drawn.groupBy("low").agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").orderBy("low").first().texts[:2]
    docs = table(spark, [(1, first), (None, first), (None, second)])
    by_bytes = {(r.doc_id, bytes(r.kept).decode()) for r in suffix_dedup(docs).collect()}
    assert by_bytes == {(1, first), (None, ""), (None, second)}
    assert {(r.doc_id, r.kept) for r in substring_dedup(docs).collect()} == by_bytes
    assert {(r.doc_id, r.text) for r in deduplicate(docs).collect()} == {(1, first), (None, second)}
    both = table(spark, [(None, first), (None, second)])
    assert {r.text for r in deduplicate(both).collect()} == {first, second}
    near = table(spark, [(None, first * 4), (None, second * 4), (None, first * 4 + " x"), (None, second * 4 + " x")])
    assert [r.n_links for r in similar(near).collect()] == [1] * 4


def test_long_windows(spark):
    """A segment of a window of 200 bytes has more than 127 windows."""
    draw = random.Random(5)
    text = "".join(draw.choice("abcdefgh") for _ in range(2000))
    rows = [(1, text), (2, "x" + text[100:1500] + "y" + text[300:560]), (3, text[700:])]
    for most in (16_384, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(table(spark, rows), length=200, most_segments=most).collect()}
        assert got == earlier_bytes(rows, 200)
    with pytest.raises(ValueError):
        suffix_dedup(table(spark, rows), length=1 << 24)


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 2
    rows = [(1, text), (1, text), (None, text), (None, None)]
    out = [(r.doc_id, r.n_removed > 0) for r in suffix_dedup(table(spark, rows)).collect()]
    assert sorted(out, key=str) == [(1, False), (1, False), (None, False), (None, True)]
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in substring_dedup(table(spark, rows)).collect()) == [("1", False), ("1", False), ("None", False), ("None", True)]
    near = similar(table(spark, rows)).collect()
    assert sorted(r.n_links for r in near) == [0, 2, 2, 2] and len({r.class_id for r in near if r.n_links}) == 1
    assert sorted(str(r.doc_id) for r in deduplicate(table(spark, rows)).collect()) == ["1", "None"]


def test_empty_tables(spark):
    none = table(spark, [])
    for operator in (suffix_dedup, substring_dedup, similar, deduplicate):
        assert operator(none).count() == 0
    assert line_dedup(none.withColumn("source", F.lit("s"))).count() == 0


def test_near_duplicates(spark, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar(table(spark, rows)).collect()}
    want = classes(rows)
    assert got == want
    kept = deduplicate(table(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in want.values()} and kept.columns == table(spark, rows).columns


@pytest.mark.parametrize("small", [64, 4096])
def test_a_large_family_in_tiles(spark, small):
    draw = random.Random(2)
    rows = [(i, " ".join(f"w{j}" if draw.random() > 0.012 else f"x{draw.randrange(10**6)}" for j in range(120))) for i in range(200)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar(table(spark, rows), small=small, tile=40).collect()}
    assert got == classes(rows)


def test_lines_agree_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF[:-3]}1/documents.parquet'")
    got = sorted(map(tuple, QUERIES["op5_line_dedup"](spark, f"{SF[:-3]}1").collect()), key=repr)
    want = sorted(con.execute(SQL["op5_line_dedup"]).fetchall(), key=repr)
    assert got == want and any(r[2] for r in got)


def test_lines_with_nulls(spark):
    rows = [(i, f"shared\nown {i}\n", "s") for i in range(10)] + [(20, None, "s"), (21, "shared", None), (22, "shared", "s"), (23, "", "s"), (24, "shared\nown 1\n", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs).collect()}
    assert got[3] == ("own 3\n", 3, 1) and got[20] == (None, 0, 0) and got[21] == ("shared", 1, 0) and got[22] == ("", 1, 1) and got[23] == ("", 1, 0) and got[24][2] == 0
