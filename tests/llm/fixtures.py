"""A small table of documents with every odd case, and helpers."""

import re

import duckdb

ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, "1234 !!", "en", "b"),
    (None, "words without an id " * 6, "en", "b"),
    (6, "the same words again and again", None, "b"),
    (6, "the same words again and again", None, "b"),
    (7, "żółw 你好 " + "x" * 70 + " end", "pl", "c"),
    (8, "long " + " ".join(f"word{i % 4001}" for i in range(30_000)), "en", "c"),
    (9, "The  Apache License, and MIT license", "en", "c"),
    (10, "plain words that follow one another " + " ".join(f"and{i} then{i}" for i in range(40)), "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents(spark):
    """The odd cases, with further columns named as the operators name theirs."""
    frame = spark.createDataFrame(ODD, SCHEMA)
    names = ["kept", "id", "n", "group", "score", "position", "block", "_set", "_rank", "row", "n_chars"]
    return frame.selectExpr("*", *[f"cast(null as long) as {n}" for n in names])


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def table(name, sf="0.001"):
    rows = duckdb.sql(f"select * from '/root/testdata/sf{sf}/{name}.parquet'").fetchall()
    columns = [c[0] for c in duckdb.sql(f"describe '/root/testdata/sf{sf}/{name}.parquet'").fetchall()]
    return [dict(zip(columns, r, strict=True)) for r in rows]
