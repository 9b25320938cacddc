"""Operator 7: canonical forms, odd ids, collisions, and every column of the query against brute force."""

import hashlib
import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from tagloom.llm import fingerprint, queries
from tagloom.llm.workspace import Workspace


def test_fingerprints(spark):
    rows = [(1, "Ab  c"), (2, " aB\tC "), (3, "ab d"), (4, None), (5, ""), (6, "é"), (7, "É"), (8, "ﬁ"), (9, "FI"), (1, "Ab  c"), (None, "x"), (None, "y"), (1, "z")]
    frame = spark.createDataFrame(rows, "digest long, i0 string").selectExpr("*", "1 as bitmap", "2 as slot")
    got = [(r["digest"], r["fingerprint"]) for r in fingerprint.fingerprints(frame, Workspace(spark, "t"), ["digest"], "i0").collect()]
    assert len(got) == len(rows) and sum(i is None for i, _ in got) == 2
    one = dict(got)
    assert one[2] in {f for i, f in got if i == 1} and one[2] != one[3] and one[4] == one[5] and one[6] == one[7] and one[8] == one[9] and len(one[2]) == 32
    assert fingerprint.fingerprints(frame.limit(0), Workspace(spark, "t"), ["digest"], "i0").count() == 0


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda canon: F.substring(canon, 1, 1))
    frame = spark.createDataFrame([(1, "aa"), (None, "ab"), (1, "aa"), (3, "b")], "id long, text string")
    got = fingerprint.fingerprints(frame, Workspace(spark, "t"), ["id"]).collect()
    by_text = sorted((str(r["id"]), r["fingerprint"]) for r in got)
    assert len(got) == 4 and by_text[0] == by_text[1] and len({f for _, f in by_text}) == 3 and by_text[2][1] == "b"
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(["aaaaaa", "abaaaa", "aaaaaa", None, "b"])], "key long, doc_id long, text string")
    out = {r["doc_id"]: r for r in fingerprint.edited_likeness(docs, Workspace(spark, "t"), ["key"]).collect()}
    assert out[0]["fingerprint"] == out[2]["fingerprint"] != out[1]["fingerprint"] and len(out) == 5


def brute(rows):
    """Rows (key, doc_id, text) -> what the query says of each, fingerprints as canonical texts."""
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    out = []
    for i, (_, doc_id, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][2] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        out.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), canon(t), canon(edited), float(canon(t) == canon(edited)), float(canon(t) == canon(after))))
    return out


def check(got, want):
    got = [tuple(r) for r in got]
    assert len(got) == len(want)
    # fingerprints stand for canonical texts one to one
    names, texts = {}, {}
    for a, b in zip(sorted(got, key=lambda r: (repr(r[0]), r[1], r[2])), sorted(want, key=lambda r: (repr(r[0]), r[1], r[2]))):
        assert (*a[:3], *a[5:]) == (*b[:3], *b[5:])
        for f, c in zip(a[3:5], b[3:5]):
            assert names.setdefault(f, c) == c and texts.setdefault(c, f) == f


def test_query_on_odd_ids(spark, tmp_path):
    rows = [(1, "ab CD é" * 9), (1, "ab CD é" * 9), (1, "other"), (None, "nobody"), (None, None), (7, ""), (5, "x" * 300_000), (4, "\u0130stanbul \U0001f600 " * 4), (3, "aaa"), (2, "aaa")]
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, digest string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_document_fingerprints(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet").select("_metadata.row_index", "doc_id", "text").collect()
    check(got.collect(), brute([tuple(r) for r in stored]))
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op7_document_fingerprints(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    stored = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "doc_id", "text").collect()
    check(queries.op7_document_fingerprints(spark, sf).collect(), brute([tuple(r) for r in stored]))
