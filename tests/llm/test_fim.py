"""Operator 11 against plain regular expressions."""

import hashlib
import re

import numpy as np
import pytest

from tagloom.llm import fim
from tagloom.llm.automaton import LANE, UNITS, Scan

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "paragraphs": r"(?s).*?\n\n|.+"}


def texts():
    rng = np.random.default_rng(3)
    made = ["", "\n", "a", "a\n", "\n\n", "é\n\n\nb", "x" * LANE, "x" * (LANE - 1) + "\n", "\n" * (3 * LANE + 1), "one <P> two\nthree", "<S", "<P\n<\n", "no newline at all " * 400]
    return made + ["".join(rng.choice(list("ab\n\né漢😀"), rng.integers(1, 5 * LANE))) for _ in range(60)]


def brute(doc_id, text, units="lines", seed=7, rate=100, spm=50):
    text = text or ""
    cut = re.findall(PATTERNS[units], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(cut) + 1), h[1] % (len(cut) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (cut[:low], cut[low:high], cut[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(cut), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(cut), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(cut), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("units", sorted(UNITS))
def test_scan_composes(units):
    """Functions of pieces, cut anywhere, compose to that of the whole, and every unit's end is found."""
    auto, rng = UNITS[units], np.random.default_rng(5)
    for text in texts():
        raw, whole = text.encode(), re.findall(PATTERNS[units], text)
        scan = Scan(auto, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert scan.units().tolist() == [len(whole)]
        wanted = sorted({0, len(whole), *rng.integers(0, len(whole) + 1, 5).tolist()})
        many = Scan(auto, np.frombuffer(raw * len(wanted), np.uint8), np.arange(len(wanted) + 1) * len(raw))
        assert many.ends_of(np.array(wanted)).tolist() == [len("".join(whole[:w])) for w in wanted]
        at = sorted(rng.integers(0, len(raw) + 1, 3).tolist())
        to, counts, _ = Scan(auto, np.frombuffer(raw, np.uint8), np.array([0, *at, len(raw)])).functions()
        state = units_seen = 0
        for t, c in zip(to, counts):
            units_seen, state = units_seen + c[state], t[state]
        assert units_seen + auto.pending[state] == len(whole)


FIELDS = "doc_id long, text string, n string, output string, `a.b` int"


def shown(frame):
    return sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("units", sorted(UNITS))
@pytest.mark.parametrize("piece", [fim.PIECE, 64])
def test_whole_and_dealt_texts(spark, units, piece):
    rows = [*enumerate(texts()), (None, "no id\nat all\n"), (3, None), (5, "again\nand\nagain"), (5, "again\nand\nagain")]
    frame = spark.createDataFrame([(i, t, "n", "o", 1) for i, t in rows], FIELDS)
    made = fim.fill_in_middle(frame, units, piece=piece, keep=["a.b", "text"])
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "a.b", "text"]
    assert shown(made) == sorted((brute(i, t, units) for i, t in rows), key=repr)
    back = made.select("text", fim.restored(made["output"], made["form"]).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in back)


def test_rate_and_empty_table(spark):
    rows = [(i, f"a{i}\nb\nc") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(fim.fill_in_middle(frame, seed=11, rate=40, spm=10)) == sorted((brute(i, t, seed=11, rate=40, spm=10) for i, t in rows), key=repr)
    assert fim.fill_in_middle(frame.limit(0)).count() == 0


def test_a_giant_text_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(fim, "GROUP", 4)
    text = "".join(f"line {i} é\n" * (i % 3) + "x" * (i % 50) for i in range(3_000)) + "end"
    frame = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    assert shown(fim.fill_in_middle(frame, piece=512)) == sorted((brute(i, text) for i in range(6)), key=repr)
