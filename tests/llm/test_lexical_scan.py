"""Ranked search against a plain one."""

import math
import random
import re
from collections import Counter

import pytest

from cohortloom.llm import lexical_scan

from .helpers import documents, lower, odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, top):
    """Every document against every item; docs and items are (id, text)."""
    found = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in found:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                    for t in TERM.findall(lower(text or "")) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, rank int, term string")


@pytest.mark.parametrize("part_bytes", [1_000_000, 150])
def test_scan_equals_plain_ranking(spark, monkeypatch, part_bytes):
    """Once with one automaton, once with many parts, small chunks and small score blocks."""
    if part_bytes < 1000:
        monkeypatch.setattr(lexical_scan, "CHUNK_BYTES", 3000)
        monkeypatch.setattr(lexical_scan, "CELLS", 500)
    rng = random.Random(part_bytes)
    docs = odd_rows(seed=4, n=120) + [(200 + i, f"tie wo{i % 3}rd") for i in range(12)] + [(300, "É é ÉA 9\x7f9 a_b"), (301, "-- !! \n")]
    items = [(i, " ".join(f"wo{rng.randint(0, 70)}rd" for _ in range(rng.randint(1, 30)))) for i in range(15)]
    items += [(20, None), (21, ""), (22, "absent"), (23, "tie tie WO1RD, tie"), (None, "é 9 b wo5rd"), (3, "other text wo7rd"), items[0]]
    got = lexical_scan.top_documents(documents(spark, docs).repartition(5), items_of(spark, items), top=7, part_bytes=part_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 7)


def test_empty_tables(spark):
    docs, items = documents(spark, odd_rows()), items_of(spark, [(1, "wo1rd")])
    assert lexical_scan.top_documents(documents(spark, []), items).collect() == []
    assert lexical_scan.top_documents(docs, items_of(spark, [])).collect() == []
    assert lexical_scan.top_documents(docs, items_of(spark, [(1, None), (2, "?!")])).collect() == []


def test_terms():
    assert lexical_scan.terms_of("A-b_C9 Ünï\xa0x\x00y") == ["a", "b", "c9", "Ünï\xa0x", "y"] or \
        [t.decode() for t in lexical_scan.terms_of("A-b_C9 Ünï\xa0x\x00y")] == ["a", "b", "c9", "Ünï\xa0x", "y"]
