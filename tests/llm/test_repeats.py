"""Repeated passages against all windows of 50 words."""

import random
from collections import defaultdict

from cohortloom.llm import suffix_dedup

from .helpers import WORDS, documents, odd_rows


def plain(rows):
    places, texts = defaultdict(set), {}
    for doc_id, key, text in rows:
        texts[doc_id is None, doc_id or 0, key] = WORDS.findall(text or "")
    for place, words in texts.items():
        for i in range(len(words) - 49):
            places[tuple(words[i:i + 50])].add((place, i))
    out = {}
    for place, words in texts.items():
        repeated, later = set(), set()
        for i in range(len(words) - 49):
            found = places[tuple(words[i:i + 50])]
            if len(found) > 1:
                repeated |= set(range(i, i + 50))
                if (place, i) != min(found):
                    later |= set(range(i, i + 50))
        if repeated:
            out[place] = repeated, later
    return out


def covered(spans):
    return {i for s in spans for i in range(s.start, s.stop)}


def rows_with_passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(45, 200))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            words += p[a:rng.randint(a, len(p))] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(40)]
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = "edit"
        rows.append((i if i % 9 else None, " ".join(words) if i % 11 else None))
    return rows + rows[:5] + [(7, "z " * 200), (7, "y " * 60), (None, "z " * 90)]


def test_spans_equal_all_windows(spark):
    for rows in (rows_with_passages(1), rows_with_passages(2), odd_rows()):
        docs = documents(spark, rows)
        keyed = [(r.doc_id, r.key, r.text) for r in suffix_dedup.keyed(docs).collect()]
        want = plain(keyed)
        got = {(r.doc_id is None, r.doc_id or 0, r.key): (covered(r.spans), covered(r.later))
               for r in suffix_dedup.repeated_spans(docs).collect()}
        assert got == want
    assert suffix_dedup.repeated_spans(documents(spark, [])).collect() == []


def test_later_passages_are_cut(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"first one {shared} end."), (2, f"Second\n {shared}\n\nthe  rest"), (3, shared), (4, "clean text"), (5, None)]
    out = suffix_dedup.drop_repeats(documents(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: rows[0][1], 2: "Second\n the  rest", 4: "clean text", 5: None}
