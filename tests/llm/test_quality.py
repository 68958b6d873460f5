"""Quality rules and weak labels."""

import random
import re
from collections import Counter

import numpy as np

from cohortloom.llm import quality_rules as Q
from cohortloom.llm import weak_labels as W

from .helpers import WORDS, documents, odd_rows


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    repeated = {j for i in range(n - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += line in seen
            seen.add(line)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)


def labelled(n=1600, seed=13):
    """Good texts, and bad ones full of symbols; some labels are wrong."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"wo{rng.randint(0, 900)}" + ("***" if bad else "") for _ in range(rng.randint(25, 60))]
        rows.append((i, " ".join(words) + ".", ["en", "de", None][i % 3]))
        labels.append((i, int(not bad), 0))
    return rows, labels + [(None, 1, 0), (2, None, None), (0, 0, None), (0, 0, 1), (n + 5, 1, 0)]


def label_table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, scores string")


def test_measures(spark):
    rows = odd_rows() + [(90, "a b c d e f g h a b c d e f g h"), (91, "x\n \nx\nx#|"), (92, "a " * 40)]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                  for r in Q.judge(documents(spark, rows), label_table(spark, [])).collect())
    assert got == Counter((i, *(m := plain(t)), not m[-1]) for i, t in rows)
    assert Q.judge(documents(spark, []), label_table(spark, [])).collect() == []


def test_binomial_tail_is_exact():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (200, 0, 0.02), (500, 9, 0.03)):
        assert abs(Q.binomial_tail(k, n, p) - sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_cuts_are_certified_and_keep_good_texts(spark):
    rows, labels = labelled()
    docs, table = documents(spark, rows + [(None, None)]), label_table(spark, labels)
    kept = {r.doc_id: r.kept for r in Q.judge(docs, table).collect()}
    good = [i for i, *_ in rows if i % 5]
    assert sum(not kept[i] for i in good) <= Q.ALPHA * len(good)
    assert not any(kept[i] for i, *_ in rows if i % 5 == 0) and kept[None] is False
    stays = Q.keep_good(docs, table)
    assert stays.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in stays.collect()} == {i for i, k in kept.items() if k}


def test_too_few_labels_certify_nothing(spark):
    rows, labels = labelled(60)
    measured = Q.measure(Q.with_lang(documents(spark, rows)), ["doc_id", "lang"])
    assert all(not r.cuts for r in Q.certified_cuts(measured, label_table(spark, labels)).collect())


def test_estimated_accuracies_are_near_the_true_ones():
    rng = np.random.default_rng(14)
    good = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    vote = np.where((rng.random((20_000, 5)) < right) == good[:, None], W.GOOD, W.BAD)
    vote[rng.random((20_000, 5)) < 0.3] = W.NONE
    patterns, at, counts = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    share, table, posterior = W.estimate(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03
    assert np.abs(table[1, :, 1] - right).max() < 0.04 and np.abs(table[0, :, 0] - right).max() < 0.05
    assert ((posterior[at.ravel()] > 0.5) == good).mean() > 0.93


def test_classifier_separates_good_from_bad(spark, monkeypatch):
    monkeypatch.setattr(W, "STEPS", 15)
    rows, _ = labelled(400)
    got = {r.doc_id: r for r in W.classify(documents(spark, rows + [(900, None), (901, ""), (900, None)])).collect()}
    assert sum(got[i].kept == bool(i % 5) for i, *_ in rows) > 0.97 * len(rows)
    assert sum((got[i].score > 0.5) == bool(i % 5) for i, *_ in rows) > 0.95 * len(rows)
    assert not got[900].kept and not got[901].kept
    assert W.classify(documents(spark, [])).collect() == []
