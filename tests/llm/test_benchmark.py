"""Decontamination against scoring every passage with every item."""

import math
import random
from collections import Counter

from cohortloom.llm import decontaminate as D

from .helpers import documents, odd_rows


def plain(rows, items):
    segments = [(i, s) for i, t in {(i, t) for i, t in items if i is not None} for s in D.segments(D.terms(t)) if s]
    n, df = len(segments), Counter(w for _, s in segments for w in set(s))
    mean = sum(len(s) for _, s in segments) / n

    def impacts(words):
        w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(words) / mean))
             for t, c in Counter(words).items()}
        return {t: x / sum(w.values()) for t, x in w.items()}

    def covers(words, passage):
        k = min(5, len(words))
        there = {tuple(passage[i:i + k]) for i in range(len(passage) - k + 1)}
        hit = set()
        for i in range(len(words) - k + 1):
            if tuple(words[i:i + k]) in there:
                hit |= set(range(i, i + k))
        half = (len(words) + 1) // 2
        parts = [range(half), range(half, len(words))]
        return all(len(hit & set(p)) >= 0.6 * len(p) for p in parts)

    weighed = [(i, s, impacts(s)) for i, s in segments]
    out = {}
    for doc_id, text in rows:
        words = D.terms(text)
        for a in range(0, max(1, len(words) - 64), 64):
            passage = words[a:a + 128]
            for i, s, w in weighed:
                score = sum(w[t] for t in w.keys() & set(passage))
                if score >= 0.6 and covers(s, passage):
                    out[doc_id, i] = max(score, out.get((doc_id, i), 0))
    return out


def test_matches_equal_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(D, "INDEX_ITEMS", 7)  # several indexes
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(3, 150))) for i in range(30)] + [(40, None), (41, ""), (None, "x y z"), (3, "Again, three!")]
    items.append((42, items[5][1]))
    rows = odd_rows()
    for i in range(200, 260):
        item = rng.choice([t for _, t in items if t]).split()
        if rng.random() < 0.5:
            item[rng.randrange(len(item))] = "edit"
        if rng.random() < 0.3:
            item = item[:len(item) // 2]
        rows.append((i, text(rng.randint(0, 300)) + " " + ", ".join(item).upper() + "\n" + text(rng.randint(0, 90))))
    rows.append((None, items[0][1]))
    docs, table = documents(spark, rows), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, term long")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs, table).collect()}
    want = plain(rows, items)
    assert got.keys() == want.keys() and len(want) > 20
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5
    dirty = {i for i, _ in want}
    left = [r.doc_id for r in D.drop_contaminated(docs, table).collect() if r.doc_id is not None]
    assert sorted(left) == sorted(i for i, _ in rows if i is not None and i not in dirty)
    assert D.contaminated(docs.limit(0), table).collect() == [] == D.contaminated(docs, table.limit(0)).collect()
