"""Line dedup against a plain one, and the store after documents came and went."""

import random
from collections import defaultdict

import numpy as np
import pytest

from cohortloom.llm import line_dedup
from cohortloom.llm.line_dedup import Cuckoo, LineStore

from .helpers import documents, lower, odd_rows

BLANK = "\x20\t\n\v\f\r"


def key_of(line):
    return lower(line.strip(BLANK))


def plain(rows, held=None):
    """(doc_id, text kept, lines, lines dropped); the counts are those of `held` (the rows themselves unless given)."""
    holders = defaultdict(list)
    for i, text in rows if held is None else held:
        for key in {key_of(line) for line in (text or "").split("\n")}:
            if len(key) >= 20:
                holders[key].append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for line in lines:
            ids = holders.get(key_of(line), [])
            largest = max((x for x in ids if x is not None), default=None)
            if len(ids) < 3 or i == largest:
                stay.append(line)
        out.append((i, text if text is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def line_rows(seed=5, n=90):
    rng = random.Random(seed)
    common = [f"A Line that many hold, number {i:04d}" for i in range(12)] + ["é" * 19 + "Z", "é" * 19, "short line"]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) for _ in range(rng.randint(0, 6))] + [f"only in document {i} and long enough {j}" for j in range(3)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "])
                                  for x in lines)))
    return rows + [(n + 1, "\n\n"), (n + 2, common[0] * 3000 + "\n" + common[1])]


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_equal_plain_ones(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    rows = line_rows() + [(i + 200, t) for i, t in odd_rows() if i is not None] + [(None, t) for _, t in line_rows(6, 8)]
    rows += rows[3:6]
    got = line_dedup.dedup_lines(documents(spark, rows).repartition(4))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert result(got) == plain(rows)
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []


def state_of(store):
    counts = {(bytes(r.key), r.n, r.largest) for r in store.counts.collect()}
    refs = sorted(((r.doc_id, r.text_hash, bytes(r.key)) for r in store.references.collect()), key=str)
    return counts, refs, sum(r.n_keys for r in store.filters.collect())


def test_documents_come_and_go(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rows = line_rows(7, 60)
    rng = random.Random(8)
    rng.shuffle(rows)
    store = LineStore.of(documents(spark, rows[:20]))
    first = state_of(store)
    more = store.insert(documents(spark, rows[20:45])).insert(documents(spark, rows[45:]))
    fresh = LineStore.of(documents(spark, rows))
    assert state_of(more) == state_of(fresh)
    assert result(more.apply(documents(spark, rows))) == plain(rows)
    gone = {i for i, _ in rows[20:45]} | {max(i for i, _ in rows)}
    less = more.delete(spark.createDataFrame([(i,) for i in gone] + [(None,), (10**6,)], "doc_id long"))
    held = [r for r in rows if r[0] not in gone]
    counts, refs, n_keys = state_of(LineStore.of(documents(spark, held)))
    assert state_of(less) == (counts, refs, n_keys)
    assert result(less.apply(documents(spark, rows))) == plain(rows, held)
    back = more.delete(spark.createDataFrame([(i,) for i, _ in rows[20:]], "doc_id long"))
    assert state_of(back) == first
    assert result(back.apply(documents(spark, rows[:20]))) == plain(rows[:20])


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 256, (20_000, 16), dtype=np.uint8)
    cuckoo = Cuckoo.of(keys)
    assert cuckoo.contains(keys).all() and (cuckoo.table > 0).sum() == len(keys)
    others = rng.integers(0, 256, (50_000, 16), dtype=np.uint8)
    assert cuckoo.contains(others).mean() < 0.001
    cuckoo.delete(keys[:12_000])
    assert (cuckoo.table > 0).sum() == 8_000 and cuckoo.contains(keys[12_000:]).all()
    assert cuckoo.contains(keys[:12_000]).mean() < 0.001
    assert cuckoo.insert(keys[:12_000]) and cuckoo.contains(keys).all()
    assert (Cuckoo.load(cuckoo.dump()).table == cuckoo.table).all()
    tight = Cuckoo(np.zeros((4, 4), np.uint16))
    assert not tight.insert(keys[:40])
    same = np.repeat(keys[:1], 6, axis=0)  # one key's eight slots
    eight = Cuckoo.sized(6)
    assert eight.insert(same)
    eight.delete(same[:5])
    assert eight.contains(same).all()
    eight.delete(same[:1])
    assert not eight.table.any()
