"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import xxhash

from cohortloom.llm import simhash

from .helpers import WORDS, documents, lower, odd_rows


def plain_fingerprint(text):
    words = WORDS.findall(lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in linked:
        parent[find(a)] = find(b)
    out = {}
    for v in values:
        out.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, out.values()))


def test_fingerprint():
    for _, text in odd_rows(seed=7):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    rng = random.Random(8)
    hashes = np.array([rng.getrandbits(64) for _ in range(70_000)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    assert simhash.majority(hashes) == sum(1 << j for j in range(64) if 2 * bits[j] > len(hashes))


def test_ball_hashing_finds_every_link():
    rng = random.Random(9)
    for _ in range(60):
        values = set()
        for _ in range(6):
            centre = rng.getrandbits(64)
            for _ in range(rng.randint(1, 40)):
                v, step = centre, rng.choice([1, 5])
                for _ in range(rng.randint(0, 5)):
                    v ^= 1 << rng.choice(range(0, 64, step))
                values.add(v)
        fps = np.array(sorted(values), np.uint64)
        tree = simhash.Regions(fps[::2].copy(), rng.choice([1, 2, 8, 40]))
        held = {}
        for leaf, part in tree.route(fps, 1 + simhash.popcount(fps) % 2):
            held.setdefault(leaf, []).append(part)
        found = []
        for leaf, parts in held.items():
            a, b = simhash.spanning_links(*simhash.link_in_region(np.concatenate(parts), tree.mask[leaf], tree.value[leaf]))
            found += zip(a.tolist(), b.tolist())
        order = sorted(values)
        pairs = [(a, b) for i, a in enumerate(order) for b in order[:i] if (a ^ b).bit_count() <= 3]
        assert groups(order, found) == groups(order, pairs)


def test_components_of_documents(spark):
    rng = random.Random(10)
    rows = odd_rows(seed=11)
    base = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    for i in range(100, 130):
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(400)] = "edit"
        rows.append((i, " ".join(edited)))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    together = groups(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3])
    smallest = {}
    for group in together:
        ids = [i for (i, _), f in zip(rows, fps) if f in group and i is not None]
        smallest |= {f: min(ids, default=None) for f in group}
    want = sorted(((i, f"{f:016x}", smallest[f]) for (i, _), f in zip(rows, fps)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = simhash.keep_one_each(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by_text = {t or "": f for (_, t), f in zip(rows, fps)}
    stayed = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert len(stayed) == len(together)  # one of each component, with its smallest doc_id
    for group in together:
        (one,) = [i for i, t in stayed if by_text[t] in group]
        assert one == smallest[min(group)]
    assert {(i, t) for i, t in stayed} <= {(i, t or "") for i, t in rows}
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.keep_one_each(documents(spark, [])).collect() == []
