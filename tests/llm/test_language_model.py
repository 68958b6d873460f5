"""The Pitman-Yor model: counts against plain ones, proper probabilities, held-out gain."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np

from cohortloom.llm import language_model as L

from .helpers import WORDS, documents, lower, odd_rows


def topic_rows(n=600, seed=15):
    """Texts in which a word is mostly followed by one of a few."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, w = [], rng.randint(0, 29)
        for _ in range(rng.randint(5, 60)):
            words.append(f"Word{w}")
            w = (3 * w + rng.randint(0, 2)) % 30 if rng.random() < 0.9 else rng.randint(0, 400)
        rows.append((i, " ".join(words)))
    return rows


def check_counts(rows, got):
    texts = Counter((i, t or "") for i, t in rows)
    words = lambda t: [*WORDS.findall(lower(t)), " "]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    counts = Counter()
    for (i, t), times in texts.items():
        if train(i):
            counts.update({w: times * c for w, c in Counter(words(t)).items()})
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))
    order = lambda r: (*map(str, r[:5]), r[5])
    want = sorted(((i, not train(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, base(t))
                   for (i, t), times in texts.items() for _ in range(times)), key=order)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=order)
    assert [r[:5] for r in have] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in have], [r[5] for r in want], rtol=1e-7, atol=1e-5)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_counts_and_base(spark):
    rows = odd_rows()
    check_counts(rows, L.score_documents(documents(spark, rows)).collect())
    assert L.score_documents(documents(spark, [])).collect() == []


def test_held_out_texts_are_predicted_better_than_by_the_base(spark):
    rows = topic_rows()
    got = L.score_documents(documents(spark, rows).repartition(5), hot=8).collect()
    check_counts(rows, got)
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.3
    # Hot or dealt, in few partitions or many: the scores are the same.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for hot, partitions in ((200, before), (2, "50"), (1000, "3")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        again = {r.doc_id: r.score for r in L.score_documents(documents(spark, rows).repartition(2), hot=hot).collect()}
        assert max(abs(again[r.doc_id] - r.score) for r in got) < 1e-3
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(16)
    word = np.repeat(np.arange(40), 3)
    context = np.tile([0, 5, 9], 40)
    seating = L.Seating(np.arange(40), word, context, rng.integers(1, 60, 120))
    customers = np.bincount(context, seating.customers, minlength=L.CONTEXTS).astype(float)
    model = L.Model(customers, int(customers.sum()), 40, 0.7, 0.6)
    totals = L.Totals(*seating.totals())
    for n in range(4):
        seating.sweep(model, totals, n)
        totals = L.Totals(*seating.totals())
        assert (1 <= seating.tables).all() and (seating.tables <= seating.customers).all()
        unknown = L.parent_probability(model, totals, np.zeros(1), np.zeros(1))[0]
        for c in (0, 5, 9, 77):
            pair = np.full(40, -1)
            at = context == c
            pair[word[at]] = np.flatnonzero(at)
            p = seating.probability(model, totals, np.arange(40), np.full(40, c), pair)
            fresh = (L.STRENGTH + model.discount * totals.tables[c]) / (L.STRENGTH + customers[c])
            assert abs(p.sum() + fresh * unknown - 1) < 1e-9


def test_seating_draws_the_expected_number_of_tables():
    rng = np.random.default_rng(17)
    customers, new, d = np.full(4000, 200), np.full(4000, 2.0), 0.4
    expected = 1.0
    for i in range(1, 200):
        expected += (new[0]) / (new[0] + i - d * expected)
    assert abs(L.seat(customers, new, d, rng.integers(0, 1 << 62, 4000), 0).mean() - expected) < 0.3


def test_draws_have_their_distribution():
    keys = np.arange(200_000, dtype=np.uint64)
    u = L.uniform(keys, 7)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.003 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01
    assert np.abs(np.corrcoef(L.uniform(keys, 8), u)[0, 1]) < 0.01
    z = L.normal_quantile(np.array([1e-6, 0.025, 0.5, 0.975, 0.999]))
    assert np.allclose(z, [-4.753424, -1.959964, 0, 1.959964, 3.090232], atol=1e-3)
    for n, p in ((1, 0.3), (5, 0.9), (40, 0.02), (200, 0.5), (3000, 0.001), (5000, 0.97), (7, 0.0), (9, 1.0)):
        drawn = L.binomial(np.full(len(u), n), np.full(len(u), p), u)
        assert (0 <= drawn).all() and (drawn <= n).all()
        assert abs(drawn.mean() - n * p) < 0.02 * max(1, n * p * (1 - p)) ** 0.5
        assert abs(drawn.var() - n * p * (1 - p)) < 0.03 * max(0.5, n * p * (1 - p))


def plain_tables(customers, new, discount, rng):
    """One customer after the other, one draw each."""
    tables = 1
    for i in range(1, customers):
        tables += rng.random() < new / (new + i - discount * tables)
    return tables


def test_seating_against_plain_seating():
    """Mean and spread of the tables, for restaurants seated singly and in groups."""
    rng = random.Random(3)
    for customers, new, d in ((4, 0.5, 0.8), (31, 3.0, 0.5), (150, 2.0, 0.7), (600, 30.0, 0.9)):
        plain = np.array([plain_tables(customers, new, d, rng) for _ in range(1500)])
        drawn = L.seat(np.full(6000, customers), np.full(6000, new), d, np.arange(6000), 3)
        assert abs(plain.mean() - drawn.mean()) < 4 * plain.std() / 1500 ** 0.5 + 0.02 * plain.mean()
        assert 0.85 < (drawn.std() + 0.05) / (plain.std() + 0.05) < 1.18


def test_contexts_depend_on_the_texts_alone(spark):
    # A word gathered in few rows, with a share just over the least one.
    rows = [(i, " ".join(f"w{(7 * i + k) % 2000}" for k in range(40))) for i in range(900)]
    rows += [(i, "gathered " * 10 + "x") for i in range(900, 912)]
    rows = [r for r in rows if L.is_train(r[0])]
    lists = set()
    for parts in (1, 7):
        for hot in (8, 256, 1000):
            docs = documents(spark, rows).selectExpr("doc_id", "text").repartition(parts)
            lists.add(tuple(L.hot_words(docs, hot)[1]))
    counts = Counter(w for _, t in rows for w in L.tokens(t))
    want = [w for w, n in sorted(counts.items(), key=lambda c: (-c[1], c[0])) if 512 * n >= counts.total() and w != L.END]
    assert b"gathered" in want and lists == {(L.END, *want)}


def test_parts_of_a_chunk_hold_whole_words_and_few_tokens(monkeypatch):
    rng = np.random.default_rng(18)
    sizes = rng.integers(1, 40, 300)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint32)
    before = np.concatenate([np.sort(rng.integers(0, 6, n)) for n in sizes]).astype(np.uint16)
    before[rng.random(len(before)) < 0.8] |= np.uint16(L.TRAIN_BIT)
    doc, keys = rng.integers(0, 90, len(before)).astype(np.uint32), rng.integers(0, 1 << 62, 300).astype(np.uint64)
    payload = L.pack(starts, before, doc, keys)

    def scored():
        parts = list(L.parts_of(payload))
        model = L.Model(np.full(L.CONTEXTS, 700.0), int(sizes.sum()), 300, 0.6, 0.5)
        model.sweeps = [L.Totals(np.full(L.CONTEXTS, 90.0 + n), 300.0) for n in range(L.BURN_IN + L.SAMPLES + 1)]
        logs = [L.averaged(c.seating, model, c.word, c.context, c.pair) for c in parts]
        return [len(c.doc) for c in parts], sum(c.words for c in parts), np.concatenate([c.doc for c in parts]), np.concatenate(logs)

    whole = scored()
    monkeypatch.setattr(L, "WORK_TOKENS", 500)
    cut = scored()
    assert len(whole[0]) == 1 and len(cut[0]) > 5 and max(cut[0]) < 500 + 40 and whole[1] == cut[1] == 300
    assert (whole[2] == doc).all() and (cut[2] == doc).all() and (whole[3] == cut[3]).all()


def plain_scores(rows, own):
    """The whole model word by word in dictionaries, with the same draws."""
    import xxhash

    hashed = lambda w: xxhash.xxh64_intdigest(w)
    places = {w: i for i, w in enumerate(own)}
    texts = [(i, L.tokens(t)) for i, t in rows]
    follow = lambda words: zip([None, *words], words)
    class_of = lambda u: 0 if u is None else L.context_of(u, places.get(u))
    count = Counter(p for i, words in texts if L.is_train(i) for p in follow(words))
    seen, n = Counter(), sum(count.values())
    for (_, w), c in count.items():
        seen[w] += c
    word_key = {w: L.mixed(L.SEED, np.uint32(hashed(w) & 0xFFFFFFFF)) for w in seen}
    row_key = {(u, w): L.mixed(word_key[w], np.uint32(0 if u is None else hashed(u) >> 16 & 0xFFFFFFFF), 3) for u, w in count}
    table = {p: 1 for p in count}
    dish, seats, root, root_seats = Counter(), {}, Counter(), {w: 1 for w in seen}

    def gather():
        dish.clear(), root.clear()
        for (u, w), t in table.items():
            dish[class_of(u), w] += t
        for key in dish:
            root[key[1]] += seats.setdefault(key, 1)

    gather()
    discounts = []
    for counts in (count, dish, root):
        a, b = (sum(c == k for c in counts.values()) for k in (1, 2))
        discounts.append(min(max(a / (a + 2 * b), 0.1), 0.95) if a + b else 0.5)
    d, e, f = discounts
    customers, sums = Counter(), {}
    for (u, _), c in count.items():
        customers[u] += c
    scores = Counter()
    for number in range(-1, L.BURN_IN + L.SAMPLES):
        if number >= 0:
            above, inner = sums["root"], sums["dish"]
            for (u, w), c in count.items():
                table[u, w] = int(L.seat(np.array([c]), np.array([1 + d * sums["before"][u]]) * inner(class_of(u), w), d, row_key[u, w], number)[0])
            dish.clear()
            for (u, w), t in table.items():
                dish[class_of(u), w] += t
            for (k, w), c in dish.items():
                key = L.mixed(L.SEED, np.uint32(hashed(w) & 0xFFFFFFFF), k + 1)
                seats[k, w] = int(L.seat(np.array([c]), np.array([1 + e * sums["class"][k]]) * above(w), e, key, number)[0])
            gather()
            for w, c in root.items():
                root_seats[w] = int(L.seat(np.array([c]), np.array([sums["fresh"]]), f, word_key[w], number)[0])
        before, by_class, by_customers = Counter(), Counter(), Counter()
        for (u, _), t in table.items():
            before[u] += t
        for (k, w), t in seats.items():
            by_class[k] += t
            by_customers[k] += dish[k, w]
        fresh = (1 + f * sum(root_seats.values())) / (len(seen) + 1)
        below, held, guests = 1 + sum(root.values()), dict(root_seats), dict(root)
        of_root = lambda w, g=guests, h=held, x=fresh, s=below: (g.get(w, 0) - f * h.get(w, 0) + x) / s
        y, z = dict(dish), dict(seats)
        of_class = lambda k, w, y=y, z=z, t=by_class, c=by_customers, r=of_root: (
            (y.get((k, w), 0) - e * z.get((k, w), 0) + (1 + e * t[k]) * r(w)) / (1 + c[k]))
        sums = {"before": before, "class": by_class, "root": of_root, "dish": of_class, "fresh": fresh * (len(seen) + 1) / (len(seen) + 1)}
        if number >= L.BURN_IN:
            for p in {p for _, words in texts for p in follow(words)}:
                u, w = p
                scores[p] += (count[p] - d * table.get(p, 0) + (1 + d * before[u]) * of_class(class_of(u), w)) / (1 + customers[u])
    return {i: sum(math.log10(scores[p] / L.SAMPLES) for p in follow(words)) for i, words in texts}


def test_scores_against_a_plain_seating(spark):
    rows = topic_rows(150, seed=21) + [(900, None), (901, "Word3"), (902, "never seen words"), (903, "x " * 400)]
    docs = documents(spark, rows)
    want = plain_scores(rows, L.hot_words(docs.selectExpr("doc_id", "text"), 8)[1])
    for hot in (4, 500):
        got = {r.doc_id: r.score for r in L.score_documents(docs.repartition(3), hot=hot).collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[i] - want[i]) for i in want) < 2e-3


def test_every_word_before_has_its_own_restaurant(spark):
    """Rare words that share their ending, so their class: each is followed by a word of its own."""
    rng = random.Random(22)
    pairs = [i for i in range(700) for _ in range(8)]
    rng.shuffle(pairs)
    learned = [i for i in range(400) if L.is_train(i)]
    rows = [(i, " ".join(f"p{k}xyz s{k}" for k in pairs[28 * n:28 * n + 28])) for n, i in enumerate(learned[:200])]
    held = [i for i in range(1000, 1600) if not L.is_train(i)][:40]
    rows += [(i, f"p{n}xyz s{n if n < 20 else n + 1}") for n, i in enumerate(held)]
    got = {r.doc_id: r.score for r in L.score_documents(documents(spark, rows)).collect()}
    right, wrong = ([got[i] for i in ids] for ids in (held[:20], held[20:]))
    assert min(right) > max(wrong) + 1


def test_counting_words_leaves_no_shuffled_words_on_disk(spark):
    rows = [(i, " ".join(f"word{40 * i + k}" for k in range(40))) for i in range(1500) if L.is_train(i)]
    docs = documents(spark, rows).selectExpr("doc_id", "text").cache()
    docs.count()

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = (files.apply(i) for i in range(files.size()))
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    before = shuffled()
    L.hot_words(docs, 8)
    left = lambda: sum(n for name, n in shuffled().items() if name not in before)
    until = time.time() + 20
    while left() > 50_000 and time.time() < until:  # of some 60,000 words; removed in the background
        time.sleep(0.2)
    assert left() <= 50_000


def test_texts_of_a_batch_are_written_once_and_not_shuffled(spark):
    rows = [(i, " ".join(f"w{(7 * i + k) % 900}" for k in range(50))) for i in range(400)]
    docs = documents(spark, rows).selectExpr("doc_id", "text").coalesce(2)
    sent = [bytes(r.payload) for r in L.deal(docs, [L.END], [L.END], 4).filter("bucket = -1").collect()]
    assert sent and max(map(len, sent)) < 400
    assert sorted(np.concatenate([L.unpack(L.fetch(p))[0] for p in sent])) == [i for i, _ in rows]
