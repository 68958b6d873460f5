"""Packing, token counts and token files against plain computations."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortloom.llm import packing, token_counts, token_shards
from cohortloom.llm.common import TextEncoder

from .helpers import documents, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_the_library_on_odd_text(monkeypatch):
    monkeypatch.setattr(TextEncoder, "MAX_KEPT", 100)
    encoder, rng = TextEncoder(PATH), random.Random(2)
    parts = ["a", "'s", "!", ".", " ", "  ", "\n", "\t", "é", "1", "\xa0", "\x1c", "?!", "<|endoftext|>", "𝔸", "\r\n", "Word,"]
    for _ in range(1500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3)]
        assert list(encoder.encode(texts)) == encoder._plain(texts)


def test_elias_fano_selects():
    rng = np.random.default_rng(3)
    for n in (1, 2, 255, 256, 257, 3000):
        values = np.sort(rng.integers(0, 10 ** rng.integers(1, 12), n).astype(np.uint64))
        coded = token_shards.EliasFano(token_shards.ef_encode(values))
        assert (coded.values(0, n) == values).all()
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (coded.values(a, b) == values[a:b]).all()
        assert coded.select(n - 1) == values[-1]
    dense = np.arange(0, 300_000, 3, dtype=np.uint64)
    assert len(token_shards.ef_encode(dense)) < len(dense)  # under 8 bits a value


def test_token_files_round_trip(spark, tokenizer):
    rows = odd_rows()
    manifest = token_shards.write_shards(documents(spark, rows), PATH)
    got = token_shards.read_shards(manifest, with_ids=True, ids_at_once=500).orderBy("start").collect()
    assert len(got) == len(rows)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((i, len(x := ids_of(tokenizer, t)), zlib.crc32(x.tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in got)


def test_token_files_of_an_empty_table(spark):
    assert token_shards.read_shards(token_shards.write_shards(documents(spark, []), PATH)).collect() == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_packing_holds_every_id_once(spark, tokenizer, partitions):
    rows = [(i, t) for i, t in dict(odd_rows()).items()]
    got = packing.pack(documents(spark, rows).repartition(partitions), PATH).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    assert of_doc.keys() == {i for i, _ in rows}
    for doc_id, text in rows:
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(of_doc[doc_id], key=lambda r: r.start):
            piece = ids[at:at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece.tobytes()))
            assert (np.frombuffer(r.ids, "<u2") == piece).all()
            at += r.length
        assert at == len(ids)
    for pieces in of_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_packing_repeated_rows_and_empty_table(spark, tokenizer):
    rows = [(1, "a b c")] * 5 + [(None, None)] * 2
    got = packing.pack(documents(spark, rows), PATH).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(tokenizer, t)) for _, t in rows)
    assert packing.pack(documents(spark, []), PATH).collect() == []


def test_little_padding_for_short_and_mixed_texts(spark):
    """Sequences against the fewest that can hold the tokens; each worker's rests are shared in the end."""
    rng = random.Random(9)
    for texts, spare in ((["" for _ in range(3000)], 1), ([" a b c" for _ in range(3000)], 1), ([" a" * 11 for _ in range(3000)], 1),
                         ([" a" * rng.randint(0, 900) for _ in range(1500)], 15)):
        got = packing.pack(documents(spark, list(enumerate(texts))).repartition(4), PATH, with_ids=False)
        assert "ids" not in got.columns
        tokens, used = sum(r.length for r in got.collect()), len({r.sequence_id for r in got.collect()})
        assert used <= -(-tokens // 1024) + spare + 0.02 * tokens / 1024, (tokens / 1024, used)


def test_cut_lengths_fill_their_slots():
    for length in range(1, 3000):
        pieces = packing.cut_lengths(length, 1024)
        assert sum(n for n, _ in pieces) == length
        for n, count in pieces:
            assert n * count <= 1024 and (n <= 16 or n >= (1 - 1 / 32) * (1024 // count))


def greedy(word, starting, continuing):
    n = at = 0
    longest = max(map(len, starting | continuing), default=0)
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in (continuing if at else starting):
                break
        else:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(4)
    piece = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4)))
    for _ in range(300):
        starting, continuing = {piece() for _ in range(4)}, {piece() for _ in range(4)}
        automaton = token_counts.LongestMatch(starting, continuing)
        for _ in range(20):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
            assert automaton.count(word) == greedy(word, starting, continuing)


def test_token_counts(spark):
    starting, continuing = token_counts.byte_vocabulary(PATH)
    rows = odd_rows(n=10)
    got = Counter(tuple(r) for r in token_counts.count_tokens(documents(spark, rows), PATH).collect())
    want = Counter()
    for i, t in rows:
        words = (t or "").encode().split()
        want[i, len(words), sum(greedy(b" " + w, starting, continuing) for w in words)] += 1
    assert got == want
    assert token_counts.count_tokens(documents(spark, []), PATH).collect() == []
