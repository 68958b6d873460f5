"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word (marked by a leading space) and
pieces that continue one. Each node has a failure link to the node that stands for what is left
after the longest pieces are taken from its path, and the precomputed number of pieces taken on
the way. A word is then read once, byte by byte: where no edge fits, the count of the link is
added and the link followed. No piece is ever built."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from cohortloom.llm.common import byte_words, worker_state

UNKNOWN = 1  # pieces of a word that the vocabulary cannot spell


class LongestMatch:
    """`count(word)`: the number of greedy longest-match pieces of a word."""

    def __init__(self, starting: set[bytes], continuing: set[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # 0: root of starting pieces, 1: of continuing ones
        ends = set()
        for root, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                node = root
                for byte in piece:
                    step = self.edges[node]
                    if byte not in step:
                        step[byte] = len(self.edges)
                        self.edges.append({})
                    node = step[byte]
                if piece:
                    ends.add(node)
        n = len(self.edges)
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:  # a node's link needs those of shorter paths only
            parent = queue.popleft()
            for byte, node in self.edges[parent].items():
                if node in ends:
                    self.link[node], self.popped[node] = 1, 1
                else:
                    at, taken = self.link[parent], self.popped[parent]
                    while at >= 0 and byte not in self.edges[at]:
                        taken += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.edges[at][byte], taken
                queue.append(node)

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = taken = 0
        for byte in word:
            while byte not in edges[node]:
                taken += popped[node]
                node = link[node]
                if node < 0:
                    return UNKNOWN
            node = edges[node][byte]
        while node != 1:
            taken += popped[node]
            node = link[node]
            if node < 0:
                return UNKNOWN if word else 0
        return taken


def byte_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces that start a word (with the leading space) and pieces that continue one, from the
    file of a byte-level tokenizer."""
    from tokenizers import Tokenizer

    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    tokens = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    pieces = {bytes(byte_of[c] for c in token) for token in tokens}
    return {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}


class WordLengths(dict):
    """Lengths of words met before; the automaton gives those of new ones."""

    MAX_KEPT = 500_000

    def __init__(self, path: str):
        super().__init__()
        self.automaton = LongestMatch(*byte_vocabulary(path))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MAX_KEPT:
            self.clear()
        self[word] = n = self.automaton.count(b" " + word)
        return n


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens (greedy word pieces) of each row's whole text.

    Words are runs without ASCII white space, each marked by a leading space. Null and empty texts
    have 0 of both; repeated rows, null ids and equal ids keep a row each; other columns are left
    behind; an empty table gives no row."""

    def count(batches):
        import pyarrow as pa

        lengths = worker_state(f"lengths {vocabulary_path}", lambda: WordLengths(vocabulary_path))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = byte_words(text.as_py())
                words.append(len(found))
                tokens.append(sum(map(lengths.__getitem__, found)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(words, pa.int64()),
                                              "n_tokens": pa.array(tokens, pa.int64())})

    return (docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
            .mapInArrow(count, "doc_id long, n_words long, n_tokens long"))
