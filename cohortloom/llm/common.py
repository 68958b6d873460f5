"""Helpers shared by the operators: inputs, files in the shared folder, words, tokenizers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortloom.session import shared_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_columns(df: DataFrame) -> list[str]:
    """The columns of `documents` that a table has; extra columns are left behind."""
    return [c for c in DOCUMENT_COLUMNS if c in df.columns]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder address below the shared folder, as a URI that pyarrow understands."""
    root = re.sub(r"^file:/+", "file:///", shared_folder(spark).rstrip("/"))
    return f"{root}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str):
    """File system and path of a folder URI; used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def byte_words(text: str | None) -> list[bytes]:
    """Maximal runs without the six ASCII white-space characters, as UTF-8.

    `bytes.split` splits at exactly space, tab, line feed, vertical tab, form feed and return.
    Lone surrogates cannot come from Spark, whose strings are UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def worker_state(name: str, make):
    """An object that the tasks of a Python worker share. A worker holds one such object: that of
    another operator, which ran before, goes first."""
    import sys
    import types

    holder = sys.modules.setdefault("cohortloom_worker_state", types.ModuleType("cohortloom_worker_state"))
    if not hasattr(holder, name):
        holder.__dict__.clear()
        setattr(holder, name, make())
    return getattr(holder, name)


class TextEncoder:
    """The ids of whole texts by the tokenizers library, as little-endian bytes of fixed width.

    A byte-level tokenizer without normalizer never joins what stands before a white-space run
    with the run, so a text falls into pieces at single spaces whose ids can be looked up again.
    Pieces are encoded by the library once and kept (marks after a letter apart from the word, as
    the tokenizer splits there). A text with a space after white space is encoded as a whole, as is
    every text of a tokenizer of another kind."""

    MAX_KEPT = 600_000  # pieces; beyond that they become the older generation and the last older one goes

    def __init__(self, path: str):
        import json
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made.get("pre_tokenizer") or {}
        self.by_piece = (made.get("normalizer") is None and split.get("type") == "ByteLevel"
                         and split.get("use_regex") and not split.get("add_prefix_space"))
        self.starts = np.zeros(size, dtype=bool)  # ids that begin with a space
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.starts[i] = token.startswith("\u0120")
        self.kept: dict[str, bytes | bool] = {}  # False: the text must be encoded as a whole
        self.older: dict[str, bytes | bool] = {}
        self.marks: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "TextEncoder":
        return worker_state(f"encoder {path}", lambda: cls(path))

    def _plain(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.dtype).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        import numpy as np

        width = np.dtype(self.dtype).itemsize
        groups = [pieces[i:i + 1000] for i in range(0, len(pieces), 1000)]
        found = {}
        for group, raw in zip(groups, self._plain([" " + " ".join(g) for g in groups])):
            at = np.flatnonzero(self.starts[np.frombuffer(raw, self.dtype)])
            if len(at) != len(group):
                raise ValueError("the tokenizer joins pieces across a space")
            at = [*(width * at).tolist(), len(raw)]
            found.update(zip(group, map(raw.__getitem__, map(slice, at, at[1:]))))
        return found

    def _learn(self, pieces: set[str]) -> None:
        kept, older = self.kept, self.older
        again = pieces & older.keys()
        kept.update((p, older[p]) for p in again)
        marked, words = [], set()
        for piece in pieces - again:
            word = piece.rstrip(".,;:!?")
            if not piece or piece[-1].isspace():
                kept[piece] = False
            elif word != piece and word and word[-1].isalpha():
                marked.append((piece, word, piece[len(word):]))
                words.add(word)
            else:
                words.add(piece)
        kept.update(self._encode_pieces([w for w in words if w not in kept]))
        for piece, word, mark in marked:
            if mark not in self.marks:
                self.marks[mark] = self._plain([mark])[0]
            kept[piece] = kept[word] + self.marks[mark]

    def encode(self, texts: list[str | None], chars_at_once: int = 2_000_000):
        """Yields the bytes of each text's ids; null counts as empty."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= chars_at_once):
                chars += len(texts[stop] or "")
                stop += 1
            yield from self._batch([t or "" for t in texts[start:stop]])
            start = stop

    def _batch(self, texts: list[str]):
        if not self.by_piece:
            yield from self._plain(texts)
            return
        parts = [t.split(" ") for t in texts]
        if len(self.kept) > self.MAX_KEPT:
            self.kept, self.older = {}, self.kept
        # One look per piece; the few that are new are learned together and looked up again.
        get, found, new = self.kept.get, [], set()
        for part in parts:
            values = list(map(get, part))
            values[0] = b""
            found.append(values)
            if None in values:
                new.update(p for p, v in zip(part, values) if v is None)
        self._learn(new)
        for text, part, values, head in zip(texts, parts, found, self._plain([p[0] for p in parts])):
            if None in values:
                values = [self.kept[p] if v is None else v for p, v in zip(part, values)]
            try:
                yield head + b"".join(values)
            except TypeError:  # a piece that joins with the next
                yield self._plain([text])[0]
