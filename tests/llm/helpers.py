"""Rows with nulls, empty, long and repeated texts and clashing extra columns."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, key long, position long, scores string, "
           "kept boolean, batch long, sequence_id string, fingerprint long, node long, votes int")


def documents(spark, rows):
    """A table of documents with extra columns; rows are (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 7, None, "x", True, 1, "s", 5, None, 3) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


def odd_rows(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = [f"wo{i}rd" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "\n\t "), (None, "no id here"), (None, None), (3, rows[3][1]),
             (5, "other text of five"), (n + 3, "x " * 30_000), (n + 4, "\x1c odd\xa0space é ñ 𝔸 <|endoftext|>  !!")]
    return rows + rows[:3]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
