"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or not at all on every text. Their accuracies are not known:
expectation-maximisation over the counts of vote patterns estimates how often each labeller is
right on good and on bad texts (the votes taken as independent given the class) and with that the
posterior of each pattern. The posteriors of a bounded sample of texts then train a linear scorer
over hashed byte trigrams, by gradient steps computed in the tasks. Every text is scored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.quality_rules import RULES, measure_text
from cohortloom.session import materialise

TRAIN_ROWS = 20_000  # texts in the sample that the scorer learns from, about
BUCKETS = 1 << 15
STEPS = 60
SCALE = 50.0  # of the mean trigram weight
BAD, NONE, GOOD = 0, 1, 2


def trigram_buckets(text: str | None) -> np.ndarray:
    """Hashed buckets of the byte trigrams, repeats included."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    joined = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return ((joined * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def votes(text: str | None) -> list[int]:
    """The vote of each labeller."""
    n, _, _, _, _, scores = measure_text(text)
    s = dict(zip(RULES, scores))
    pick = lambda bad, good: BAD if bad else GOOD if good else NONE
    if not n:
        return [BAD if name == "length" else NONE for name in LABELLERS]
    return [
        pick(s["symbols_per_word"] > 0.2, s["symbols_per_word"] <= 0.02),
        pick(s["repeated_words"] > 0.4, s["repeated_words"] < 0.1 and n >= 50),
        pick(s["duplicate_lines"] > 0.4, True),
        pick(s["upper_case"] > 0.3, s["upper_case"] < 0.08),
        pick(s["marks"] > 0.1 or n >= 30 and s["marks"] == 0, 0.004 < s["marks"] < 0.06),
        pick(s["exclamations_per_word"] > 0.3, True),
        pick(s["long_words"] > 7.5 or s["long_words"] < 3, 3.5 < s["long_words"] < 6.6),
        pick(n < 3, n >= 40),
        pick(s["repeated_words"] > 0.8, s["repeated_words"] < 0.5),
    ]


LABELLERS = ["symbols", "repeats", "lines", "case", "marks", "exclamations", "word length", "length",
             "mostly repeats"]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, table [class, labeller, bad or good], posterior of good for each pattern).

    A labeller that abstains says nothing about the class. The start is the majority of votes, so that class 1 is the good one."""
    lead = (patterns == GOOD).sum(axis=1) - 3.0 * (patterns == BAD).sum(axis=1)
    good = 1 / (1 + np.exp(-lead))
    one_hot = (patterns[:, :, None] == np.array([BAD, GOOD])).astype(float)
    share, table = 0.5, np.zeros((2, patterns.shape[1], 2))
    for _ in range(rounds):
        weights = np.stack([counts * (1 - good), counts * good])
        share = float((weights[1].sum() + 1) / (counts.sum() + 2))
        table = np.einsum("cp,plv->clv", weights, one_hot) + 1.0  # one vote of each kind added
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->cp", one_hot, np.log(table)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        moved = np.abs(new - good).max(initial=0)
        good = new
        if moved < 1e-9:
            break
    return share, table, good


def pattern_of(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3 ** i % 3 for i in range(len(LABELLERS))], axis=1)


def voted(docs: DataFrame) -> DataFrame:
    """doc_id and the votes as one number, labeller i in digit i to base 3."""

    def run(batches):
        import pyarrow as pa

        place = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            codes = [int((np.array(votes(t.as_py())) * place).sum()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32())], ["doc_id", "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes int")


def train(docs: DataFrame, posterior: np.ndarray, n: int, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the buckets and, last, the bias. The sample holds distinct texts, taken by a hash:
    as large a share of them as `train_rows` is of n rows."""
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, train_rows / max(1, n)) * (1 << 30))

    def features(batches):
        import pyarrow as pa

        place = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            rows = []
            for text in batch.column(0):
                at, counts = np.unique(trigram_buckets(text.as_py()), return_counts=True)
                code = int((np.array(votes(text.as_py())) * place).sum())
                rows.append((at.astype(np.int32).tolist(), (counts / max(1, counts.sum())).astype(np.float32).tolist(),
                             float(posterior[code])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), [pa.list_(pa.int32()), pa.list_(pa.float32()), pa.float64()])],
                    ["at", "x", "y"])

    sample = materialise(docs.select("text").filter(share).distinct()  # copies count once, so no group fills the sample
                         .mapInArrow(features, "at array<int>, x array<float>, y double"), "weak-sample").coalesce(8)

    def gradient(weights):
        def run(batches):
            import pyarrow as pa

            total, rows = np.zeros(BUCKETS + 1), 0
            for batch in batches:
                lists = batch.column(0)
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                at, x = lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy().astype(float) * SCALE
                logit = np.bincount(row, weights[at] * x, minlength=batch.num_rows) + weights[-1]
                y = batch.column(2).to_numpy()
                wrong = 1 / (1 + np.exp(-logit)) - y
                total[:-1] += np.bincount(at, wrong[row] * x, minlength=BUCKETS)
                total[-1] += wrong.sum()
                rows += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([rows])], ["total", "n"])
        return run

    weights, mean, square = np.zeros(BUCKETS + 1), 0.0, 0.0
    for step in range(1, STEPS + 1):  # Adam, on the whole sample
        parts = sample.mapInArrow(gradient(weights), "total binary, n long").collect()  # 8 at most
        rows = max(1, sum(p["n"] for p in parts))
        slope = sum((np.frombuffer(p["total"]) for p in parts), np.zeros(BUCKETS + 1)) / rows
        slope[:-1] += 1e-4 * weights[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        weights -= 0.2 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6)
    return weights


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, votes (names of the labellers that voted bad), posterior, score and kept of every row:
    posterior is the labellers' probability of a good text, score the scorer's, and a text is kept
    if the sum of their log odds, each within 6, is positive.

    A text without words (null, empty) is bad by its length and never kept; repeated rows, null and equal ids
    keep a row each; other columns are left behind; an empty table gives no row."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    counts = (voted(docs).groupBy("votes").agg(F.count("*").alias("n")).toArrow())  # 3 ** labellers rows at most
    codes, n = counts["votes"].to_numpy(), counts["n"].to_numpy()
    _, _, good = estimate(pattern_of(codes), n.astype(float))
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    posterior[codes] = good
    weights = train(docs, posterior, int(n.sum()), train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((weights, posterior))

    def run(batches):
        import pyarrow as pa

        weights, posterior = shared.value
        place = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            bad, sure, score, filled = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                vote = np.array(votes(text))
                at = trigram_buckets(text)
                logit = SCALE * float(weights[at].mean()) if len(at) else 0.0
                filled.append(bool(text and text.strip(" \t\n\v\f\r")))
                bad.append([name for name, v in zip(LABELLERS, vote) if v == BAD])
                sure.append(float(posterior[int((vote * place).sum())]))
                score.append(float(1 / (1 + np.exp(-np.clip(logit + weights[-1], -500, 500)))))
            odds = [np.clip(np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9))), -6, 6)
                    for p in (np.array(sure), np.array(score))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bad, pa.list_(pa.string())), pa.array(sure, pa.float64()),
                 pa.array(score, pa.float64()), pa.array(((odds[0] + odds[1] > 0) & np.array(filled, bool)).tolist(), pa.bool_())],
                ["doc_id", "votes", "posterior", "score", "kept"])

    return docs.mapInArrow(run, "doc_id long, votes array<string>, posterior double, score double, kept boolean")
