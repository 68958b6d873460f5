"""Quality rules whose cutoffs are chosen under a guarantee on false rejections.

Every rule is a score of a text, larger for worse texts; a cut is a rule with a cutoff, "reject
where the score is above it". Labelled rows are halved by a hash of their id. On the tuning half
the cuts of a stratum (a language) are put in order, those that hit fewest good texts for the bad
ones they catch first. On the holdout half the growing unions of cuts are tested in that order:
the union is certified while the exact binomial (Clopper-Pearson) test rejects, at level
delta / number of strata, that it turns away more than `alpha` of good texts. The first failure
ends the sequence. Testing in a fixed order needs no further correction within a stratum, and
the division by the number of strata (Bonferroni) covers all of them: with probability
1 - delta or more, no stratum loses more than `alpha` of its good texts to the rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import document_columns
from cohortloom.session import materialise

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ALPHA, DELTA = 0.02, 0.05
# Insults whose share of the words is one of the scores.
LISTED = ("asshole bastard bitch clown coward degenerate despicable disgusting dumbass filth fool garbage "
          "hateful idiot imbecile jerk loathsome loser lowlife moron pathetic pig scum stupid trash ugly "
          "vermin vile worthless").split()
_SHARES = [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02]
# Each rule with its cutoffs from loose to strict.
RULES = {
    "symbols_per_word": [2.0, 1.5, *_SHARES],
    "repeated_words": _SHARES,
    "duplicate_lines": _SHARES,
    "upper_case": _SHARES,
    "marks": _SHARES,  # ASCII punctuation among the characters of words
    "exclamations_per_word": _SHARES,
    "digits": _SHARES,
    "long_words": [14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5, 7.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0],  # the negative mean length
    "listed_words": [0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0],
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, scores array<double>"


def repeated_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """How many words lie in windows of `size` words that occur twice or more. Windows get exact
    ranks by doubling: the rank of 2m words is that of the pair of ranks of m words."""
    if len(words) <= size:
        return 0
    known: dict[bytes, int] = {}
    ranks = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == len(words):
        return 0
    span, counts = 1, None
    while span < size:
        pairs = ranks[:-span] * (ranks.max() + 1) + ranks[span:]
        _, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        span *= 2
    again = np.flatnonzero(counts[ranks] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure_text(text: str | None) -> tuple:
    """The values of MEASURES for one text; null counts as empty, whose scores are 0."""
    import re
    import string

    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, [0.0] * len(RULES)
    text = text or ""
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen, lines, again = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            again += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    without = lambda kind: len(raw) - len(raw.translate(None, kind.encode()))
    listed = len(re.findall(rb"\b(?:%s)\b" % "|".join(LISTED).encode(), raw.lower()))
    mean = chars / n
    scores = [symbols / n, repeats / n, again / lines, without(string.ascii_uppercase) / chars,
              without(string.punctuation) / chars, raw.count(b"!") / n, without(string.digits) / chars, mean, -mean,
              listed / n]
    return n, chars, symbols, again, repeats, scores


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the measures of the text."""

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            values = list(zip(*(measure_text(t.as_py()) for t in batch.column(at)))) or [[]] * 6
            new = [pa.array(v, pa.int64()) for v in values[:5]] + [pa.array(values[5], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + new,
                                             [*keep, *(m.split()[0] for m in MEASURES.split(", "))])

    columns = list(dict.fromkeys([*keep, "text"]))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), MEASURES])
    measured = docs.select(*columns).mapInArrow(compute, schema)
    return measured.withColumn("base_failed", F.expr(
        f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable: the exact test of "the rate is above p"."""
    from math import exp, lgamma, log

    if n == 0:
        return 1.0
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, exp(top) * sum(exp(x - top) for x in logs))


def certified_cuts(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
                   delta: float = DELTA) -> DataFrame:
    """(stratum, cuts): the certified cuts of each stratum, an array of (rule, cutoff, rank).

    `measured` has doc_id, the stratum column and the measures; `labels` doc_id, quality, toxic. A
    row is good if its quality is 1 and it is not toxic, bad if its quality is 0 or it is toxic;
    conflicting labels of an id count as bad, rows without id or label are left out. Texts that
    fail the base rules take no part. A null stratum is a stratum of its own. A stratum with too few
    good labels gets no cut."""
    label = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
             .selectExpr("doc_id", "case when quality = 0 or toxic = 1 then 0 when quality = 1 then 1 end as good")
             .filter("good is not null"))
    rows = materialise(
        measured.filter(~F.col("base_failed")).join(label, "doc_id")
        .select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "good", "scores",
                (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("holdout")), "labelled")
    grid = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(float(c)).alias("cutoff"))
                     for i, cuts in enumerate(RULES.values()) for c in cuts))
    hit = F.filter(grid, lambda c: F.col("scores")[c["rule"]] > c["cutoff"])
    tuning = rows.filter(~F.col("holdout"))
    goods = tuning.groupBy("stratum").agg(F.sum("good").alias("all_good"))
    tuned = (tuning.select("stratum", "good", F.explode(hit).alias("c")).groupBy("stratum", "c.rule", "c.cutoff")
             .agg(F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad")))
    order = Window.partitionBy("stratum").orderBy(F.expr("n_good / n_bad"), F.desc("n_bad"), "rule", F.desc("cutoff"))
    ranked = materialise(
        tuned.join(goods, "stratum").filter(F.expr(f"n_bad > 0 and n_good <= {alpha} * all_good"))
        .select("stratum", F.struct("rule", "cutoff", F.row_number().over(order).alias("rank")).alias("cut"))
        .groupBy("stratum").agg(F.sort_array(F.collect_list("cut")).alias("cuts")), "cuts")  # at most the grid
    first = F.array_min(F.transform(violated(F.col("scores"), F.col("cuts")), lambda c: c["rank"]))
    counts = (rows.filter("holdout and good = 1").join(ranked, "stratum")
              .select("stratum", F.coalesce(first, F.lit(1 << 30)).alias("rank")).groupBy("stratum", "rank").count())
    n_strata = max(1, ranked.count())

    def certify(table):
        import pandas as pd

        table = table.sort_values("rank")
        n = int(table["count"].sum())
        lost, steps = 0, table[table["rank"] < 1 << 30]
        limit = 1 << 29  # every cut, if no step fails
        for rank, count in zip(steps["rank"], steps["count"]):
            lost += int(count)
            if binomial_tail(lost, n, alpha) > delta / n_strata:
                limit = int(rank) - 1
                break
        if binomial_tail(0, n, alpha) > delta / n_strata:
            limit = 0
        return pd.DataFrame({"stratum": [table["stratum"].iloc[0]], "certified": [limit]})

    limits = counts.groupBy("stratum").applyInPandas(certify, "stratum string, certified long")
    return materialise(
        ranked.join(limits, "stratum")
        .select("stratum", F.expr("filter(cuts, c -> c.rank <= certified)").alias("cuts")), "certified")


def violated(scores, cuts):
    return F.filter(cuts, lambda c: scores[c["rule"]] > c["cutoff"])


def verdict(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """`measured` with `kept`: neither the base rules nor a certified cut of the stratum fails."""
    key = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    cuts = cuts.select(F.col("stratum").alias("_stratum"), F.col("cuts").alias("_cuts"))
    fails = F.coalesce(F.size(violated(F.col("scores"), F.col("_cuts"))) > 0, F.lit(False))
    return (measured.join(cuts, key == F.col("_stratum"), "left")
            .withColumn("kept", ~F.col("base_failed") & ~fails).drop("_stratum", "_cuts"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row.

    Null and empty texts have no words and fail; repeated rows and null ids keep a row each; other
    columns are left behind; empty labels certify nothing, so only the base rules count; an empty table
    gives no row. What the base rules turn away is outside the guarantee on good texts, which holds for
    the certified cutoffs."""
    rows = materialise(measure(with_lang(docs), ["doc_id", "lang"]), "measures")
    return verdict(rows, certified_cuts(rows, labels)).drop("lang", "scores")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with the columns of documents.

    Texts are measured twice, once for the cuts and once to decide, so that they are not shuffled.
    Null and empty texts go; repeated rows are judged alike; extra columns are left behind; an empty
    table gives no row."""
    docs = with_lang(docs)
    columns = document_columns(docs)
    cuts = certified_cuts(materialise(measure(docs, ["doc_id", "lang"]), "measures"), labels)
    return verdict(measure(docs, columns), cuts).filter("kept").select(*columns)


def with_lang(docs: DataFrame) -> DataFrame:
    docs = docs.select(*document_columns(docs))
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
