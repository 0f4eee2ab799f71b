"""Quality rules: document statistics and a decision list learned from labelled rows.

The list is learned by sequential covering: a rule is grown on two thirds of the rows that no
earlier rule covers, one threshold condition at a time by information gain, then pruned on the
other third while that doesn't lower its worth, and it is kept if it is right often enough.  The
list becomes one ordered Spark conditional expression; a document that no rule rejects is kept.

Only the learning sample leaves Spark: at most ``SAMPLE`` labelled rows, taken by a hash of the id,
as a few numbers each.  Statistics and verdicts cover every whole text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudent.llm.common import BROADCAST_IDS, fraction_of

SAMPLE, SEED = 20_000, 11
#: least share of rightly rejected rows of a rule on the pruning rows, and least rows it covers there
PRECISION, COVER, MAX_CONDITIONS = 0.9, 3, 4

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_LETTERS = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "letter_share", "digit_share", "upper_share",
            "distinct_share", "words_per_line", "stops_per_word", "longest_word", "top_word_share", "n_words_f"]


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.unique(np.array(words, object), return_inverse=True)[1].astype(np.int64) if n < 50 else _word_ids(words)
    m = int(ids.max()) + 1
    pair = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1].astype(np.int64)  # stays below n, so no overflow
    key = pair * m + ids[2:]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    many = counts[at] > 1
    inside = np.zeros(n, bool)
    for j in range(3):
        inside[j:n - 2 + j] |= many
    return int(inside.sum())


def _word_ids(words: list) -> np.ndarray:
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def statistics(text: str | None) -> list[float]:
    """Base counts (``BASE``) and the features that conditions test (``FEATURES``) of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - len(_SPACE.findall(text))
    symbols = len(_SYMBOLS.findall(text))
    lines = [line for line in text.split("\n") if line.strip(" \t\r\v\f")]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    letters = len(_LETTERS.findall(text))
    digits = sum(map(text.count, "0123456789"))
    upper = len(_UPPER.findall(text))
    stops = sum(map(text.count, ".!?"))
    one = max(n, 1)
    return [n, chars, symbols, dup, repeat,
            chars / one, symbols / one, dup / max(len(lines), 1), repeat / one, letters / max(chars, 1), digits / max(chars, 1),
            upper / max(letters, 1), len(counts) / one, n / max(len(lines), 1), stops / one, max(map(len, words), default=0),
            max(counts.values(), default=0) / one, n]


def _measure(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = np.array([statistics(t.as_py()) for t in batch.column(1).slice(at, 1000)], float).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 1000)] + [pa.array(c.astype(np.int64)) for c in rows[:len(BASE)]]
                + [pa.array(c) for c in rows[len(BASE):]], names=["doc_id"] + BASE + FEATURES)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts and the features of every row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", "
                           + ", ".join(f"{c} double" for c in FEATURES))


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeated > 50 * words)


class Condition(NamedTuple):
    feature: str
    at_least: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] <= self.value

    def column(self, prefix: str = "") -> Column:
        feature = F.col(prefix + self.feature)
        return feature >= self.value if self.at_least else feature <= self.value


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of highest information gain (bad rows kept times bits gained) among the rows inside."""
    p0, n0 = bad[inside].sum(), inside.sum()
    base = np.log2(p0 / n0)
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, column in x.items():
        v, b = column[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1  # thresholds lie between distinct values
        if not len(cut):
            continue
        below = np.cumsum(b)[cut - 1]
        for at_least, p, n in ((False, below, cut), (True, p0 - below, n0 - cut)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                middle = float((v[cut[i] - 1] + v[cut[i]]) / 2)
                best = (float(gain[i]), Condition(name, at_least, middle))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION, cover: int = COVER, seed: int = SEED) -> list[list[Condition]]:
    """Ordered rules (conjunctions of thresholds) that reject; empty if no rule is right often enough."""
    rng = np.random.default_rng(seed)
    left = np.arange(len(bad))
    rules: list[list[Condition]] = []
    while True:
        parts = [rng.permutation(left[bad[left] == b]) for b in (False, True)]  # a third of either class prunes
        grow = np.sort(np.concatenate([p[: 2 * len(p) // 3] for p in parts]))
        prune = np.sort(np.concatenate([p[2 * len(p) // 3:] for p in parts]))
        if bad[grow].sum() < cover or not len(prune):
            return rules
        gx, px = ({k: v[i] for k, v in x.items()} for i in (grow, prune))
        rule: list[Condition] = []
        inside = np.ones(len(grow), bool)
        while len(rule) < MAX_CONDITIONS and not bad[grow][inside].all():
            _, c = _best_condition(gx, bad[grow], inside)
            if c is None:
                break
            rule.append(c)
            inside &= c.holds(gx)
        if not rule:
            return rules

        def worth(r):
            hit = _covers(r, px, len(prune))
            p, n = int(bad[prune][hit].sum()), int(hit.sum())
            return (2 * p - n) / n if n else -1.0, p, n

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        _, p, n = worth(rule)
        # a lower bound on the precision, so that a rule that rests on a few rows isn't kept
        z2 = 1.64 ** 2
        low = (p / n + z2 / (2 * n) - 1.64 * np.sqrt(p / n * (1 - p / n) / n + z2 / (4 * n * n))) / (1 + z2 / n) if n else 0.0
        if p < cover or p / n < precision or low < 0.5:
            return rules
        rules.append(rule)
        left = left[~_covers(rule, {k: v[left] for k, v in x.items()}, len(left))]


def verdict(rules: list[list[Condition]], prefix: str = "") -> Column:
    """The list as one conditional expression: the number of the first rule that rejects, else null."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        test = rule[0].column(prefix)
        for c in rule[1:]:
            test = test & c.column(prefix)
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
                  label_col: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Statistics and label of at most ``sample`` labelled documents, by a hash of the id; null ids and labels are left out.

    The bound holds in numbers, not only on average; an id with several labels counts with its lowest.
    """
    named = (labels.select(F.col(label_id).cast("long").alias("lid"), F.col(label_col).cast("int").alias("good"))
             .where("lid IS NOT NULL AND good IS NOT NULL").groupBy("lid").agg(F.min("good").alias("good")))
    there = named.count()
    share = min(1.0, 0.9 * sample / max(there, 1)) if there > sample else 1.0
    chosen = named.where(fraction_of("lid", seed=seed) < share).limit(sample)
    if sample <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .join(chosen, F.col("doc_id") == F.col("lid"), "left_semi"))
    return measure(rows).join(chosen, F.col("doc_id") == F.col("lid")).limit(sample)


def fit(docs: DataFrame, labels: DataFrame, **names) -> list[list[Condition]]:
    """Learn the list from the labelled rows of ``docs`` (quality 0 is bad); rows that fail the base are left out."""
    rows = learning_rows(docs, labels, **names).where(~base_failed()).select("good", "doc_id", *FEATURES).toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)
    if not len(rows):
        return []
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["good"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict of every row: ``doc_id``, ``BASE``, ``base_failed``, ``rejected_by``, ``kept``.

    Cases: a null or empty text has no words, so it fails the base; a null id keeps its row; repeated
    rows are judged alike; ties don't arise (the first rule that fits decides); other columns are
    ignored; an empty table gives an empty result, and without labelled rows only the base rejects.
    """
    rows = measure(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict(rules))
    return rows.select("doc_id", *BASE, "base_failed", F.when(~F.col("base_failed"), F.col("rejected_by")).alias("rejected_by"),
                       (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))


def keep_good(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base nor the list rejects, with their columns as they are.

    Statistics stand beside the row's own columns under a prefix that none of them has, so nothing is joined and
    rows with null or repeated ids are judged one by one; cases as in ``judge``.
    """
    prefix = "__q"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    at = docs.columns.index(text_col)
    extra = [prefix + c for c in BASE + FEATURES]
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.DoubleType()) for c in extra])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                rows = np.array([statistics(t.as_py()) for t in part.column(at)], float).T
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) for c in rows]], names=[*docs_names, *extra])

    docs_names = list(docs.columns)
    measured = docs.mapInArrow(run, schema)
    return measured.where(~base_failed(prefix) & verdict(rules, prefix).isNull()).select(*[F.col(f"`{c}`") for c in docs_names])
