"""Language identification by hierarchical discrimination.

A first linear classifier names the language family, then one-versus-one linear support vector
machines separate the languages inside it.  Features are counts of character one- to three-grams
of the letters (lower-cased, anything else is one space), hashed into ``DIM`` cells, as square
roots, scaled to length one.

Models are fitted on at most ``PER_LANGUAGE`` documents of each language, taken by a hash of the id;
features are made on the executors, so a bounded matrix of floats, not the texts, reaches the
driver.  Every whole text is judged.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudent.llm.common import fraction_of, staged

DIM, PER_LANGUAGE, SEED, EPOCHS = 4096, 400, 5, 60
UNDETERMINED = "und"
#: language -> family; a language that isn't named is a family of its own
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
            "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic"}


class Machine(NamedTuple):
    """A linear machine: positive scores speak for ``yes``."""
    yes: str
    no: str
    weights: np.ndarray
    offset: float
    scale: float


class Model(NamedTuple):
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]
    dim: int


_CHUNK = 1 << 20


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with every run of other characters than letters as one space."""
    low = text.lower()
    cells = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (cells >= 97) & (cells <= 122)
    high = np.flatnonzero(cells > 127)
    if len(high):
        kinds, at = np.unique(cells[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in kinds.tolist()])[at]
    codes = np.where(letter, cells, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character of a run stands for it
    return np.concatenate([[np.uint64(32)], codes[keep], [np.uint64(32)]]).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Feature vector of a whole text; none for a text without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    c = _codes(text)
    counts = np.zeros(dim)
    with np.errstate(over="ignore"):
        for at in range(0, len(c), _CHUNK):
            part = c[at:at + _CHUNK + 2]
            key = part + np.uint64(1)
            for n in range(3):
                if n:
                    key = key[:-1] * np.uint64(1_114_113) + part[n:]
                own = key[:_CHUNK] if len(part) > _CHUNK else key
                counts += np.bincount((_mix(own * np.uint64(3) + np.uint64(n)) % np.uint64(dim)).astype(np.int64), minlength=dim)
    x = np.sqrt(counts)
    return x / np.linalg.norm(x)


def train_machine(x: np.ndarray, yes: np.ndarray, names: tuple[str, str], seed: int, cost: float = 1.0) -> Machine:
    """Linear support vector machine (hinge loss, L2) by dual coordinate descent; classes weigh alike."""
    n = len(x)
    y = np.where(yes, 1.0, -1.0)
    weight = np.where(yes, n / (2 * max(1, yes.sum())), n / (2 * max(1, (~yes).sum()))) * cost
    xb = np.hstack([x, np.ones((n, 1))])
    q = (xb ** 2).sum(1)
    alpha, w = np.zeros(n), np.zeros(xb.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(n):
            g = y[i] * (w @ xb[i]) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * xb[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    margin = np.median(np.abs(xb @ w)) or 1.0
    return Machine(*names, w[:-1], float(w[-1]), float(2 / margin))


def train(x: np.ndarray, langs: list[str], families: dict[str, str] | None = None, seed: int = SEED) -> Model:
    """Machines between the families that occur and between the languages of each."""
    families = FAMILIES if families is None else families
    of = [families.get(lang, "only:" + lang) for lang in langs]
    groups = {f: sorted({lang for lang, g in zip(langs, of) if g == f}) for f in sorted(set(of))}

    def duels(names: list[str], labels: np.ndarray, rows: np.ndarray) -> list[Machine]:
        return [train_machine(x[rows][np.isin(labels[rows], (a, b))], labels[rows][np.isin(labels[rows], (a, b))] == a, (a, b), seed)
                for i, a in enumerate(names) for b in names[i + 1:]]

    of_array, lang_array = np.array(of, object), np.array(langs, object)
    everything = np.arange(len(langs))
    return Model(groups, duels(list(groups), of_array, everything),
                 {f: duels(names, lang_array, np.flatnonzero(of_array == f)) for f, names in groups.items()}, x.shape[1] if len(x) else DIM)


def _contest(names: list[str], machines: list[Machine], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner's place in ``names`` and its mean probability over its duels; ties go to the higher probability, then the name."""
    if len(names) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    votes, chance = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for m in machines:
        p = 1 / (1 + np.exp(-m.scale * (x @ m.weights + m.offset)))
        for name, q in ((m.yes, p), (m.no, 1 - p)):
            votes[:, names.index(name)] += q >= 0.5
            chance[:, names.index(name)] += q / (len(names) - 1)
    best = (votes + chance / 2).argmax(1)
    return best, chance[np.arange(len(x)), best]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score (0 to 1) of every text; ``und`` and 0 without a letter or without a model."""
    vectors = [features(t, model.dim) for t in texts]
    some = [i for i, v in enumerate(vectors) if v is not None]
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not some or not model.families:
        return langs, scores
    x = np.array([vectors[i] for i in some])
    names = list(model.families)
    family, sure = _contest(names, model.between, x)
    for f, name in enumerate(names):
        rows = np.flatnonzero(family == f)
        if not len(rows):
            continue
        best, chance = _contest(model.families[name], model.within[name], x[rows])
        for r, b, p in zip(rows, best, chance):
            langs[some[r]] = model.families[name][b]
            scores[some[r]] = float(min(1.0, max(0.0, sure[r] * p)))
    return langs, scores


def _featurize(dim: int) -> Callable:
    def run(batches):
        for batch in batches:
            vectors = [features(t.as_py(), dim) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if v is None else v.astype(np.float32).tobytes() for v in vectors], pa.binary())],
                names=["lang", "x"])
    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE,
        dim: int = DIM, families: dict[str, str] | None = None, seed: int = SEED) -> Model:
    """Fit on at most ``per_language`` rows of each language; rows without a language or a letter teach nothing."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.5 * per_language / n)).otherwise(share)
    draw = fraction_of("doc_id", seed=seed)
    some = base.where(draw < share).withColumn("draw", draw)
    # about 1.5 * per_language rows of a language are ranked; exactly that many at most are used
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    some = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    rows = staged(some.select("lang", "text").mapInArrow(_featurize(dim), "lang string, x binary"), "language-sample")
    data = sorted((r["lang"], bytes(r["x"])) for r in rows.where("x IS NOT NULL").collect())
    x = np.array([np.frombuffer(b, np.float32) for _, b in data], np.float64) if data else np.empty((0, dim))
    return train(x, [lang for lang, _ in data], families, seed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its text alone.

    Cases: ``und`` with score 0 for a null or empty text, one without a letter, or a model that has
    seen no language; a null id keeps its row; repeated rows are judged alike; ties go to the higher
    probability, then to the first name; other columns are ignored; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats per machine

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                langs, scores = predict(shared.value, batch.column(1).slice(at, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: Column) -> Column:
    """The fold that isn't learned from: crc32 of the id as text modulo 4 is 2 (a null id is learned from)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
