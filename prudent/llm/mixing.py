"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  Token counts per cell are raked: the cells'
weights are scaled to the target of each margin in turn until all margins agree.  A document is
then kept with the probability min(1, c * its cell's scale).  The share of tokens to keep is a
target of its own that sets c, so a tiny cell with a huge scale is kept whole and doesn't set the
rate of the others; no document is repeated.  Cells kept whole that would need more fall short of
their margins' targets.

Targets name the values that count; everything else of a margin is its class ``*``, so the cells
are at most (sources + 1) x (languages + 1) x (topics + 1), whatever the corpus holds, and only
they reach the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudent.llm.common import fraction_of, staged

OTHER, NONE = "*", "(null)"
#: share of the tokens that the registered query and the pipeline keep
KEEP = 0.5
#: named values of a margin; a margin with more should be mapped to groups first
MAX_VALUES = 1000


class Margin(NamedTuple):
    """A margin's column and the target share of tokens of its named values.

    ``targets`` None: the natural shares to the power ``temper``, over the ``top`` values by tokens.
    """
    name: str
    column: Column
    targets: dict[str, float] | None = None
    temper: float = 1.0
    top: int = 200


def token_weight(text: Column) -> Column:
    """Words of a text: a stand-in for tokens that needs no tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """Topic by form: license text, table, code-like, dialogue or prose (a null text is prose)."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.rlike(r"(?i)\blicen[sc]ed? under\b|general public license"), "licensed")
            .when(t.rlike(r"\n[^\n]*\|[^\n]*\|"), "table")
            .when(t.rlike(r"[{};]\s*\n"), "code")
            .when(t.rlike(r"(?:^|\n)[\-*•] "), "list")
            .otherwise("prose"))


def tempered(shares: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v ** power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, targets: list[np.ndarray], tolerance: float = 1e-9, rounds: int = 10_000, strict: bool = True) -> np.ndarray:
    """Scale of every cell so that ``tokens * scale`` meets the target shares of each axis.

    A target for an empty slice can't be met and is shared out among the others.  Where empty cells
    make the margins contradict each other, steps end in a cycle with one table per margin that
    meets that margin: ``strict`` raises then, else the mean of these tables is the compromise.
    """
    total = tokens.sum()
    if not total:
        return np.zeros_like(tokens)
    axes = range(tokens.ndim)
    wanted = []
    for axis, t in zip(axes, targets):
        there = tokens.sum(axis=tuple(a for a in axes if a != axis)) > 0
        t = np.where(there, t, 0.0)
        wanted.append(t / t.sum())
    scale = np.where(tokens > 0, 1.0, 0.0)
    cycle = [scale] * tokens.ndim
    for _ in range(rounds):
        off = 0.0
        for axis, t in zip(axes, wanted):
            now = (tokens * scale).sum(axis=tuple(a for a in axes if a != axis)) / total
            off = max(off, float(np.abs(now - t).max()))
            factor = np.divide(t, now, out=np.ones_like(t), where=now > 0)
            scale = scale * factor.reshape([-1 if a == axis else 1 for a in axes])
            cycle[axis] = scale
        if off < tolerance:
            return scale
    if not strict:
        return np.mean(cycle, axis=0)
    raise ValueError("the margins' targets contradict each other")


def rate(tokens: np.ndarray, scale: np.ndarray, keep: float | None) -> float:
    """The ``c`` at which cells kept with min(1, c * scale) leave ``keep`` of all tokens.

    None: the largest ``c`` that keeps no cell whole but those of the largest scale.  A share that
    only cells of scale 0 could fill gives infinity: all others are kept whole.
    """
    if keep is not None and not 0 < keep <= 1:
        raise ValueError("keep: a share above 0, 1 at most")
    there = (tokens > 0) & (scale > 0)
    if not there.any():
        return 0.0
    if keep is None:
        return float(1 / scale[there].max())
    order = np.argsort(-scale[there])
    n, s = tokens[there][order], scale[there][order]
    whole = np.append(0.0, np.cumsum(n))[:-1]  # tokens of the cells before, kept whole
    rest = np.cumsum((n * s)[::-1])[::-1]
    c = (keep * tokens.sum() - whole) / rest
    fits = np.flatnonzero(c * s <= 1 + 1e-12)
    return float(c[fits[0]]) if len(fits) else float("inf")


class Calibration(NamedTuple):
    """Slim rows (``doc_id, tokens, draw, m0 ..``), the named values of each margin, (classes, scale) per cell, and the rate."""
    rows: DataFrame
    named: list[list[str]]
    scales: list[tuple]
    rate: float


def _classes(named: list[list[str]], columns: list[Column]) -> list[Column]:
    return [F.when(c.isin(v), c).otherwise(F.lit(OTHER)) if v else F.lit(OTHER) for c, v in zip(columns, named)]


def _values(margins: list[Margin]) -> list[Column]:
    return [F.coalesce(m.column.cast("string"), F.lit(NONE)) for m in margins]


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    """The same for equal ids; a row without an id draws by its text."""
    return fraction_of(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))), seed=seed)


def calibrate(docs: DataFrame, margins: list[Margin], id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
              seed: int = 97, keep: float | None = None) -> Calibration:
    """Read the texts once for tokens and classes, and rake the cells."""
    cols = [f"m{i}" for i in range(len(margins))]
    count = token_weight(F.col(f"`{text_col}`").cast("string")) if tokens is None else tokens
    rows = staged(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), count.alias("tokens"),
                              _draw(id_col, text_col, seed).alias("draw"), *[v.alias(c) for c, v in zip(cols, _values(margins))]),
                  "mixing")
    named: list[list[str]] = []
    for col, m in zip(cols, margins):
        if m.targets is None:
            top = rows.groupBy(col).agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), col).limit(m.top)  # the rest is class *
            named.append(sorted(r[0] for r in top.collect()))
        else:
            if len(m.targets) > MAX_VALUES or sum(m.targets.values()) > 1 + 1e-6:
                raise ValueError(f"targets of {m.name}: at most {MAX_VALUES} values that sum to 1 at most")
            named.append(sorted(m.targets))
    cells = (rows.select("tokens", *[c.alias(n) for n, c in zip(cols, _classes(named, [F.col(c) for c in cols]))])
             .groupBy(*cols).agg(F.sum("tokens").alias("n")).collect())  # bounded by the named values
    levels = [sorted({r[c] for r in cells}) for c in cols]
    at = [tuple(v.index(r[c]) for c, v in zip(cols, levels)) for r in cells]
    table = np.zeros([len(v) for v in levels])
    for place, r in zip(at, cells):
        table[place] = r["n"]
    targets = []
    for axis, (m, values) in enumerate(zip(margins, levels)):
        natural = table.sum(axis=tuple(a for a in range(table.ndim) if a != axis)) / max(table.sum(), 1.0)
        aim = tempered(dict(zip(values, natural)), m.temper) if m.targets is None else m.targets
        t = np.array([aim.get(v, 0.0) for v in values])
        if m.targets is not None and OTHER not in aim and OTHER in values:
            t[values.index(OTHER)] = max(0.0, 1 - t.sum())
        targets.append(t)
    scale = rake(table, targets, strict=False) if cells else table
    return Calibration(rows, named, [tuple(r[c] for c in cols) + (float(scale[place]),) for place, r in zip(at, cells)],
                       rate(table, scale, keep))


def _probability(c: float, weight: float) -> float:
    return min(1.0, c * weight) if weight > 0 else 1.0


def mix(docs: DataFrame, margins: list[Margin], id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
        seed: int = 97, keep: float | None = None) -> DataFrame:
    """Calibrated inclusion of every document: ``doc_id``, the margins' classes, ``tokens``, ``weight``, ``probability``, ``selected``.

    ``weight`` is the raked scale (target tokens over tokens there are), ``probability`` min(1, c *
    scale) with c solved for ``keep``, the share of all tokens to keep (None: the scale over the
    largest, so the rarest cell sets what is kept); ``selected`` compares it with a hash of the id (of the text where the id is
    null), so the draw is the same on any cluster and for repeated rows.

    Cases: a null value of a margin is the class ``(null)`` if named, else ``*``; a document without
    words weighs nothing and shares its cell's probability; contradicting targets give the compromise of ``rake``; documents of a cell without tokens are
    kept; ties don't arise; other columns are ignored; an empty table gives an empty result.
    """
    got = calibrate(docs, margins, id_col, text_col, tokens, seed, keep)
    cols = [f"m{i}" for i in range(len(margins))]
    lookup = docs.sparkSession.createDataFrame([s + (_probability(got.rate, s[-1]),) for s in got.scales],
                                               ", ".join(f"k{i} string" for i in range(len(cols))) + ", weight double, probability double")
    classed = got.rows.select("doc_id", "tokens", "draw", *[c.alias(n) for n, c in zip(cols, _classes(got.named, [F.col(c) for c in cols]))])
    return (classed.join(F.broadcast(lookup), [F.col(c) == F.col(f"k{i}") for i, c in enumerate(cols)])
            .select("doc_id", *[F.col(c).alias(m.name) for c, m in zip(cols, margins)], "tokens", "weight", "probability",
                    (F.col("draw") < F.col("probability")).alias("selected")))


def sample(docs: DataFrame, margins: list[Margin], id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
           seed: int = 97, keep: float | None = None) -> DataFrame:
    """The rows of ``docs`` that the mixture selects, with their columns as they are.

    Probabilities are looked up in place, without a join on the id, so repeated and null ids are
    decided row by row; cases as in ``mix``.
    """
    got = calibrate(docs, margins, id_col, text_col, tokens, seed, keep)
    if not got.scales:
        return docs.where(F.lit(False))
    keep = F.create_map(*[x for s in got.scales for x in (F.lit("\x1f".join(s[:-1])), F.lit(_probability(got.rate, s[-1])))])
    names = _classes(got.named, _values(margins))
    return docs.where(_draw(id_col, text_col, seed) < F.element_at(keep, F.concat_ws("\x1f", *names)))


def default_margins() -> list[Margin]:
    """Targets of the registered query: large sources tempered, languages and forms by fixed shares of the natural mix."""
    text = F.col("text")
    return [Margin("source", F.col("source"), temper=0.7), Margin("lang", F.col("lang"), temper=0.8),
            Margin("topic", topic_of(text), temper=0.9)]
