"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.llm import topics
from arborel.llm.common import dealt, stored

#: For each marginal an exponent (target shares go as tokens to that power) or target shares by value.
TARGETS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEPT_TOKENS, ROUNDS, CLOSE = 0.7, 200, 1e-4
#: Cells up to which the driver rakes their table and sends it to every task; a larger one is raked and joined by shuffles.
HELD_CELLS = 20_000
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    """Words between white space (space, and tab to carriage return)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _wish(values: DataFrame, by: str, target: float | dict[str, float]) -> DataFrame:
    """values (by, tokens) with raked: what the target asks for each, in any unit."""
    if isinstance(target, dict):
        listed = [x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))]
        wish = F.coalesce(F.create_map(*listed)[F.col(by)], F.lit(0.0)) if listed else F.lit(0.0)
    else:
        wish = F.pow(F.col("tokens"), F.lit(float(target)))
    return values.select(by, "tokens", F.when(F.col("tokens") > 0, wish).otherwise(0.0).alias("raked"))


def _goal(cells: DataFrame, by: str, target: float | dict[str, float], kept: float | None) -> DataFrame:
    """(by, target): tokens for each value. Without kept they add up to all tokens. With it they add up to this share of
    them, and a value that has fewer tokens than it should give is taken whole."""
    values = _wish(cells.groupBy(by).agg(F.sum("tokens").alias("tokens")), by, target)
    if kept is None:
        t = values.agg(F.sum("tokens"), F.sum("raked")).first()
        return values.select(by, (F.col("raked") * ((t[0] or 0) / (t[1] or 1.0))).alias("target"))
    level = _level(values, kept)
    return values.select(by, F.least(F.col("tokens").cast("double"), F.col("raked") * level).alias("target"))


def _settled(worst: float | None, rounds: int) -> None:
    if worst is not None and worst >= CLOSE:
        warnings.warn(f"raking is off by {worst:.2g} after {rounds} rounds; the targets may exclude each other", stacklevel=3)


def raked(cells: DataFrame, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS, kept: float | None = None) -> DataFrame:
    """cells (the marginals' columns, tokens) with raked: token weights whose marginals meet the targets; with kept, no
    more of a cell than its tokens. Each round is written; it ends when no factor is further than CLOSE from one, or
    after rounds with a warning."""
    goal = {by: stored(_goal(cells, by, target, kept)) for by, target in targets.items()}
    now = cells.withColumn("raked", F.col("tokens").cast("double") * (kept or 1.0))
    worst = None
    for _ in range(rounds):
        off = F.lit(0.0)
        for by, target in goal.items():
            sums = now.groupBy(by).agg(F.sum("raked").alias("_sum")).join(target, by)
            factor = dealt(sums.select(by, F.when(F.col("_sum") > 0, F.col("target") / F.col("_sum")).otherwise(0.0).alias("_factor")))
            most = F.col("raked") * F.col("_factor")
            now = now.join(factor, by).withColumn(f"_off_{by}", F.abs(F.when(F.col("raked") > 0, F.col("_factor") - 1).otherwise(0.0))).withColumn("raked", most if kept is None else F.least(most, F.col("tokens").cast("double"))).drop("_factor")
            off = F.greatest(off, F.col(f"_off_{by}"))
        now = stored(now.withColumn("_off", off).drop(*(f"_off_{by}" for by in goal)))
        worst = now.agg(F.max("_off")).first()[0]
        now = now.drop("_off")
        if worst is None or worst < CLOSE:
            break
    _settled(worst, rounds)
    return now


def raked_here(cells: pa.Table, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS, kept: float | None = None) -> np.ndarray:
    """The weights that raked gives, of a table of cells that the driver holds."""
    tokens = cells["tokens"].to_numpy().astype(float)
    goal = []
    for by, target in targets.items():
        values, of = np.unique(np.array(cells[by].to_pylist(), object), return_inverse=True)
        t = np.bincount(of, weights=tokens)
        wish = np.array([float(target.get(v, 0.0)) for v in values]) if isinstance(target, dict) else t ** float(target)
        wish = np.where(t > 0, wish, 0.0)
        goal.append((of, wish * (t.sum() / (wish.sum() or 1.0)) if kept is None else np.minimum(t, wish * level_here(t, wish, kept))))
    now, worst = tokens * (kept or 1.0), None
    for _ in range(rounds):
        worst = 0.0
        for of, target in goal:
            sums = np.bincount(of, weights=now)
            factor = np.divide(target, sums, out=np.zeros_like(sums), where=sums > 0)[of]
            worst = max(worst, np.abs(factor - 1)[now > 0].max(initial=0.0))
            now = now * factor if kept is None else np.minimum(now * factor, tokens)
        if worst < CLOSE:
            break
    _settled(worst, rounds)
    return now


def _level(cells: DataFrame, kept: float) -> float:
    """The factor at which the expected kept tokens, sum of tokens * min(1, factor * raked / tokens), are kept of all."""
    goal = (cells.agg(F.sum("tokens")).first()[0] or 0) * kept
    expected = lambda x: F.sum(F.least(F.col("tokens").cast("double"), F.col("raked") * x))

    def at(grid: list[float]) -> list[float | None]:
        return list(cells.agg(*(expected(x).alias(f"x{i}") for i, x in enumerate(grid))).first())

    return _search(at, goal)


def level_here(tokens: np.ndarray, wish: np.ndarray, kept: float) -> float:
    """_level of cells that the driver holds."""
    return _search(lambda grid: [float(np.minimum(tokens, wish * x).sum()) for x in grid], tokens.sum() * kept)


def _search(at: Callable[[list[float]], list[float | None]], goal: float) -> float:
    """Where a growing function reaches goal (a hundredth of a percent over it at most), or the largest factor asked."""
    low, high, grid = 0.0, 0.0, [4.0**i for i in range(-32, 33)]
    for _ in range(6):
        got = at(grid)
        if got[0] is None:
            return 0.0
        above = next((i for i, v in enumerate(got) if v >= goal * (1 - 1e-9)), len(grid) - 1)
        low, high = grid[max(0, above - 1)], grid[above]
        grid = [low + (high - low) * i / 16 for i in range(17)]
    return high


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float | dict[str, float]] = TARGETS, kept_tokens: float = KEPT_TOKENS, rounds: int = ROUNDS, bounded: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, topic (if topic is a marginal and docs has none: a cluster of texts by their words), probability,
    weight and sampled.

    Token weights of the cells (source, language, topic) are raked to the targets. A document is sampled with its
    cell's probability, min(1, factor * raked / tokens), by a hash of its id; the factor makes the expected tokens
    kept_tokens of all. weight says how often a sampled document should count so that the mix is that of the targets.
    bounded: no cell is asked for more than it has, so weights are 1 and the sample alone meets the targets; for this a
    value (of a source, say) with too few tokens is taken whole, and the others share the rest by their targets.

    A null marginal is a value of its own; null texts have no tokens; documents of cells without tokens have
    probability 0. Rows with one id fall alike, those with a null id too. An empty table gives no rows. The columns
    n_tokens, probability, weight and sampled are replaced. keep_text: whether the text is among the result's columns.
    """
    marginals = list(targets)
    asked = docs.drop("probability", "weight", "sampled")
    if "topic" in marginals and "topic" not in docs.columns:
        asked = topics.with_topics(asked, topics.fit(asked, text_col=text_col, id_col=id_col), text_col=text_col, keep_text=keep_text)
    else:
        asked = asked.withColumn("n_tokens", n_tokens(F.col(text_col)))
    keys = {f"_k_{m}": F.coalesce(F.col(m).cast("string"), F.lit(NONE)) for m in marginals}
    asked = asked.withColumns(keys)
    # texts are measured once; reading them again from here costs less than measuring them again
    asked = stored(asked if keep_text or text_col not in asked.columns else asked.drop(text_col))
    cells = stored(asked.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")))
    goals, kept = {f"_k_{m}": t for m, t in targets.items()}, kept_tokens if bounded else None
    n_cells = cells.count()
    few = n_cells <= HELD_CELLS
    if not n_cells:
        cells, level = cells.withColumn("raked", F.lit(0.0)), 1.0
    elif few:
        held = cells.toArrow()
        now, tokens = raked_here(held, goals, rounds, kept), held["tokens"].to_numpy().astype(float)
        cells = docs.sparkSession.createDataFrame(held.append_column("raked", pa.array(now)), schema=", ".join([*(f"`{k}` string" for k in keys), "tokens long, raked double"]))
        level = 1.0 if bounded else level_here(tokens, now, kept_tokens)
    else:
        cells = raked(cells, goals, rounds, kept)
        level = 1.0 if bounded else _level(cells, kept_tokens)
    rate = F.when(F.col("tokens") > 0, F.col("raked") * level / F.col("tokens")).otherwise(0.0)
    cells = cells.select(*keys, F.least(rate, F.lit(1.0)).alias("probability"), F.greatest(rate, F.lit(1.0)).alias("weight"))
    out = asked.join(F.broadcast(cells) if few else dealt(cells), list(keys))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return out.drop(*keys).withColumn("sampled", draw < F.col("probability"))


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float | dict[str, float]] = TARGETS, kept_tokens: float = KEPT_TOKENS) -> DataFrame:
    """The rows of docs that bounded mixing samples, with the columns of docs and no others, whatever their names; topic
    as a marginal is always the text's own."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = {m if m == "topic" else own[m]: t for m, t in targets.items()}
    out = mix(docs.toDF(*own.values()), id_col=own[id_col], text_col=own[text_col], targets=named, kept_tokens=kept_tokens, bounded=True)
    return out.where("sampled").select(*(F.col(c).alias(name) for name, c in own.items()))
