"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token weights are gathered in one pass into the cells of the categories that
the targets name. Every value that a target does not name counts as ``OTHER``,
so there are at most prod(len(target) + 1) cells, whatever the data, in
``bins`` ranges of the draw: that is the proven bound of what reaches the driver.

No row is taken twice, so no cell gives more than it has: raking runs under
these caps, and the share of all tokens that is kept falls until every margin is met.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Stands for every value that a target does not name, nulls among them.
OTHER = "*"
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; none for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mixture:
    """Target shares by column: ``{"lang": {"en": 0.5, "*": 0.5}}``; each column's shares are scaled to 1.

    A column whose targets don't name OTHER keeps OTHER's natural share, and the
    named ones share the rest. ``keep`` is the share of all tokens to sample at
    most: where no probabilities up to 1 meet the targets with it, it falls by
    ``fall`` at a time, ``tries`` times at most. The fit of each try stops as
    nothing moves any more, or after ``sweeps`` sweeps over all columns, and counts as
    met when no margin is off by more than ``tolerance``. Draws fall into
    ``bins`` ranges, so that probabilities are multiples of 1 / bins.
    """

    targets: dict[str, dict[str, float]]
    keep: float = 0.6
    fall: float = 0.93
    tries: int = 48
    sweeps: int = 240
    tolerance: float = 1e-4
    seed: int = 23
    bins: int = 512
    columns: tuple[str, str] = field(default=("mix_weight", "mix_probability"))

    def __post_init__(self) -> None:
        for name, shares in self.targets.items():
            if not shares or any(v < 0 for v in shares.values()) or sum(shares.values()) <= 0:
                raise ValueError(f"shares of {name} must not be negative, and one must be positive")

    def keeps(self) -> np.ndarray:
        return self.keep * self.fall ** np.arange(self.tries)


def goals(tokens: np.ndarray, cells: list[tuple[str, ...]], targets: list[dict[str, float]]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each column: its categories that occur, each cell's place among them, and their target shares.

    A category with target but without tokens can't be filled: its share goes
    to the others of its column in proportion. A category without target gets
    none, but OTHER.
    """
    out = []
    for k, shares in enumerate(targets):
        names = sorted({c[k] for c in cells})
        of = np.array([names.index(c[k]) for c in cells])
        have = np.bincount(of, tokens, len(names))
        goal = np.array([shares.get(n, 0.0) for n in names]) * (have > 0)
        rest = 0.0 if OTHER in shares or OTHER not in names else have[names.index(OTHER)] / have.sum()
        if goal.sum() <= 0:
            goal = have / have.sum()
        else:
            goal = goal / goal.sum() * (1 - rest)
            if rest:
                goal[names.index(OTHER)] = rest
        out.append((names, of, goal))
    return out


def rake(tokens: np.ndarray, plans: list[tuple[list[str], np.ndarray, np.ndarray]], keeps: np.ndarray, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell weights by keep, the greatest error of a margin by keep) of raking under a cell's cap, all it has.

    Every sweep scales the margins one after the other and then caps the cells;
    what a cap took off is given back before the next cap (Dykstra), so the
    weights go to those nearest the token shares that meet all margins and
    caps, where there are any.
    """
    share = tokens / tokens.sum()
    cap = share / keeps[:, None]
    weights = np.repeat(share[None], len(keeps), axis=0)
    taken = np.ones_like(weights)

    def margin(of: np.ndarray, goal: np.ndarray) -> np.ndarray:
        return weights @ np.eye(len(goal))[of]

    for _ in range(sweeps):
        before = weights
        for _, of, goal in plans:
            now = margin(of, goal)
            weights = weights * np.divide(goal, now, out=np.zeros_like(now), where=now > 0)[:, of]
        full = weights * taken
        weights = np.minimum(full, cap)
        taken = np.divide(full, weights, out=np.ones_like(full), where=weights > 0)
        if np.abs(weights - before).max() < 1e-15:
            break
    errors = np.max([np.abs(margin(of, goal) - goal).max(axis=1) for _, of, goal in plans], axis=0)
    return weights, errors


@dataclass
class Fit:
    """Cells with their weights per token and probabilities; the margins that come of them."""

    cells: list[tuple[str, ...]]
    ratio: np.ndarray
    chance: np.ndarray
    keep: float
    #: (column, category, share aimed at, share before, share expected by weight, share of the sample)
    margins: list[tuple[str, str, float, float, float, float]]

    @property
    def residual(self) -> float:
        return max((abs(m[5] - m[2]) for m in self.margins), default=0.0)


def fit_cells(drawn: np.ndarray, cells: list[tuple[str, ...]], mixture: Mixture) -> Fit:
    """From the tokens of each cell by range of the draw: the greatest keep that meets all margins, or else the one that misses them least.

    A cell's probability is the one up to which its rows drew the tokens that
    are nearest what its weight calls for; so the sample itself meets the margins, not only
    on average.
    """
    n, tokens = len(cells), drawn.sum(axis=1)
    if not n or tokens.sum() <= 0:
        return Fit(cells, np.zeros(n), np.zeros(n), 0.0, [])
    plans = goals(tokens, cells, list(mixture.targets.values()))
    keeps = mixture.keeps()
    weights, errors = rake(tokens, plans, keeps, mixture.sweeps)
    met = np.flatnonzero(errors <= mixture.tolerance)
    at = int(met[0]) if len(met) else int(errors.argmin())
    if not len(met):
        log.warning("no sample meets the target shares; the nearest misses one by %.4f", errors[at])
    w, share = weights[at], tokens / tokens.sum()
    ratio = np.divide(w, share, out=np.zeros(n), where=share > 0)
    upto = np.concatenate((np.zeros((n, 1)), np.cumsum(drawn, axis=1)), axis=1)
    step = np.abs(upto - (w * keeps[at] * tokens.sum())[:, None]).argmin(axis=1)
    got = upto[np.arange(n), step]
    got = got / max(got.sum(), 1)
    margins = []
    for column, (names, of, goal) in zip(mixture.targets, plans, strict=True):
        shares = [np.bincount(of, x, len(names)).tolist() for x in (share, w / w.sum(), got)]
        margins += [(column, *m) for m in zip(names, goal.tolist(), *shares, strict=True)]
    return Fit(cells, ratio, step / mixture.bins, float(keeps[at]), margins)


def _category(value: Column, shares: dict[str, float]) -> Column:
    value = value.cast("string")
    return F.when(value.isin([v for v in shares if v != OTHER]), value).otherwise(F.lit(OTHER))


def _categories(mixture: Mixture, values: dict[str, Column] | None) -> list[Column]:
    return [_category((values or {}).get(n, F.col(n)), s) for n, s in mixture.targets.items()]


def fit(df: DataFrame, mixture: Mixture, tokens: Column, key: str = "doc_id", values: dict[str, Column] | None = None) -> Fit:
    """Rakes a table's cells; ``values`` has the expressions of target columns that aren't columns of the table."""
    by = [f"__mx_{i}" for i in range(len(mixture.targets))]
    groups = [c.alias(n) for c, n in zip(_categories(mixture, values), by, strict=True)]
    bin_ = F.floor(draw(F.col(key), mixture.seed) * mixture.bins).cast("int").alias("__mx_bin")
    rows = df.select(*groups, bin_, tokens.alias("__mx_tokens")).groupBy(*by, "__mx_bin").agg(F.sum("__mx_tokens").alias("t")).collect()
    cells = sorted({tuple(r)[:-2] for r in rows})
    at = {c: i for i, c in enumerate(cells)}
    drawn = np.zeros((len(cells), mixture.bins))
    for r in rows:
        drawn[at[tuple(r)[:-2]], r["__mx_bin"]] = r["t"] or 0
    return fit_cells(drawn, cells, mixture)


def margins(df: DataFrame, mixture: Mixture, tokens: Column, key: str = "doc_id", values: dict[str, Column] | None = None) -> DataFrame:
    """(column, category, target, natural, expected, sampled, residual): the shares of tokens that ``sample`` gives, and how far off the target they are."""
    rows = [(*m, m[5] - m[2]) for m in fit(df, mixture, tokens, key, values).margins]
    schema = "column string, category string, target double, natural double, expected double, sampled double, residual double"
    return df.sparkSession.createDataFrame(rows, schema)


def mix_weights(df: DataFrame, mixture: Mixture, tokens: Column, key: str = "doc_id", values: dict[str, Column] | None = None) -> DataFrame:
    """Adds a row's calibrated weight per token (1: the natural share) and its sampling probability.

    Nulls in a target's column count as OTHER; rows without tokens, null and
    empty texts, don't count in the fit and get their cell's probability. Very
    long texts count whole, so that one may hold much of a cell; rows of a
    cell are alike, so there are no ties. A cell that holds
    only rows without tokens gets probability 0. Repeated rows count
    once each. An empty table stays empty. Columns named as the added ones
    are replaced, all others kept.
    """
    found = fit(df, mixture, tokens, key, values)
    cell = F.concat_ws("\x1f", *_categories(mixture, values))
    by = {"\x1f".join(c): (float(r), float(p)) for c, r, p in zip(found.cells, found.ratio, found.chance, strict=True)}
    made = []
    for name, k in zip(mixture.columns, (0, 1), strict=True):
        table = F.create_map(*chain.from_iterable((F.lit(c), F.lit(v[k])) for c, v in by.items())) if by else None
        made.append((F.lit(0.0) if table is None else F.coalesce(table[cell], F.lit(0.0))).alias(name))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in mixture.columns or c == key], *made)


def sample(df: DataFrame, mixture: Mixture, tokens: Column, key: str = "doc_id", values: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``mix_weights`` that a seeded draw by key keeps with their probability.

    The draw depends on the key alone, so a row is kept or dropped alike on
    every run of a table; rows that repeat a key share its draw. Null keys share one.
    """
    drawn = mix_weights(df, mixture, tokens, key, values)
    return drawn.where(draw(F.col(key), mixture.seed) < F.col(mixture.columns[1]))


def draw(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from a seeded digest of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
