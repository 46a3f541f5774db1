"""Steps of the sequential model fitted together, from Gram matrices by date and by which values are known.

A step makes its columns orthogonal to earlier ones and strips them from the residual. Among rows of one date that know the same values, all of this is linear in
the columns as given: one Gram matrix of (1, columns, residual) for each such group holds what all of the steps need. One pass over the rows gives these
matrices, summed within tasks; what the steps do to a date is then worked out on matrices alone. Ridge steps choose among folds, whose matrices a second
pass gives, by date. The fits are a row a date, and for each group what is left is one combination of the columns as given: stripped() takes it from the rows
in place, so that rows are neither written nor shuffled between steps, and columns are never rewritten.

Rows know few combinations of values, as characteristics come from few sources; at worst there are as many groups as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.operators.gram import TOLERANCE, Hold, Path, _swept_first, best_ridge, folds

FOLDS = 5
#: Groups that a task holds before it hands their sums on.
GROUPS = 20_000
_PARTS = "date date, step int, fold int, known long, part array<double>"
_FITS = "date date, given struct<n:double,total:double,squares:double>, steps array<struct<intercept:double,slopes:array<double>,r2:double,ridge:double,orth:array<array<double>>,left:struct<n:double,total:double,squares:double>>>, groups array<struct<known:bigint,lines:array<array<double>>>>"


@dataclass(frozen=True)
class Step:
    name: str
    columns: tuple[str, ...]
    priors: tuple[str, ...] = ()
    grid: tuple[float, ...] = ()
    default: float = 0.5
    #: (rows, dates with residuals, hold) to the same rows with the step's column, made from resid; rows of gaps may be added, those of other dates left out.
    made: Callable[..., DataFrame] | None = None

    @property
    def before(self) -> list[str]:
        return [p for p in self.priors if p not in self.columns]


def _columns(steps: Sequence[Step], earlier: Sequence[Step] = ()) -> list[str]:
    """The columns that the steps need as given, also those that earlier steps made theirs orthogonal to."""
    needed = {c for s in steps for c in (*s.before, *s.columns)}
    for s in reversed(earlier):
        if needed & {*s.columns}:
            needed |= {*s.before}
    return [c for c in dict.fromkeys(c for s in (*earlier, *steps) for c in (*s.before, *s.columns)) if c in needed]


def _chosen(steps: Sequence[Step]) -> list[int]:
    return [k for k, s in enumerate(steps) if len(s.grid) > 1]


def _dealt(steps: Sequence[Step], earlier: Sequence[Step]) -> set[str]:
    """What the ridge steps need of a row."""
    return {*_columns(steps[: max(_chosen(steps), default=-1) + 1], earlier), "resid"}


def _schema() -> pa.Schema:
    return pa.schema([("date", pa.date32()), ("step", pa.int32()), ("fold", pa.int32()), ("known", pa.int64()), ("part", pa.list_(pa.float64()))])


def _batch(parts: dict[tuple[int, int, int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(zip(*parts, strict=True))
    days, step, fold, known = (pa.array(k, t) for k, t in zip(keys, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True))
    return pa.RecordBatch.from_arrays([days.cast(pa.date32()), step, fold, known, pa.array([p.tolist() for p in parts.values()], pa.list_(pa.float64()))], schema=_schema())


def _add(parts: dict[tuple[int, int, int, int], np.ndarray], keys: Sequence[np.ndarray], values: np.ndarray, weights: Sequence[np.ndarray]) -> None:
    """Adds to each group's part the upper triangles of its Gram matrix, one for each way of weighing. values: a line a column."""
    if not len(keys[0]):
        return
    order = np.lexsort(keys[::-1])
    keys, values = [k[order] for k in keys], values[:, order]
    starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    i, j = np.triu_indices(len(values))
    products = values[i] * values[j]
    sums = np.concatenate([np.add.reduceat(products * w[order], starts, axis=1) for w in weights]).T
    for key, part in zip(zip(*(k[starts].tolist() for k in keys), strict=True), sums, strict=True):
        parts[key] = parts[key] + part if key in parts else part.copy()


def _read(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines of 1 and of the columns from `first` on with missing values as 0, bits of those that are known)."""
    own = [batch.column(k) for k in range(first, batch.num_columns)]
    values = np.stack([np.ones(batch.num_rows), *(c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in own)])
    known = np.zeros(batch.num_rows, np.int64)
    for k, c in enumerate(own):
        known |= c.is_valid().to_numpy(zero_copy_only=False).astype(np.int64) << k
    return values, known


def _days(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).cast(pa.int32()).to_numpy(zero_copy_only=False)


def _group_sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (date, w0, w, columns, residual): for each date and set of known values the Gram matrices weighted by w0, plain, and weighted by w."""
    parts: dict[tuple[int, int, int, int], np.ndarray] = {}
    for batch in it:
        if batch.num_rows:
            values, known = _read(batch, 3)
            none = np.full(batch.num_rows, -1, np.int32)
            w0, w = (batch.column(k).fill_null(0.0).to_numpy(zero_copy_only=False) for k in (1, 2))
            _add(parts, (_days(batch), none, none, known), values, (w0, values[0], w))
        if len(parts) > GROUPS:
            yield _batch(parts)
            parts = {}
    if parts:
        yield _batch(parts)


def _fold_sums(asked: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (date, numbers of names by ridge step, w, columns, residual) in the order of date and ticker: Gram matrices of the folds, weighted by w and plain.

    asked: the known values that a row of each ridge step has. A task counts a date's names as they come and holds none of them.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int, int, int], np.ndarray] = {}
        seen: dict[tuple[int, int], int] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            values, known = _read(batch, 2 + len(asked))
            days, w = _days(batch), batch.column(1 + len(asked)).fill_null(0.0).to_numpy(zero_copy_only=False)
            for at, (k, needed) in enumerate(asked.items()):
                rows = np.flatnonzero(known & needed == needed)
                if not len(rows):
                    continue
                day = days[rows]
                number = batch.column(1 + at).fill_null(0).to_numpy(zero_copy_only=False)[rows]
                starts = np.flatnonzero(np.r_[True, day[1:] != day[:-1]])
                fold = np.empty(len(rows), np.int32)
                for lo, hi in zip(starts, np.r_[starts[1:], len(rows)], strict=True):
                    before = seen.get((int(day[lo]), k), 0)
                    fold[lo:hi] = folds(int(number[lo]), FOLDS)[before : before + hi - lo]
                    seen[int(day[lo]), k] = before + int(hi - lo)
                _add(parts, (day, np.full(len(rows), k, np.int32), fold, known[rows]), values[:, rows], (w[rows], np.ones(len(rows))))
            if len(parts) > GROUPS:
                yield _batch(parts)
                parts = {}
        if parts:
            yield _batch(parts)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The parts of one date, a row a group."""
    parts: dict[tuple[int, int, int, int], np.ndarray] = {}
    days = table["date"].cast(pa.int32()).to_pylist()
    for day, step, fold, known, part in zip(days, table["step"].to_pylist(), table["fold"].to_pylist(), table["known"].to_pylist(), table["part"], strict=True):
        key, part = (day, step, fold, known), part.values.to_numpy(zero_copy_only=False)
        parts[key] = parts[key] + part if key in parts else part
    return pa.Table.from_batches([_batch(parts)])


def _composed(matrices: np.ndarray, lines: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The Gram matrix of linear combinations `lines` of the columns, over the used groups."""
    return np.einsum("qis,qst,qjt->ij", lines[used], matrices[used], lines[used], optimize=True)


def _date_fits(steps: Sequence[Step], min_names: int, earlier: Sequence[Step]) -> Callable[[pa.Table], pa.Table]:
    """One date's parts, and coefficients of earlier steps as parts of step -2, to its steps' fits."""
    columns = _columns(steps, earlier)
    size = len(columns) + 2
    upper = np.triu_indices(size)
    dealt = sum(1 << j for j, c in enumerate((*columns, "resid")) if c in _dealt(steps, earlier))
    sums = pa.struct([(c, pa.float64()) for c in ("n", "total", "squares")])
    kind = pa.list_(pa.struct([("intercept", pa.float64()), ("slopes", pa.list_(pa.float64())), ("r2", pa.float64()), ("ridge", pa.float64()), ("orth", pa.list_(pa.list_(pa.float64()))), ("left", sums)]))
    of_groups = pa.list_(pa.struct([("known", pa.int64()), ("lines", pa.list_(pa.list_(pa.float64())))]))
    schema = pa.schema([("date", pa.date32()), ("given", sums), ("steps", kind), ("groups", of_groups)])

    def squares(part: np.ndarray) -> np.ndarray:
        flat = part.reshape(-1, len(upper[0]))
        out = np.zeros((len(flat), size, size))
        out[:, upper[0], upper[1]] = flat
        out[:, upper[1], upper[0]] = flat
        return out

    def run(table: pa.Table) -> pa.Table:
        date, (table,) = table["date"][0], _merged(table).to_batches()
        whole: dict[int, np.ndarray] = {}
        by_fold: dict[int, dict[int, dict[int, np.ndarray]]] = {}
        found_before: dict[tuple[int, int], np.ndarray] = {}
        for step, fold, known, part in zip(table["step"].to_pylist(), table["fold"].to_pylist(), table["known"].to_pylist(), table["part"], strict=True):
            part = part.values.to_numpy(zero_copy_only=False)
            if step == -2:
                found_before[fold, known] = part
            elif step == -1:
                whole[known] = squares(part)
            else:
                by_fold.setdefault(step, {}).setdefault(fold, {})[known] = squares(part)
        if not whole:
            return schema.empty_table()
        groups = sorted(whole)
        place = {g & dealt: q for q, g in enumerate(groups)}  # any of the groups alike in what the ridge steps know
        own, plain, weighted = (np.stack([whole[g][k] for g in groups]) for k in range(3))
        has = np.array([[bool(g >> j & 1) for j in range(size - 1)] for g in groups])
        alive = has[:, -1].copy()
        # the columns as they are now, and the residual, as combinations of (1, columns, residual) as given; none where they are missing
        lines = np.zeros((len(groups), size, size))
        lines[:, 0, 0] = 1
        lines[:, range(1, size), range(1, size)] = has
        for k, step in enumerate(earlier):
            new = {}
            for i, c in enumerate(step.columns):
                if c in columns and (k, i) in found_before:
                    used, before = has[:, columns.index(c)], [0, *(1 + columns.index(p) for p in step.before)]
                    new[c] = used, np.einsum("p,qps->qs", found_before[k, i], lines[used][:, before])
            for c, (used, explained) in new.items():
                lines[used, 1 + columns.index(c)] -= explained
        out, left = [], [[] for _ in groups]

        def moments() -> dict[str, float]:
            y, p = lines[alive, -1], plain[alive]
            return {"n": float(p[:, 0, 0].sum()), "total": float(np.einsum("qs,qs->", y, p[:, 0])), "squares": float(np.einsum("qs,qst,qt->", y, p, y))}

        given = moments()
        for k, step in enumerate(steps):
            at = [1 + columns.index(c) for c in step.columns]
            before = [0, *(1 + columns.index(p) for p in step.before)]
            orth = []
            for c in at if step.before else ():
                used, both = has[:, c - 1], lines[:, [*before, c]]
                g = _composed(own, both, used)
                weight = own if g[0, 0] > 0 else plain
                g = g if g[0, 0] > 0 else _composed(plain, both, used)
                if plain[used, 0, 0].sum() < min_names or not g[0, 0] > 0:
                    orth.append(None)
                    continue
                b = _swept_first(g / g[0, 0], len(before))[:-1, -1]
                lines[used, c] -= np.einsum("p,qps->qs", b, both[used, :-1])
                if _composed(weight, lines[:, [c]], used)[0, 0] <= TOLERANCE * g[-1, -1]:
                    lines[used, c] = 0  # the priors explain all of it; what is left is rounding
                orth.append(b.tolist())
            used = alive & has[:, [c - 1 for c in at]].all(axis=1)
            n = plain[used, 0, 0].sum()
            row = {"intercept": None, "slopes": None, "r2": None, "ridge": step.grid[0] if len(step.grid) == 1 else 0.0, "orth": orth}
            alive = np.zeros(len(groups), bool)
            picked = [0, *at, size - 1]
            if n >= max(min_names, 10):
                g = _composed(weighted, lines[:, picked], used)
                b = None
                if step.grid:
                    pairs = []
                    for _, of in sorted(by_fold.get(k, {}).items()):
                        q = [place[x] for x in of]
                        pairs.append(tuple(_composed(np.stack([m[v] for m in of.values()]), lines[q][:, picked], np.ones(len(q), bool)) for v in (0, 1)))
                    path = Path(g)
                    if len(step.grid) > 1:
                        row["ridge"] = best_ridge(pairs, path, step.grid, min_names, step.default, "folds")
                    b = path.slopes(row["ridge"])
                    row |= {"intercept": float(path.means[-1] - b @ path.means[:-1]), "r2": 1 - path.error(b) / path.spread if path.spread > 0 else 0.0}
                elif g[0, 0] > 0:
                    g = g / g[0, 0]
                    s = _swept_first(g, len(at) + 1)
                    if np.all(np.diag(s)[1:-1] != 0):
                        b, total = s[1:-1, -1], g[-1, -1] - g[0, -1] ** 2
                        row |= {"intercept": float(s[0, -1]), "r2": float(1 - s[-1, -1] / total) if total > 0 else None}
                if b is not None:
                    row["slopes"] = b.tolist()
                    alive = used
                    lines[used, -1] -= row["intercept"] * lines[used, 0] + np.einsum("p,qps->qs", b, lines[used][:, at])
            out.append(row | {"left": moments()})
            for q, of_group in enumerate(left):
                of_group.append(lines[q, -1].tolist() if alive[q] else None)
        by_group = [{"known": g, "lines": of_group} for g, of_group in zip(groups, left, strict=True) if of_group[0] is not None]
        return pa.Table.from_arrays([pa.array([date.as_py()], pa.date32()), pa.array([given], sums), pa.array([out], kind), pa.array([by_group], of_groups)], schema=schema)

    return run


def block_fits(rows: DataFrame, steps: Sequence[Step], min_names: int, hold: Hold = lambda df: df, earlier: Sequence[tuple[Sequence[Step], DataFrame]] = ()) -> DataFrame:
    """(date, given, steps, groups) out of rows (date, ticker, w, w0, resid, columns as given): the fits of each step, intercept and slopes NULL without one, with number,
    sum and sum of squares of what it leaves, as of what is given; and for each set of known values what each step leaves as a combination of (1, columns, resid).

    hold: applied to what is a row a date or a few. earlier: steps and fits of earlier blocks, in order; resid is what these left.
    """
    past = [s for block, _ in earlier for s in block]
    columns, dealt = _columns(steps, past), _dealt(steps, past)
    values = [F.col(c).cast("double").alias(f"__x{j}") for j, c in enumerate((*columns, "resid"))]
    own = F.col("w0") if any(s.before for s in steps) else F.col("w")
    sums = rows.select("date", own.cast("double").alias("__w0"), F.col("w").cast("double").alias("__w"), *values).mapInArrow(_group_sums, _PARTS)
    parts = sums
    if chosen := _chosen(steps):
        parts = hold(sums.groupBy("date").applyInArrow(_merged, _PARTS))
        needed = {k: {c for s in steps[: k + 1] for c in s.columns} | {"resid"} for k in chosen}
        bits = {k: sum(1 << j for j, c in enumerate((*columns, "resid")) if c in names) for k, names in needed.items()}
        cells = (len(columns) + 2) * (len(columns) + 3) // 2
        count = lambda k: F.sum(F.when(F.col("known").bitwiseAND(F.lit(bits[k])) == bits[k], F.get("part", F.lit(cells)))).cast("long").alias(f"__n{k}")
        numbers = hold(parts.groupBy("date").agg(*map(count, chosen)))
        # only what the ridge steps need is dealt by date
        used = {f"__x{j}": c in dealt for j, c in enumerate((*columns, "resid"))}
        known = rows.dropna(subset=[*needed[chosen[0]]]).select("date", "ticker", F.col("w").cast("double").alias("__w"), *values).select("date", "ticker", "__w", *(x for x in used if used[x]))
        known = known.repartition("date").join(F.broadcast(numbers), "date").sortWithinPartitions("date", "ticker")
        of_folds = known.select("date", *(f"__n{k}" for k in chosen), "__w", *(F.col(x) if used[x] else F.lit(None).cast("double").alias(x) for x in used)).mapInArrow(_fold_sums(bits), _PARTS)
        parts = parts.unionByName(of_folds)
    at = 0
    for block, fits in earlier:
        if any(s.before and {*s.columns} & {*columns} for s in block):
            orth = fits.select("date", F.posexplode("steps").alias("k", "s")).select("date", "k", F.posexplode("s.orth").alias("i", "part")).where(F.col("part").isNotNull())
            parts = parts.unionByName(orth.select("date", F.lit(-2).alias("step"), (F.col("k") + at).alias("fold"), F.col("i").cast("long").alias("known"), "part"))
        at += len(block)
    return hold(parts.groupBy("date").applyInArrow(_date_fits(steps, min_names, past), _FITS))


def stripped(rows: DataFrame, fits: DataFrame, steps: Sequence[Step], earlier: Sequence[Step] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with resid as the steps leave it, (k, date, ticker, x) of what each step leaves).

    A row without all of a step's columns, and a date without a fit, has no residual from there on.
    """
    columns = [*_columns(steps, earlier), "resid"]
    known = F.lit(0).cast("long")
    for j, c in enumerate(columns):
        known = known + F.when(F.col(c).isNotNull(), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
    of_groups = fits.select("date", F.inline("groups")).withColumnRenamed("known", "__known").withColumnRenamed("lines", "__lines")
    joined = rows.withColumn("__known", known).join(F.broadcast(of_groups), ["date", "__known"], "left")  # a few rows a date

    def along(line: Column) -> Column:
        out = F.get(line, F.lit(0))
        for j, c in enumerate(columns, 1):
            out = out + F.get(line, F.lit(j)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return out

    each = joined.select("date", "ticker", *columns, F.posexplode("__lines").alias("k", "__line")).where(F.col("__line").isNotNull())
    rest = joined.withColumn("resid", along(F.get("__lines", F.lit(len(steps) - 1)))).drop("__known", "__lines")
    return rest, each.select("k", "date", "ticker", along(F.col("__line")).alias("x"))
