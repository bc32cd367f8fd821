"""Least squares from mergeable sufficient statistics.

The state of a regression is its Gram matrix: the sums of products of every
two of (1, features, target) over the rows, a group each.  States add up, so
those of old files are kept and only new rows are read; one hot group is
summed in parts before the shuffle.  The normal equations of each group are
eliminated in a task of their own; nothing reaches the driver.  One-hot slots enter as sums by label and by pair of labels: no row
is widened to its vector.

A feature that depends on those before it (a pivot below ``tolerance`` of its
own square sum) has coefficient 0, so the last labels of a column that is
never null, constant columns and groups with few rows are solved too.  Rows with a null
in a number or the target are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.operators.dictionary import label_counts, quoted
from parcela.session import ship

INTERCEPT = "(intercept)"


def _rows(df: DataFrame, numbers: list[str], target: str) -> DataFrame:
    known = F.lit(True)
    for c in [*numbers, target]:
        v = quoted(c).cast("double")
        known = known & v.isNotNull() & ~F.isnan(v)
    return df.where(known)


def gram(df: DataFrame, numbers: list[str], target: str, by: list[str] = ()) -> DataFrame:
    """(by..., i, j, s) for i <= j: sums of products; 0 is the intercept, then ``numbers``, last the target."""
    x = [F.lit(1.0), *[quoted(c).cast("double") for c in numbers], quoted(target).cast("double")]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = _rows(df, numbers, target).groupBy(*[quoted(c) for c in by]).agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs])
    entries = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(f"s{i}_{j}").alias("s")) for i, j in pairs]
    return sums.select(*[quoted(c) for c in by], F.inline(F.array(*entries))).where("s IS NOT NULL")


def gram_with_labels(df: DataFrame, numbers: list[str], labels: list[str], dictionary: DataFrame, target: str) -> DataFrame:
    """The state of intercept, ``numbers``, the one-hot slots of ``labels`` and the target, as in ``gram``."""
    rows = _rows(df, numbers, target)
    starts, at = {}, 1 + len(numbers)
    for c, n in label_counts(dictionary, labels).items():
        starts[c], at = at, at + n
    last = at
    start = F.create_map(*[F.lit(x) for c in labels for x in (c, starts[c])])
    slots = dictionary.select("column_name", "label", (start[F.col("column_name")] + F.col("label_index")).cast("long").alias("slot"))

    dense = gram(rows, numbers, target)
    place = F.when(F.col("j") == len(numbers) + 1, F.lit(last).cast("long")).otherwise(F.col("j"))
    dense = dense.select(F.when(F.col("i") == len(numbers) + 1, F.lit(last).cast("long")).otherwise(F.col("i")).alias("i"), place.alias("j"), "s")

    name = lambda c: F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("label"))
    x = {0: F.lit(1.0), **{k: quoted(c).cast("double") for k, c in enumerate(numbers, 1)}, last: quoted(target).cast("double")}
    wide = rows.select(*[v.alias(f"x{k}") for k, v in x.items()], F.inline(F.array(*[name(c) for c in labels])))
    sums = wide.groupBy("column_name", "label").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in x]).join(slots, ["column_name", "label"])
    across = sums.select("slot", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"x{k}").alias("s")) for k in x])))
    mixed = across.select(F.least("slot", "k").alias("i"), F.greatest("slot", "k").alias("j"), "s")
    own = sums.select(F.col("slot").alias("i"), F.col("slot").alias("j"), F.col("x0").alias("s"))

    two = [F.struct(name(a).alias("a"), name(b).alias("b")) for k, a in enumerate(labels) for b in labels[k + 1:]]
    if not two:
        return dense.unionByName(mixed).unionByName(own)
    met = rows.select(F.inline(F.array(*two))).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("s"))
    side = lambda k, out: slots.select(F.struct("column_name", "label").alias(k), F.col("slot").alias(out))
    pairs = met.join(side("a", "i"), "a").join(side("b", "j"), "b").select("i", "j", "s")
    return dense.unionByName(mixed).unionByName(own).unionByName(pairs)


def merge(*states: DataFrame) -> DataFrame:
    """The state of all the rows that went into the given ones."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    by = [c for c in out.columns if c != "s"]
    return out.groupBy(*[quoted(c) for c in by]).agg(F.sum("s").alias("s"))


def _eliminate(m: np.ndarray, tolerance: float) -> np.ndarray:
    """Coefficients from the augmented matrix (size, size + 1) of the normal equations.

    Columns are cleared in order; a dependent feature's row is set to 0.
    """
    m = m.copy()
    own = m.diagonal().copy()
    for k in range(len(m)):
        pivot = m[k].copy()
        if pivot[k] <= tolerance * own[k]:
            m[k] = 0
            continue
        m -= np.outer(m[:, k] / pivot[k], pivot)
        m[k] = pivot / pivot[k]
    return m[:, -1]


def solve(state: DataFrame, size: int, tolerance: float = 1e-6) -> DataFrame:
    """(by..., n, feature, coefficient): ``size`` coefficients a group, feature 0 the intercept.

    A group's matrix is ``size`` squared numbers, whatever its rows, and is
    solved in one task; the groups are solved side by side.
    """
    by = [c for c in state.columns if c not in ("i", "j", "s")]

    def run(group: pa.Table) -> pa.Table:
        i, j, s = (group.column(c).to_numpy() for c in ("i", "j", "s"))
        m = np.zeros((size + 1, size + 1))
        m[i, j] = s
        m[j, i] = s
        keys = [pa.array([group.column(c)[0].as_py()] * size, group.column(c).type) for c in by]
        return pa.Table.from_arrays([*keys, pa.array([round(m[0, 0])] * size, pa.int64()), pa.array(range(size), pa.int32()),
                                     pa.array(_eliminate(m[:size], tolerance))], [*by, "n", "feature", "coefficient"])

    types = dict(state.dtypes)
    ship(state.sparkSession)
    ddl = ", ".join([f"`{c}` {types[c]}" for c in by] + ["n long, feature int, coefficient double"])
    return state.groupBy(*[quoted(c) for c in by]).applyInArrow(run, ddl)


def predict(df: DataFrame, coefficients: DataFrame, numbers: list[str], by: list[str] = (), name: str = "prediction") -> DataFrame:
    """``df`` with the fitted value: null where a number is null or the group has no coefficients."""
    w = coefficients.groupBy(*[quoted(c) for c in by]).agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("_w"))
    value = F.element_at("_w", F.lit(0))
    for k, c in enumerate(numbers, 1):
        value = value + F.element_at("_w", F.lit(k)) * quoted(c).cast("double")
    joined = df.join(w, list(by), "left") if by else df.join(w, how="left")
    return joined.withColumn(name, value).drop("_w")
