"""Distributed label dictionaries (K1, K2) and sparse standardisation (K4).

The labels of all categorical columns are counted in one grouped pass and
numbered by frequency through range-partitioned offsets, so no list of
labels reaches the driver: only one label count a column does.  Rows find
their numbers by an equi-join, which the planner broadcasts or shuffles by
the dictionary's size.

Standardising keeps vectors sparse: a one-hot slot's mean and deviation
follow from its label's count, and the centring term is one constant of a
linear model's intercept instead of a dense vector a row.  Trees need neither.

A null label, and one that the dictionary lacks, has the number of labels as
its index and no hot slot, as in the stock encoder's "keep" mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.operators.features import scorable
from parcela.operators.numbering import numbered
from parcela.schema import CATEGORICAL_FEATURES, FLAG_COLUMNS, NUMERIC_FEATURES
from parcela.session import checkpointed


def quoted(c: str) -> Column:
    return F.col(f"`{c}`")


def labels_of(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """(column_name, label, more...) of every row and column, in long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("label")) for c in columns])
    return df.select(*more, F.inline(pairs))


def label_dictionary(df: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """K1: (column_name, label, n, label_index), the most frequent label first, ties by label."""
    return numbered_labels(labels_of(df, columns).groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("n")))


def numbered_labels(counts: DataFrame) -> DataFrame:
    """The dictionary from rows (column_name, label, n); labels of no row have no place in it."""
    placed = numbered(counts.where("label IS NOT NULL AND n > 0").select("column_name", "label", "n"),
                      [F.col("column_name"), F.desc("n"), F.col("label")], "place")
    first = placed.groupBy("column_name").agg(F.min("place").alias("first"))
    return checkpointed(placed.join(first, "column_name").select("column_name", "label", "n", (F.col("place") - F.col("first")).alias("label_index")))


def label_counts(dictionary: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> dict[str, int]:
    """Labels a column: one number for each of ``columns``."""
    found = {r.column_name: r["count"] for r in dictionary.groupBy("column_name").count().collect()}
    return {c: found.get(c, 0) for c in columns}


def encode(df: DataFrame, dictionary: DataFrame, columns: list[str] = CATEGORICAL_FEATURES, suffix: str = "_idx") -> DataFrame:
    """K1 on rows: ``<column>_idx`` long beside the columns of ``df``."""
    sizes = label_counts(dictionary, columns)
    out = df
    for c in columns:
        mine = dictionary.where(F.col("column_name") == c).select(F.col("label").alias("_label"), F.col("label_index").alias("_index"))
        out = (out.join(mine, quoted(c).cast("string") == F.col("_label"), "left")
               .withColumn(c + suffix, F.coalesce("_index", F.lit(sizes[c]).cast("long"))).drop("_label", "_index"))
    return out


def indexed_labels(df: DataFrame, learn: Column, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """(column_name, label, label_index, vec_size, hot_pos, listings): K1 and K2 of each label in
    ``df``, by the dictionary of its rows where ``learn`` holds.

    One pass counts all labels and those learnt from; the rest works on the counts.
    ``hot_pos`` is -1 where no slot is hot; the encoder drops the slot of unknown labels.
    """
    seen = checkpointed(labels_of(df, columns, learn.alias("_learn")).groupBy("column_name", "label")
                        .agg(F.count(F.lit(1)).alias("listings"), F.count_if("_learn").alias("n")))
    dictionary = numbered_labels(seen)
    sizes = label_counts(dictionary, columns)
    size = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(sizes[c]).cast("long"))])[F.col("column_name")]
    joined = seen.drop("n").join(dictionary.select("column_name", "label", "label_index"), ["column_name", "label"], "left")
    return joined.select("column_name", "label", F.coalesce("label_index", size).alias("label_index"), size.alias("vec_size"),
                         F.coalesce("label_index", F.lit(-1).cast("long")).alias("hot_pos"), "listings")


def moments(train: DataFrame, numeric: list[str] = NUMERIC_FEATURES, flags: list[str] = FLAG_COLUMNS,
            categorical: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """K4: (feature_index, mean, std) of each slot of the feature vector over the rows that can be assembled.

    Labels are those of all rows of ``train``; one pass counts them and one
    takes the numbers' moments.  ``std`` is the sample deviation; it is null for fewer than two rows.
    """
    plain = [*flags, *numeric]
    whole = scorable(numeric)
    value = lambda c: F.when(whole, quoted(c).cast("double"))
    stats = train.agg(F.count_if(whole).alias("n_rows"), *[f(value(c)).alias(f"{k}{i}") for i, c in enumerate(plain) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    stats = checkpointed(stats)
    dense = stats.select(F.inline(F.array(*[F.struct(F.lit(i).alias("feature_index"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                                            for i in range(len(plain))])))
    hot = checkpointed(labels_of(train, categorical, whole.alias("_whole")).groupBy("column_name", "label")
                       .agg(F.count(F.lit(1)).alias("n"), F.count_if("_whole").alias("k")))
    dictionary = numbered_labels(hot)
    starts, at = {}, len(plain)
    for c, n in label_counts(dictionary, categorical).items():
        starts[c], at = at, at + n
    start = F.create_map(*[F.lit(x) for c in categorical for x in (c, starts[c])])[F.col("column_name")]
    slots = dictionary.select("column_name", "label", "label_index").join(hot.drop("n"), ["column_name", "label"], "left").join(stats.select("n_rows"))
    n, k = F.col("n_rows").cast("double"), F.coalesce("k", F.lit(0)).cast("double")
    share = F.try_divide(k, n)
    sparse = slots.select((start + F.col("label_index")).cast("int").alias("feature_index"), share.alias("mean"),
                          F.sqrt(F.try_divide(n * share * (1 - share), n - 1)).alias("std"))
    return dense.unionByName(sparse)
