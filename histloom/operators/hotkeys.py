"""Per-key results under heavy skew, by eager aggregation on both sides of a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_sum(
    left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str], left_sums: Sequence[str] = (), right_sums: Sequence[str] = ()
) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY by`` with a row count and sums of columns of either side.

    Both sides are aggregated to one compact state per join key (the left per join key and group) before
    they meet. A state joined to a state stands for n_left * n_right rows, so counts multiply and the sum
    of one side is multiplied by the other side's count; the partial results are then rolled up by group.
    No hot key reaches the shuffle as rows: the map side has already folded them.

    Rows with a null in ``on`` join nothing; null group values form their own group; nulls in summed columns
    add nothing (a sum over nothing but nulls is 0). ``rows`` is the joined row count.
    """
    cnt = lambda n: F.count(F.lit(1)).alias(n)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = left.select(*on, *by, *[F.col(c).alias(f"_l_{c}") for c in left_sums]).groupBy(*on, *by).agg(cnt("_nl"), *[zero(f"_l_{c}").alias(f"_l_{c}") for c in left_sums])
    b = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in right_sums]).groupBy(*on).agg(cnt("_nr"), *[zero(f"_r_{c}").alias(f"_r_{c}") for c in right_sums])
    return (
        a.join(b, list(on))
        .groupBy(*by)
        .agg(
            F.sum(F.col("_nl") * F.col("_nr")).alias("rows"),
            *[F.sum(F.col(f"_l_{c}") * F.col("_nr")).alias(c) for c in left_sums],
            *[F.sum(F.col(f"_r_{c}") * F.col("_nl")).alias(c) for c in right_sums],
        )
    )


def key_statistics(commits: DataFrame, keys: dict[str, Column], hash_: Column, lines: Column, files: Column) -> DataFrame:
    """For each value of each key field: commits, changed lines, distinct files and share of all commits.

    commits: one row per delivery of a commit; equal hashes are one commit. keys: field name to value
    (null values are no key; the hash must not be null). lines: changed lines. files: array of file
    identities (nulls in it are dropped; null or empty arrays touch no file).

    The commit states (hash, key) and the measure states (hash) are aggregated apart and joined on the
    hash, which is never skewed; counts multiply and sums combine. Distinct files are folded per commit,
    then per (key, file), so a hot key is spread over its files. ``share`` is of all distinct hashes,
    those without any key included. No key is split by hand and none is treated apart, so results are the
    same at every skew. Empty input gives no rows.
    """
    base = commits.select(
        hash_.alias("hash"), F.array(*[F.struct(F.lit(n).alias("key_field"), c.alias("key_value")) for n, c in keys.items()]).alias("k"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("lines"), files.alias("files"),
    ).filter(F.col("hash").isNotNull())
    by = ["key_field", "key_value"]
    of_commit = base.select("hash", F.explode("k").alias("k")).select("hash", "k.*").filter(F.col("key_value").isNotNull()).distinct()
    # a commit delivered again brings its measures again: one state per hash
    measures = base.groupBy("hash").agg(F.max("lines").alias("lines"))
    sums = eager_join_sum(of_commit, measures, ["hash"], by, right_sums=["lines"]).select(*by, F.col("rows").alias("commits"), F.col("lines").alias("changed_lines"))
    # one state per hash here too: its distinct files, which are spread only after they have met the keys
    touched = base.groupBy("hash").agg(F.array_distinct(F.flatten(F.collect_list(F.array_compact("files")))).alias("files")).filter(F.size("files") > 0)
    spread = of_commit.join(touched, "hash").select(*by, F.explode("files").alias("file")).groupBy(*by, "file").agg(F.count(F.lit(1)).alias("n"))
    files_of = spread.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_files"))
    total = base.select(F.col("hash").alias("h")).distinct().agg(F.count(F.lit(1)).alias("total"))
    return (
        sums.join(files_of, by, "left").crossJoin(F.broadcast(total))  # one row
        .select(*by, "commits", "changed_lines", F.coalesce("distinct_files", F.lit(0)).alias("distinct_files"), (F.col("commits") / F.col("total")).alias("share"))
    )
