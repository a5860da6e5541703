"""Row numbers within groups, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: str, score: str, tie: str, out: str, descending: bool = True, width: float = 0.001, count: str | None = None) -> DataFrame:
    """``df`` with the row number ``out`` (from 1) of each row of a group by score, then by the string ``tie``.

    Rows are counted by group, score and the first characters of the tie; running sums
    of the counts give each of these cells its first number, and only the rows of one
    cell are sorted together. So neither a large group nor a frequent score is one
    task's work, and no task sees more than the distinct scores of a range of ``width``.
    ``count`` names a column for the size of the group. Rows without a score are left out.
    """
    part = F.floor(F.col(score) / F.lit(width))
    # rows without a group are a group of their own, which a join would lose
    p = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    p = p.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("\0"))).withColumn("_part", -part if descending else part).withColumn("_first", F.substring(tie, 1, 2))
    order = F.col(score).desc() if descending else F.col(score)
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = p.groupBy("_g", "_part", score, "_first").agg(F.count(F.lit(1)).alias("_n"))
    of_score = cells.groupBy("_g", "_part", score).agg(F.sum("_n").alias("_n"))
    of_part = of_score.groupBy("_g", "_part").agg(F.sum("_n").alias("_n"))
    cells = cells.withColumn("_c", before(Window.partitionBy("_g", "_part", score).orderBy("_first"))).drop("_n")
    of_score = of_score.withColumn("_s", before(Window.partitionBy("_g", "_part").orderBy(order))).drop("_n")
    of_part = of_part.withColumn("_p", before(Window.partitionBy("_g").orderBy("_part")))
    if count:
        of_part = of_part.withColumn(count, F.sum("_n").over(Window.partitionBy("_g")))
    starts = cells.join(of_score, ["_g", "_part", score]).join(of_part.drop("_n"), ["_g", "_part"])
    inside = F.row_number().over(Window.partitionBy("_g", "_part", score, "_first").orderBy(tie))
    j = p.join(starts, ["_g", "_part", score, "_first"]).withColumn(out, F.col("_p") + F.col("_s") + F.col("_c") + inside)
    return j.select(*df.columns, *([count] if count else []), out)
