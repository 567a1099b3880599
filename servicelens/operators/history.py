"""The last k messages of every conversation, in order, as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent_turns(turns: DataFrame, k: int = 3, key: str = "conv_id", order: str = "turn",
                 sender: str = "sender", message: str = "message") -> DataFrame:
    """``row_number() <= k`` per conversation.  Spark plans this with a partial
    WindowGroupLimit *before* the shuffle, so a very long conversation is cut to k
    rows per input partition before it is moved; the final collect is bounded by k."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = turns.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    lines = F.struct(F.col(order).alias("o"), F.concat_ws(": ", F.col(sender), F.col(message)).alias("line"))
    return (last.groupBy(key)
            .agg(F.array_sort(F.collect_list(lines)).alias("_l"), F.count(F.lit(1)).alias("turns"))
            .select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("history"), "turns"))
