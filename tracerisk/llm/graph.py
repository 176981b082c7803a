"""Connected components of a graph too large for one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import BROADCAST_ROWS
from tracerisk.sources import materialize


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node of it) for every node of the links a, b (long), as a written table.

    Each round ties every node and its neighbours to the least of them, until
    every component is a star: distances shrink by half or more a round and the number of links
    doesn't grow. Least neighbours combine before the shuffle and are sent to all tasks up to
    BROADCAST_ROWS nodes; the links of a hub are only ever joined, never gathered. Each round is
    a table in the shared folder, so a lost executor costs its own tasks only.
    Links with a null end and self-links are ignored; no links give no rows.
    """
    real = links.filter(F.col("a") != F.col("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    current = materialize(real.select(low.alias("low"), high.alias("high")))
    while True:
        both = current.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
            current.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        # Written first, so that Spark can split a hub's links in the join.
        found = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("links"))
        found = materialize(found)
        # Stars: every node but the least of its component has one link, so that one goes to the least.
        nodes, tied_twice = found.agg(F.count("*"), F.count_if((F.col("m") < F.col("u")) & (F.col("links") > 1))).first()
        if not tied_twice:
            return found.select(F.col("u").alias("node"), F.col("m").alias("component"))
        least = found.select("u", "m")
        reached = F.broadcast(least) if nodes <= BROADCAST_ROWS else least
        tied = both.join(reached, "u").select("m", "v").unionByName(
            least.select("m", F.col("u").alias("v"))
        )
        tied = tied.filter(F.col("m") != F.col("v")).select(
            F.col("m").alias("low"), F.col("v").alias("high")
        )
        current = materialize(tied.distinct())
