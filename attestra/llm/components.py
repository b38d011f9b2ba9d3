"""Connected components by joins: least labels with pointer jumping, written to the shared folder each round.

Defined cases: a link of an id with itself makes it a component; repeated links and both directions count once; links with
a null end link nothing; without links the result is empty. A hub, an id with very many links, makes a long join key on the
side of the links only, which adaptive execution splits, as the other side has one row for each id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared import Scratch


def least_reachable(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every id in edges (a, b): the least id that links reach. Written tables; only a count of the
    labels that changed comes to the driver."""
    both = scratch.write(
        edges.select("a", "b").where("a is not null and b is not null").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a is not null and b is not null")).distinct(), f"{name}_links"
    )
    labels = scratch.write(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), f"{name}_0"
    )
    step = 0
    while True:
        step += 1
        reached = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(reached, labels.id == reached.a).select("id", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("then"))
        new = lower.join(jump, "now").select("id", F.least("now", "then").alias("component"), (F.least("now", "then") < F.col("was")).alias("moved"))
        new = scratch.write(new, f"{name}_{step}")
        scratch.remove(f"{name}_{step - 1}")
        if not new.where("moved").limit(1).count():
            scratch.remove(f"{name}_links")
            return new.select("id", "component")
        labels = new.select("id", "component")
