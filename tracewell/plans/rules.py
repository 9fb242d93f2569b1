"""Process rules of one's own: functions of a process tree, beside the patterns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import parent_edges

Rule = Callable[[DataFrame], DataFrame]


def process_tree(processes: DataFrame) -> DataFrame:
    """The processes, with parent (a struct like a row of ``processes``, null for a root) and n_children."""
    edges = parent_edges(processes)
    above = processes.select(F.col("proc").alias("_parent"), F.struct(*processes.columns).alias("parent"))
    kids = edges.groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = processes.join(edges.select(F.col("child").alias("_child"), F.col("parent").alias("_parent")), F.col("proc") == F.col("_child"), "left").join(above, "_parent", "left")
    return linked.join(kids, F.col("proc") == F.col("_of"), "left").select(*processes.columns, "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def apply_rules(processes: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(rule, severity, title, proc) of all rules. A rule takes the tree and gives the rows that it objects to, with proc, and, if
    it likes, severity and title; these are MEDIUM and the rule's name otherwise. No rules give no rows."""
    tree = process_tree(processes)
    kind = processes.schema["proc"].dataType.simpleString()
    none = processes.sparkSession.createDataFrame([], f"rule string, severity string, title string, proc {kind}")

    def rows(name: str, rule: Rule) -> DataFrame:
        found = rule(tree)
        told = lambda c, otherwise: F.col(c) if c in found.columns else F.lit(otherwise)
        return found.select(F.lit(name).alias("rule"), told("severity", "MEDIUM").alias("severity"), told("title", name).alias("title"), "proc")

    return reduce(DataFrame.unionByName, [rows(*x) for x in rules.items()], none)
