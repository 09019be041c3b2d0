"""What each join of a chain loses, pads and multiplies, without building any of them.

Tables joined one after the other by keys make a tree. How often a row of one table stands in the joined rows is a
product of numbers that its neighbours send along the tree: for each key, the weight of the rows behind it. So every
join is accounted for by counts per key that were added up before they were shuffled, however large its result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class Step:
    """Join `frame` under `name` to the earlier table `parent` on parent.parent_key = frame.key, "inner" or "left"."""

    name: str
    frame: DataFrame
    parent: str
    parent_key: str
    key: str
    how: str = "left"


class JoinChain:
    """A first table and the steps that join others to it. Keys that are NULL have no partner."""

    def __init__(self, name: str, frame: DataFrame, steps: list[Step]):
        self.names = [name, *(s.name for s in steps)]
        self.frames = {name: frame, **{s.name: s.frame for s in steps}}
        self.steps = steps
        for i, s in enumerate(steps):
            if s.parent not in self.names[: i + 1] or s.how not in ("inner", "left") or s.name in self.names[: i + 1]:
                raise ValueError(f"step {s.name} needs an earlier parent, a new name, and inner or left")

    def weights(self, name: str, joined: int, behind: Step | None = None, padded_at: Step | None = None) -> DataFrame:
        """(k_<step> for each edge of the table, weight): how often rows with these keys stand in the join of the first
        `joined` steps, leaving out what lies behind one of its edges; only rows that `padded_at` pads, if given."""
        steps = self.steps[:joined]
        edges = [(s, s.parent_key) for s in self.steps if s.parent == name] + [(s, s.key) for s in self.steps if s.name == name]
        x = self.frames[name].select(*(F.col(c).alias(f"k_{s.name}") for s, c in edges))
        x = x.groupBy(*x.columns).agg(F.count("*").alias("weight"))
        for s, _ in edges:
            if s is behind or s not in steps:
                continue
            down = s.parent == name
            other = self.weights(s.name if down else s.parent, joined, s, padded_at)
            sent = other.groupBy(F.col(f"k_{s.name}")).agg(F.sum("weight").alias("times"))
            x = x.join(sent, f"k_{s.name}", "left" if down else "inner")
            if down:
                # a padded row meets later inner joins with NULL keys and is lost there
                pad = 1 if s.how == "left" and all(t.how == "left" for t in self._below(s, steps)) else 0
                times = F.when(F.col("times").isNull(), pad).otherwise(0 if s is padded_at else F.col("times"))
            else:
                times = F.col("times")
            x = x.withColumn("weight", F.col("weight") * times).drop("times")
        return x

    def _below(self, s: Step, steps: list[Step]) -> list[Step]:
        own = [t for t in steps if t.parent == s.name]
        return own + [u for t in own for u in self._below(t, steps)]

    def _above(self, s: Step) -> list[Step]:
        up = next((t for t in self.steps if t.name == s.parent), None)
        return [] if up is None else [up, *self._above(up)]

    def account(self) -> DataFrame:
        """(step, how, rows_in, matched, unmatched, padded_before, rows_out): of the rows so far those with and without
        a partner, and those whose own parent row is padding. Inner joins lose the last two, left joins pad them."""
        parts = []
        for i, s in enumerate(self.steps):
            partners = s.frame.groupBy(F.col(s.key).alias(f"k_{s.name}")).agg(F.count("*").alias("m"))
            x = self.weights(s.parent, i).join(partners, f"k_{s.name}", "left")
            n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
            one = x.agg(n(F.when(F.col("m").isNotNull(), F.col("weight"))).alias("matched"), n(F.when(F.col("m").isNull(), F.col("weight"))).alias("unmatched"), n(F.col("weight") * F.col("m")).alias("pairs"))
            whole = self.weights(self.names[0], i).agg(n("weight").alias("rows_in"))
            parts.append(one.join(F.broadcast(whole)).select(F.lit(s.name).alias("step"), F.lit(s.how).alias("how"), "rows_in", "matched", "unmatched", "pairs"))  # one row each
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        before = F.col("rows_in") - F.col("matched") - F.col("unmatched")
        out = out.withColumn("padded_before", before)
        kept = F.when(F.col("how") == "left", F.col("unmatched") + F.col("padded_before")).otherwise(0)
        return out.withColumn("rows_out", F.col("pairs") + kept).drop("pairs")

    def causes(self) -> DataFrame:
        """(step, cause, n): of the rows that reach a step without a partner, how many for which join: the step itself,
        or the earlier one that padded the row it would have been joined to. Steps and causes without rows are left out."""
        out = self.account().select("step", F.col("step").alias("cause"), F.col("unmatched").alias("n"))
        for i, s in enumerate(self.steps):
            for above in self._above(s):
                n = self.weights(above.parent, i, padded_at=above).agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("n"))
                out = out.unionByName(n.select(F.lit(s.name).alias("step"), F.lit(above.name).alias("cause"), "n"))
        return out.where("n > 0")
