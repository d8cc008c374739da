"""Order-dependent column operations that split hot sessions over tasks.

A plain ``Window.partitionBy(session)`` sorts a whole session in one task,
which fails when one session holds a large share of all raw samples. Here a
session is cut into time chunks: each (session, chunk) is its own window
partition, and only one summary row per chunk is ordered across the session.
The chunk summaries are then joined back, so that results equal the ones of
the uncut window. Raw-sample operators use this class; operators on window
grids (already aggregated, bounded by recording length) use plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 86_400


class Ordered:
    """Rows of ``df`` in (``ts``, ``ties``) order within ``keys``."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str] = ("session_id",),
        ts: str = "ts",
        ties: Sequence[str] = (),
        chunk_seconds: int = CHUNK_SECONDS,
    ):
        self.keys = list(keys)
        self.ts = ts
        self.ties = list(ties)
        self.chunk_seconds = chunk_seconds
        chunk = F.floor(F.unix_micros(ts) / F.lit(chunk_seconds * 1_000_000)).cast("bigint")
        self.df = df if "_chunk" in df.columns else df.withColumn("_chunk", chunk)

    # -- pieces ---------------------------------------------------------
    @property
    def _order(self) -> list[str]:
        return [self.ts, *self.ties]

    def _inner(self):
        return Window.partitionBy(*self.keys, "_chunk").orderBy(*self._order)

    def _outer(self):
        return Window.partitionBy(*self.keys).orderBy("_chunk")

    def _position(self) -> Column:
        return F.struct(*self._order)

    def _again(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.ts, self.ties, self.chunk_seconds)

    def apply(
        self,
        lag: dict[str, str] | None = None,
        lead: dict[str, str] | None = None,
        running_sum: dict[str, str] | None = None,
        total: dict[str, str] | None = None,
        last_known: dict[str, tuple] | None = None,
        next_known: dict[str, tuple] | None = None,
    ) -> "Ordered":
        """All named outputs in one pass: the input is read twice (rows, and one
        summary row per chunk) however many outputs are asked for.

        ``lag`` / ``lead`` / ``running_sum`` (inclusive) / ``total`` (over the whole
        key) map output → column; ``last_known`` / ``next_known`` map output →
        (value, present): the nearest value at or before / after the row among
        rows where ``present``."""
        lag, lead, running_sum, total = lag or {}, lead or {}, running_sum or {}, total or {}
        last_known, next_known = last_known or {}, next_known or {}
        df = self.df
        prev_row = F.struct(*[F.col(c).alias(o) for o, c in lag.items()]) if lag else None
        next_row = F.struct(*[F.col(c).alias(o) for o, c in lead.items()]) if lead else None
        pos = self._position()
        kept = {o: F.when(_c(p), F.struct(_c(v).alias("v"))) for o, (v, p) in {**last_known, **next_known}.items()}
        placed = {o: F.when(_c(p), F.struct(pos.alias("p"), _c(v).alias("v"))) for o, (v, p) in {**last_known, **next_known}.items()}

        aggs, carries = [], []
        up = self._outer()
        before = up.rowsBetween(Window.unboundedPreceding, -1)
        # looking ahead = looking back in descending order: Spark evaluates growing
        # frames row by row, but would restart a shrinking frame at every row
        after = Window.partitionBy(*self.keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        if lag:
            aggs.append(F.max(F.struct(pos.alias("p"), prev_row.alias("v"))).alias("_lag"))
            carries.append(F.lag("_lag.v").over(up).alias("_lag"))
        if lead:
            aggs.append(F.min(F.struct(pos.alias("p"), next_row.alias("v"))).alias("_lead"))
            carries.append(F.lead("_lead.v").over(up).alias("_lead"))
        for o, c in running_sum.items():
            aggs.append(F.sum(c).alias(f"_s_{o}"))
            carries.append(F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_s_{o}"))
        for o, c in total.items():
            aggs.append(F.sum(c).alias(f"_a_{o}"))
            carries.append(F.sum(f"_a_{o}").over(Window.partitionBy(*self.keys)).alias(o))
        for o in last_known:
            aggs.append(F.max(placed[o]).alias(f"_k_{o}"))
            carries.append(F.last(f"_k_{o}", ignorenulls=True).over(before).alias(f"_k_{o}"))
        for o in next_known:
            aggs.append(F.min(placed[o]).alias(f"_k_{o}"))
            carries.append(F.last(f"_k_{o}", ignorenulls=True).over(after).alias(f"_k_{o}"))
        summary = df.groupBy(*self.keys, "_chunk").agg(*aggs).select(*self.keys, "_chunk", *carries)

        inner = self._inner()
        upto = inner.rowsBetween(Window.unboundedPreceding, 0)
        onward = Window.partitionBy(*self.keys, "_chunk").orderBy(*[F.desc(c) for c in self._order]).rowsBetween(Window.unboundedPreceding, 0)
        near: dict[str, Column] = {}
        if lag:
            near["_n_lag"] = F.lag(prev_row).over(inner)
        if lead:
            near["_n_lead"] = F.lead(next_row).over(inner)
        near |= {f"_n_s_{o}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for o, c in running_sum.items()}
        near |= {f"_n_{o}": F.last(kept[o], ignorenulls=True).over(upto) for o in last_known}
        near |= {f"_n_{o}": F.last(kept[o], ignorenulls=True).over(onward) for o in next_known}
        out = df.withColumns(near) if near else df
        out = out.join(summary, [*self.keys, "_chunk"], "left")
        final: dict[str, Column] = {}
        for o in lag:
            final[o] = F.coalesce("_n_lag", "_lag")[o]
        for o in lead:
            final[o] = F.coalesce("_n_lead", "_lead")[o]
        for o in running_sum:
            final[o] = F.col(f"_n_s_{o}") + F.col(f"_s_{o}")
        for o in [*last_known, *next_known]:
            final[o] = F.when(F.col(f"_n_{o}").isNotNull(), F.col(f"_n_{o}.v")).otherwise(F.col(f"_k_{o}.v"))
        helpers = [*near, "_lag", "_lead", *[f"_s_{o}" for o in running_sum], *[f"_k_{o}" for o in [*last_known, *next_known]]]
        return self._again(out.withColumns(final).drop(*helpers))

    # -- single operations ------------------------------------------------
    def lag(self, **outputs: str) -> "Ordered":
        """Value of the previous row: ``lag(prev_cnt="cnt")``."""
        return self.apply(lag=outputs)

    def lead(self, **outputs: str) -> "Ordered":
        return self.apply(lead=outputs)

    def running_sum(self, **outputs: str) -> "Ordered":
        """Inclusive running sum of each named column."""
        return self.apply(running_sum=outputs)

    def islands(self, island: str, new_run: Column) -> "Ordered":
        """Number maximal runs: ``island`` grows by one at rows where ``new_run``."""
        marked = self._again(self.df.withColumn("_new", F.coalesce(new_run, F.lit(False)).cast("bigint")))
        done = marked.running_sum(**{island: "_new"})
        return self._again(done.df.drop("_new"))

    def done(self) -> DataFrame:
        return self.df.drop("_chunk")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x

