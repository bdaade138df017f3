"""Aggregation: rows to measures, once, so that averages and distinct counts are exact whatever tables were merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions import AGGREGATES
from ..model import Measure
from ..plans.context import AXIS, INPUT, Plan, quoted

#: How results of parts of a group add up, for the aggregates that can.
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def state(m: Measure) -> Column:
    """A measure's aggregate over its inputs; inputs of counts are numbers to be summed."""
    x = quoted(INPUT.format(m.name))
    if m.agg == "count":
        return F.coalesce(F.sum(x), F.lit(0).cast("long"))
    return AGGREGATES[m.agg](x, *m.args)


def merge_states(p: Plan, df: DataFrame) -> DataFrame:
    """A branch aggregated by itself, its results standing as inputs."""
    if bad := [m.name for m in p.measures.values() if m.agg not in MERGE]:
        raise RequestError("PLAN_E_2304", f"{bad} can't be merged from results of branches")
    aggs = [MERGE[m.agg](quoted(INPUT.format(n))).alias(INPUT.format(n)) for n, m in p.measures.items()]
    keys = [quoted(g) for g in (*p.group, *map(AXIS.format, p.axes))]
    return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()


def semi_additive(p: Plan, df: DataFrame) -> tuple[DataFrame, dict[str, Measure]]:
    """Rows on which each measure may be aggregated over all dimensions.

    Measures that don't add up over an axis see only the rows at its last or first value in their group, or, for an
    average, one row for each value. Each strategy's rows stand beside the others' with nulls for their measures, so
    one aggregation serves all. The last value is a partial aggregate joined back, never a window over a whole group.
    """
    plans: dict[tuple, list[str]] = {}
    for n, m in p.measures.items():
        axes = tuple(a for a in m.axes if a not in p.group or a in p.grains)
        plans.setdefault((axes, m.strategy) if axes else (), []).append(n)
    if set(plans) <= {()}:
        return df, p.measures
    types = dict(df.dtypes)
    measures, frames = dict(p.measures), []
    keys = list(p.group)
    for how, names in plans.items():
        x = df
        if how:
            axes, strategy = how
            cols = [AXIS.format(a) for a in axes]
            if strategy == "average":
                x = x.groupBy(*map(quoted, [*keys, *cols])).agg(*[state(p.measures[n]).alias(INPUT.format(n)) for n in names])
                measures |= {n: Measure(n, "avg", p.measures[n].data_type) for n in names}
                p.note(f"average over {', '.join(axes)} of {', '.join(names)}")
            else:
                pick = F.max if strategy in ("latest", "last") else F.min
                at = F.struct(*map(quoted, cols)) if len(cols) > 1 else quoted(cols[0])
                edge = x.groupBy(*[quoted(k).alias(f"__g_{k}") for k in keys]).agg(pick(at).alias("__edge"))
                on = [quoted(k).eqNullSafe(quoted(f"__g_{k}")) for k in keys] + [at == F.col("__edge")]
                x = x.join(edge, reduce(lambda a, b: a & b, on), "left_semi")
                p.note(f"{strategy} {', '.join(axes)} for {', '.join(names)}")
        frames.append(x.select(*map(quoted, keys), *[(quoted(INPUT.format(n)) if n in names else F.lit(None).cast(types[INPUT.format(n)])).alias(INPUT.format(n)) for n in p.measures]))
    return reduce(lambda a, b: a.unionByName(b), frames), measures


#: Buckets of values for each factor of e between them.
_FINE = 4096


def _bucket(v: Column) -> Column:
    """A number that never falls as v grows: its sign and the steps of its logarithm; not-a-number comes last."""
    steps = F.floor(F.ln(F.abs(v)) * _FINE) + F.lit(1000 * _FINE)  # logarithms of doubles lie between -745 and 710
    return F.when(F.isnan(v), F.lit(2**62)).when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * steps.cast("long"))


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """keys (one `__one` if there are none) and exact continuous percentiles of the wanted measures' inputs, null for none.

    Equal values are counted first, then buckets of values; running sums over a group's buckets, at most some ten million
    whatever its size, tell which bucket holds a rank, and only that bucket's values are put in order. So no task holds all
    values of a group, only those that differ and lie within a 4096th of each other.
    """
    q = lambda c: F.col(f"`{c}`")
    names = list(wanted)
    each = F.array(*[F.struct(F.lit(k).alias("__tag"), quoted(INPUT.format(n)).cast("double").alias("__v")) for k, n in enumerate(names)])
    by = [*keys, "__tag"]
    share = F.element_at(F.array(*[F.lit(float(wanted[n])) for n in names]), F.col("__tag") + 1)
    counts = df.select(*map(q, keys), F.explode(each).alias("__e")).select(*map(q, keys), "__e.*").filter("__v is not null")
    counts = counts.groupBy(*map(q, by), "__v").agg(F.count("*").alias("__n")).withColumn("__b", _bucket(F.col("__v")))
    order = Window.partitionBy(*map(q, by)).orderBy("__b")
    buckets = counts.groupBy(*map(q, by), "__b").agg(F.sum("__n").alias("__n"))
    buckets = buckets.withColumns({"__to": F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__rank": (F.sum("__n").over(Window.partitionBy(*map(q, by))) - 1) * share})
    holds = lambda rank: (F.col("__to") - F.col("__n") <= rank) & (rank < F.col("__to"))
    hit = buckets.filter(holds(F.floor("__rank")) | holds(F.ceil("__rank")))
    hit = hit.select(*[q(c).alias(f"__h{n}") for n, c in enumerate(by)], F.col("__b").alias("__hb"), (F.col("__to") - F.col("__n")).alias("__before"), "__rank")
    on = [q(c).eqNullSafe(F.col(f"__h{n}")) for n, c in enumerate(by)] + [F.col("__b") == F.col("__hb")]
    inside = Window.partitionBy(*map(q, by), "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    values = counts.join(hit, reduce(lambda a, b: a & b, on)).withColumn("__upto", F.col("__before") + F.sum("__n").over(inside))
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
    found = values.groupBy(*map(q, by)).agg(at(F.floor("__rank")).alias("__x"), at(F.ceil("__rank")).alias("__y"), F.first("__rank").alias("__rank"))
    value = F.col("__x") + (F.col("__y") - F.col("__x")) * (F.col("__rank") - F.floor("__rank"))
    group = list(map(q, keys)) or [F.lit(1).alias("__one")]
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("__tag") == k, value)).alias(n) for k, n in enumerate(names)])


def aggregate(p: Plan, df: DataFrame) -> DataFrame:
    """group and a column for each measure, of its declared type."""
    df, measures = semi_additive(p, df)
    keys = [quoted(g) for g in p.group]
    if not measures:
        return df.select(*keys).distinct()
    ranked = {n: float((m.args or (0.5,))[0]) for n, m in measures.items() if m.agg in ("median", "percentile_cont")}
    states = [state(m).alias(n) for n, m in measures.items() if n not in ranked]
    if ranked:
        out = df.groupBy(*keys).agg(*states) if keys and states else df.select(*keys).distinct() if keys else df.agg(F.lit(1).alias("__one"), *states)
        found = percentiles(df, list(p.group), ranked)
        names = list(p.group) or ["__one"]
        found = found.select(*[quoted(g).alias(f"__j{n}") for n, g in enumerate(names)], *map(quoted, ranked))
        out = out.join(found, reduce(lambda a, b: a & b, [quoted(g).eqNullSafe(F.col(f"__j{n}")) for n, g in enumerate(names)]), "left")
        p.note(f"ranks for {', '.join(ranked)}")
    else:
        out = df.groupBy(*keys).agg(*states) if keys else df.agg(*states)
    return out.select(*keys, *[(quoted(n).cast(m.data_type) if m.data_type is not None else quoted(n)).alias(n) for n, m in p.measures.items()])
