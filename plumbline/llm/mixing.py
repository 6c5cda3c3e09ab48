"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. Among all document rates that meet it and
stay between 0 and the cap, the ones closest to "every document once" (in relative
entropy) are tilted exponentially by document size and cut off at the cap. One dual
variable per source gives the tilt; Newton steps on the convex dual find it, each step
being one aggregate over the different sizes of each source. Rates are then rounded to
whole copies, by a hash of the document against a threshold per source, so that the words
taken add up to the target.

What is known about a source is one row; those rows, at most ``MOST_SOURCES``, pass
through the driver. Documents never do, and a source with a third of all documents is
aggregated per task before anything is moved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.args import named_column
from plumbline.llm.common import written

MOST_SOURCES = 100_000
_BINS = 4096
_LEVELS = 3
_FLIPS = 3
_ROW = "source string, source_size bigint, target double, tilt double, scale double, below double, flips map<bigint,int>"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("bigint")


def capped_targets(
    sizes: Sequence[int], weights: Sequence[float], total: float, cap: float
) -> list[float]:
    """Shares of ``total`` by weight, at most ``cap`` times each size, the excess reshared."""
    targets = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > cap * sizes[i]}
        for i in over or free:
            targets[i] = cap * sizes[i] if over else left * weights[i] / weight
        free = free - over if over else set()
    return targets


@dataclass
class _Source:
    name: str | None
    size: int
    target: float
    scale: float
    tilt: float = 0.0
    below: float = 1.0
    flips: dict[int, int] | None = None

    def row(self) -> tuple:
        return (
            self.name, self.size, self.target, self.tilt, self.scale, self.below, self.flips or {},
        )


def _frame(spark, sources: list[_Source]) -> DataFrame:
    return spark.createDataFrame([s.row() for s in sources], _ROW)


def _with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` (id, source, size) with its source's plan; at most MOST_SOURCES rows are broadcast."""
    plan = plan.withColumnRenamed("source", "plan_source")
    return sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop(
        "plan_source"
    )


def _rate(cap: float) -> Column:
    power = F.col("tilt") * F.col("size") / F.col("scale")
    return (
        F.when(F.col("target") <= 0, 0.0)
        .when(power >= math.log(cap), cap)
        .otherwise(F.exp(power))
    )


def _drawn(planned: DataFrame, cap: float) -> DataFrame:
    """Adds rate, whole copies, key and the position at which a further copy is taken."""
    key = F.xxhash64("id", "source", "size")
    unit = F.pmod(key, F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor("rate")
    return planned.withColumn("rate", _rate(cap)).withColumns(
        {"key": key, "whole": whole, "at": unit - (F.col("rate") - whole)}
    )


def _copies(cap: float) -> Column:
    further = ((F.col("at") < F.col("below")) & (F.col("whole") < cap)).cast("bigint")
    flip = F.coalesce(F.get(F.map_values(F.map_filter("flips", lambda k, _: k == F.col("key"))), F.lit(0)), F.lit(0))
    return F.col("whole") + further + flip


def _newton(hist: DataFrame, sources: list[_Source], cap: float, rounds: int = 80) -> None:
    """Solve sum(size * rate) = target for the tilt of every source at once."""
    spark = hist.sparkSession
    low, high = {}, {}
    for s in sources:
        ratio = s.target / s.size if s.size else 0.0
        s.tilt = math.log(ratio) if 0 < ratio < cap else 0.0
    open_ = [s for s in sources if 0 < s.target < cap * s.size * (1 - 1e-12)]
    for s in sources:
        if s.size and s.target >= cap * s.size * (1 - 1e-12):
            s.tilt = math.inf
    power = F.col("tilt") * F.col("size") / F.col("scale")
    for _ in range(rounds):
        if not open_:
            return
        words = F.col("n") * F.col("size") * F.col("rate")
        slope = F.when(power < math.log(cap), words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = {
            r["source"]: r
            for r in _with_plan(hist, _frame(spark, open_)).withColumn("rate", _rate(cap))
            .groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
            .collect()
        }
        still = []
        for s in open_:
            got = sums[s.name]
            miss = s.target - got["words"]
            if abs(miss) <= 1e-9 * s.target:
                continue
            (low if miss > 0 else high)[s.name] = s.tilt
            step = s.tilt + miss / got["slope"] if got["slope"] else math.nan
            a, b = low.get(s.name), high.get(s.name)
            if a is not None and b is not None and b - a <= 1e-15 * max(1, abs(a)):
                continue
            inside = step == step and (a is None or step > a) and (b is None or step < b)
            if not inside:
                if a is None:
                    step = 2 * b - 1
                elif b is None:
                    step = 2 * a + 1 if a >= 0 else a / 2
                else:
                    step = (a + b) / 2
            s.tilt = step
            still.append(s)
        open_ = still


def _threshold(sized: DataFrame, sources: list[_Source], cap: float) -> None:
    """Place each source's threshold so that the words taken reach its target.

    Three histograms, each within one bin of the one before, find the document at which
    the target is passed.
    """
    spark = sized.sparkSession
    by_name = {s.name: s for s in sources}
    low = {s.name: -1.0 for s in sources}
    need: dict = {}
    width = 2.0
    for level in range(_LEVELS):
        for s in sources:
            s.below = low[s.name]
        drawn = _drawn(_with_plan(sized, _frame(spark, sources)), cap)
        if level == 0:
            taken = drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("n"))
            whole = {r["source"]: r["n"] for r in taken.collect()}
            need = {s.name: s.target - whole.get(s.name, 0) for s in sources}
        bins = (
            drawn.filter(F.col("whole") < cap)
            .withColumn("bin", F.floor((F.col("at") - F.col("below")) * (_BINS / width)))
            .filter(F.col("bin").between(0, _BINS - 1))
            .groupBy("source", "bin").agg(F.sum("size").alias("n"))
        )
        until = F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
        wanted = spark.createDataFrame(
            [(k, float(v)) for k, v in need.items()], "need_source string, need double"
        )
        passed = (
            bins.withColumn("until", until)
            .join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("need_source")))
            .filter(F.col("until") >= F.col("need"))
            .groupBy("source").agg(F.min(F.struct("bin", "until", "n")).alias("first"))
        )
        found = {r["source"]: r["first"] for r in passed.collect()}
        width /= _BINS
        for name, s in by_name.items():
            if name not in found:  # everything further is taken, or nothing is needed
                low[name] = 1.0 if need[name] > 0 and level == 0 else low[name] + width * _BINS
                continue
            first = found[name]
            low[name] += first["bin"] * width
            need[name] -= first["until"] - first["n"]
    for s in sources:
        s.below = low[s.name]


def _flip(sized: DataFrame, sources: list[_Source], cap: float) -> None:
    """Add or drop one copy of the document whose size is closest to what is still missing."""
    spark = sized.sparkSession
    taken = _drawn(_with_plan(sized, _frame(spark, sources)), cap).withColumn("copies", _copies(cap))
    got = {
        r["source"]: r["n"]
        for r in taken.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()
    }
    missing = {s.name: s.target - got.get(s.name, 0) for s in sources}
    wanted = spark.createDataFrame(
        [(k, float(v)) for k, v in missing.items()], "need_source string, need double"
    )
    gap = F.abs(F.abs(F.col("need")) - F.col("size"))
    possible = F.when(F.col("need") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    alone = (
        taken.join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("need_source")))
        .filter(possible & (gap < F.abs("need")))
        .groupBy("source", "key")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(gap).alias("gap"))
        .filter("rows = 1")
    )
    best = alone.groupBy("source").agg(F.min(F.struct("gap", "key")).alias("best")).collect()
    for r in best:
        s = next(s for s in sources if s.name == r["source"])
        key = r["best"]["key"]
        flips = dict(s.flips or {})
        flips[key] = flips.get(key, 0) + (1 if missing[s.name] > 0 else -1)
        s.flips = flips


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """(plan, sized): one row per source of the mix, and (id, source, size) of every row.

    Sources in code point order, null last, take the weights in turn and share ``share``
    times all words; a target stops at ``cap`` times its source's size and the excess is
    reshared by weight. Runs jobs when called.
    """
    if cap < 1 or cap != int(cap):
        raise ValueError("cap must be a whole number of at least 1")
    sized = written(
        docs.select(
            named_column(id_col).alias("id"),
            named_column(source_col).alias("source"),
            word_count(named_column(text_col)).alias("size"),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
    ).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    turns = [float(weights[i % len(weights)]) for i in range(len(totals))]
    targets = capped_targets(sizes, turns, share * sum(sizes), cap)
    sources = [
        _Source(r["source"], r["size"], t, max(r["size"], 1) / r["n"])
        for r, t in zip(totals, targets)
    ]
    if sources:
        hist = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
        _newton(hist, sources, cap)
        _threshold(sized, sources, cap)
        for _ in range(_FLIPS):
            _flip(sized, sources, cap)
    return _frame(docs.sparkSession, sources), sized


def mix_rates(sized: DataFrame, plan: DataFrame, cap: float = 2.0) -> DataFrame:
    """``sized`` with source_size, target, rate, copies and taken = copies * size.

    Null and empty texts have size 0; they take no words. Rows with equal id, source and
    size get equal copies. Null ids and null sources take part like others. An empty
    table gives no rows.
    """
    drawn = _drawn(_with_plan(sized, plan), cap).withColumn("copies", _copies(cap))
    return drawn.withColumn("taken", F.col("copies") * F.col("size")).select(
        *sized.columns, "source_size", "target", "rate", "copies", "taken"
    )


def mixed_documents(
    docs: DataFrame,
    plan: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cap: float = 2.0,
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it."""
    sized = docs.select(
        F.struct("*").alias("doc"),
        named_column(id_col).alias("id"),
        named_column(source_col).alias("source"),
        word_count(named_column(text_col)).alias("size"),
    )
    drawn = _drawn(_with_plan(sized, plan), cap).withColumn("copies", _copies(cap).cast("int"))
    return drawn.filter("copies > 0").select(
        "doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    ).select("doc.*")
