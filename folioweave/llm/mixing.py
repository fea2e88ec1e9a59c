"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token counts are aggregated into cells (one for each combination of the margins' values). The cells' weights are raked: each
margin in turn is scaled to its target shares until all agree. One factor then turns weights into inclusion
probabilities, min(1, factor * weight), such that the expected tokens are ``fraction`` of all. A document is kept if a
hash of its id falls below its cell's probability, so a sample is reproducible and growing ``fraction`` only adds documents.

Up to CELLS cells of CELL_BYTES in all are raked in numpy on the driver and broadcast to the documents; more are raked by the same
steps as Spark aggregations and joined by Spark's choice, with the same result.

Targets are shares by value; without one a margin aims at its actual shares to the power ``temper`` (0.5: between natural and
uniform). Values without a target (share 0) are left out; targets without documents are ignored and the rest
is scaled to one.

Defined results: null is a margin value of its own ('' is another); null or blank text has no tokens, and a cell without tokens gets
probability 1 if none of its values is left out; rows with a null id are sampled by their text; an empty
table gives an empty result; other columns pass through, but one with the name of an added column gives way to it.
Where a probability is cut at 1 the kept shares fall short of the targets (``shares`` reports both) unless ``strict`` is set.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stage

CELLS, CELL_BYTES = 200_000, 32 << 20
#: Raking ends when no margin changes by more; given targets still off by SETTLED after ROUNDS rounds are an error.
TOLERANCE, SETTLED, ROUNDS = 1e-10, 1e-3, 500
WORD = r"[^\x20\x09-\x0D]+"
#: Topics by the first pattern found in a text, where no topic column is given.
TOPICS = {"legal": r"(?i)licen[sc]e|copyright", "contact": r"@[A-Za-z0-9-]+\.", "table": r" \| ", "shouting": r"^[^a-z]*$"}


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(text.isNull(), F.lit(None)).otherwise(out)


def tempered(totals: np.ndarray, temper: float) -> np.ndarray:
    share = totals / max(totals.sum(), 1e-300)
    # a value without tokens has nothing to meet, but isn't left out
    share = np.where(share > 0, share**temper, 1e-300)
    return share / share.sum() if len(share) else share


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], given: bool = True) -> np.ndarray:
    """Cell weights under which each margin's token shares are its targets. codes: each cell's value number in each margin."""
    weight = np.ones(len(tokens))
    live = np.ones(len(tokens), bool)
    for c, t in zip(codes, targets):
        live &= t[c] > 0
    weight[~live] = 0
    aims = []
    for c, t in zip(codes, targets):
        there = np.bincount(c, tokens * live, len(t)) > 0
        t = np.where(there, t, 0)
        aims.append(t / max(t.sum(), 1e-300))
    total = float((tokens * live).sum())
    for _ in range(ROUNDS):
        worst = 0.0
        for c, aim in zip(codes, aims):
            now = np.bincount(c, weight * tokens, len(aim))
            factor = np.where(now > 0, aim * total / np.maximum(now, 1e-300), 1)
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0)))
            weight *= factor[c]
        if worst < TOLERANCE:
            break
    else:
        unsettled(worst, given)
    return weight


def unsettled(worst: float, given: bool) -> None:
    """Targets that contradict each other (no weights of the cells meet all): an error if they were given, else a warning."""
    text = f"raking did not settle in {ROUNDS} rounds: a margin is still off by a factor of 1 +- {worst:.3g}, so the targets contradict each other"
    if given and worst > SETTLED:
        raise ValueError(text)
    warnings.warn(text, stacklevel=2)


def calibrated(tokens: np.ndarray, weight: np.ndarray, fraction: float, strict: bool = False) -> np.ndarray:
    """Inclusion probabilities min(1, factor * weight) whose expected tokens are ``fraction`` of all (or all that have weight)."""
    goal = fraction * tokens.sum()
    if strict and (weight * tokens > 0).any():
        goal = min(goal, float((weight * tokens).sum() / weight[tokens > 0].max()))
    use = (weight > 0) & (tokens > 0)
    out = np.where(weight > 0, 1.0, 0.0)
    if goal < tokens[use].sum():
        w, t = weight[use], tokens[use]
        order = np.argsort(-w, kind="stable")
        full = np.concatenate(([0], np.cumsum(t[order])))[:-1]  # tokens of the cells above, all kept
        rest = np.cumsum((w * t)[order][::-1])[::-1]
        factor = (goal - full) / rest
        k = int(np.argmax(factor * w[order] <= 1))
        out[use] = np.minimum(1, factor[k] * w)
    return out


def _on_driver(cells: DataFrame, n: int, targets: list[dict | None], temper: float, fraction: float, strict: bool) -> DataFrame:
    got = cells.toPandas()
    tokens = got["tokens"].to_numpy(float)
    codes, aims = [], []
    for i in range(n):
        values = [None if x is None or x != x else x for x in got[f"m{i}"].tolist()]
        names = {v: k for k, v in enumerate(dict.fromkeys(values))}
        code = np.array([names[v] for v in values], int)
        aims.append(tempered(np.bincount(code, tokens, len(names)), temper) if targets[i] is None else np.array([float(targets[i].get(v, 0)) for v in names]))
        codes.append(code)
    weight = rake(tokens, codes, aims, any(t is not None for t in targets))
    got["weight"], got["probability"] = weight, calibrated(tokens, weight, fraction, strict)
    rows = [tuple(None if x is None or x != x else x for x in r) for r in got.itertuples(index=False)]
    return cells.sparkSession.createDataFrame(rows, ", ".join([*(f"m{i} string" for i in range(n)), "tokens long, weight double, probability double"]))


def _in_spark(cells: DataFrame, n: int, targets: list[dict | None], temper: float, fraction: float, strict: bool, stage: Stage, rounds: int = ROUNDS) -> DataFrame:
    spark = cells.sparkSession
    cells = cells.withColumn("weight", F.lit(1.0))
    aims = []
    for i in range(n):
        if targets[i] is None:
            t = cells.groupBy(f"m{i}").agg(F.sum("tokens").cast("double").alias("t")).withColumn("aim", F.when(F.col("t") > 0, F.pow("t", F.lit(temper))).otherwise(1e-300))
        else:
            t = spark.createDataFrame([(k, float(v)) for k, v in targets[i].items()], f"m{i} string, aim double")
        aims.append(stage.table(t.select(f"m{i}", "aim")))
        cells = cells.join(aims[i].withColumnRenamed(f"m{i}", "v"), F.col(f"m{i}").eqNullSafe(F.col("v")), "left").drop("v")
        cells = cells.withColumn("weight", F.when(F.coalesce("aim", F.lit(0.0)) > 0, F.col("weight")).otherwise(0.0)).drop("aim")
    cells = stage.table(cells)
    total = cells.agg(F.sum(F.col("tokens") * (F.col("weight") > 0).cast("int"))).first()[0] or 0
    fixed = []
    for i in range(n):  # targets of values that have tokens, scaled to one
        there = cells.where("weight > 0 and tokens > 0").select(F.col(f"m{i}").alias("v")).distinct()
        own = aims[i].join(there, F.col(f"m{i}").eqNullSafe(F.col("v")), "left_semi")
        s = own.agg(F.sum("aim")).first()[0] or 1.0
        fixed.append(stage.table(own.withColumn("aim", F.col("aim") / s * float(total))))
    for _ in range(rounds):
        worst = 0.0
        for i in range(n):
            now = cells.groupBy(F.col(f"m{i}").alias("v")).agg(F.sum(F.col("weight") * F.col("tokens")).alias("now")).where("now > 0")
            factor = stage.table(now.join(fixed[i], F.col("v").eqNullSafe(F.col(f"m{i}"))).select("v", (F.col("aim") / F.col("now")).alias("factor")))
            worst = max(worst, factor.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            cells = cells.join(factor, F.col(f"m{i}").eqNullSafe(F.col("v")), "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("v", "factor")
        cells = stage.table(cells)
        if worst < TOLERANCE:
            break
    else:
        unsettled(worst, any(t is not None for t in targets))
    every, usable, top = cells.agg(F.sum("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens"))), F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
    goal = fraction * (every or 0)
    if strict and usable:
        mass, most = cells.where("tokens > 0").agg(F.sum(F.col("weight") * F.col("tokens")), F.max("weight")).first()
        goal = min(goal, mass / most)
    if goal >= (usable or 0):
        return cells.withColumn("probability", (F.col("weight") > 0).cast("double"))
    lo, hi = 0.0, 1 / top
    for _ in range(200):  # bisection on the factor
        mid = (lo + hi) / 2
        got = cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * mid))).first()[0]
        lo, hi = (mid, hi) if got < goal else (lo, mid)
        if hi - lo <= 1e-12 * hi:
            break
    full = (F.col("tokens") == 0) & (F.col("weight") > 0)
    return cells.withColumn("probability", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") * hi)))


def mix(docs: DataFrame, margins: dict[str, Column], targets: dict[str, dict | None] | None = None, fraction: float = 0.8, temper: float = 0.5, strict: bool = False, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, cells_on_driver: int = CELLS) -> DataFrame:
    """docs with the added columns ``mix_tokens, mix_weight, mix_probability, mix_kept`` and one ``mix_<margin>`` for each margin.

    margins: a Column over docs for each name. targets: shares by value for each name, or None for tempered ones. strict: where a
    probability would be cut at 1, fewer tokens than ``fraction`` are kept, so that the expected shares are the targets.
    """
    stage = Stage(docs.sparkSession, "mixing")
    names, every = list(margins), docs.columns
    aims = [(targets or {}).get(n) for n in names]
    m = [f"m{i}" for i in range(len(names))]
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    place = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), F.col(text_col))).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    # under names of this module's own, so that no column of docs can clash
    own = docs.select(*(F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(every)), *(margins[n].cast("string").alias(k) for n, k in zip(names, m)), tokens.alias("tokens"), place.alias("place"))
    cells = stage.table(own.groupBy(*m).agg(F.sum("tokens").alias("tokens")))
    n, size = cells.agg(F.count("*"), F.coalesce(F.sum(F.length(F.concat_ws("", *m))), F.lit(0))).first()
    small = n <= cells_on_driver and size <= CELL_BYTES
    if small:
        cells = _on_driver(cells, len(names), aims, temper, fraction, strict)
    else:
        cells = stage.table(_in_spark(cells, len(names), aims, temper, fraction, strict, stage))
    cells = cells.select(*(F.col(k).alias(f"c{k}") for k in m), "weight", "probability")
    same = F.lit(True)
    for k in m:
        same = same & F.col(k).eqNullSafe(F.col(f"c{k}"))
    out = own.join(F.broadcast(cells) if small else cells, same)
    u = F.pmod("place", F.lit(1 << 52)).cast("double") / float(1 << 52)
    added = {f"mix_{n}": F.col(k) for n, k in zip(names, m)} | {"mix_tokens": F.col("tokens"), "mix_weight": F.col("weight"), "mix_probability": F.col("probability"), "mix_kept": u < F.col("probability")}
    return out.select(*(F.col(f"d{i}").alias(c) for i, c in enumerate(every) if c not in added), *(v.alias(k) for k, v in added.items()))


def shares(mixed: DataFrame, margin: str) -> DataFrame:
    """(value, before, aim, kept): a margin's shares of the tokens, as they were, as the weights have them, and among the kept documents."""
    t = F.col("mix_tokens")
    sums = mixed.groupBy(F.col(f"mix_{margin}").alias("value")).agg(F.sum(t).alias("before"), F.sum(t * F.col("mix_weight")).alias("aim"), F.sum(F.when(F.col("mix_kept"), t).otherwise(0)).alias("kept"))
    whole = Window.partitionBy(F.lit(0))  # a row for each value
    return sums.select("value", *((F.col(c) / F.nullif(F.sum(c).over(whole), F.lit(0))).alias(c) for c in ("before", "aim", "kept")))
