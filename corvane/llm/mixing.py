"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells (source, language, topic).  A round of raking scales the cells' token weights so that each
dimension in turn has its target marginal.  Rounds end when all marginals are met to TOLERANCE; where no weights of the cells
that there are can meet them (a source of one language, say), they end when further rounds hardly help, and a warning says how far off
the marginals are.  A target is a power of
the dimension's own token totals: 1 keeps the natural shares, 0 makes all values equal, between them flattens.  A document of a cell is
taken with the probability weight / tokens of its cell, at most 1, by a hash of its id, and carries the weight that the probability
could not give.

Only cells go through the rounds, as many as there are combinations of values, whatever the number of documents.  They are written
every ROUNDS rounds, so that plans stay short.  The fitted
cells are written, so that Spark knows their size: it broadcasts them if they are small and else joins them with skewed keys
split; texts are not dealt out in the first case.

Defined cases: a null value of a dimension is a value of its own, and no text stands for it; a document without tokens (null or empty text) has probability and weight 0;
rows that repeat a doc_id are taken or left together, null ids too; an empty table gives none.  Extra columns pass
through where rows are sampled.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F, Window

from corvane.llm.workspace import Workspace, unused

#: Target marginals, as powers of the natural totals; the share of all tokens to take; rounds between two looks at the marginals.
POWERS, RATE, ROUNDS, SEED = {"source": 0.5, "lang": 0.5, "topic": 0.0}, 0.7, 10, "mix-1"
#: The relative error of marginals that ends the rounds; the share of the error that further ROUNDS rounds have to take away.
TOLERANCE, PROGRESS = 1e-4, 0.02


def n_tokens(text: str = "text") -> Column:
    """Words between blanks."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(tokens: str) -> Column:
    """A stand-in for a topic where a table has none: the band of a document's length."""
    return F.when(F.col(tokens) < 150, "note").when(F.col(tokens) < 600, "article").otherwise("longform")


def uniform(doc_id: str, seed: str) -> Column:
    """A number from 0 to 1, exclusive, fixed by the id."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"-{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def marginal_error(cells: DataFrame, powers: dict[str, float]) -> float:
    """The largest relative difference of a value's share of the weight from its share of the targets."""
    each = None
    for d in powers:
        own = cells.groupBy(d).agg(F.sum("weight").alias("w"), F.max(f"target_{d}").alias("t")).select(F.lit(d).alias("d"), "w", "t")
        each = own if each is None else each.unionByName(own)
    whole = Window.partitionBy("d")
    off = F.abs(F.try_divide(F.col("w") * F.sum("t").over(whole), F.sum("w").over(whole) * F.col("t")) - 1)
    return each.select(off.alias("off")).agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, powers: dict[str, float], space: Workspace, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """cells (the dimensions, tokens) with weight, tokens fitted to the targets in any unit; and the largest relative error of a marginal."""
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, power in powers.items():
        total = F.sum("tokens").over(Window.partitionBy(d)).cast("double")
        out = out.withColumn(f"target_{d}", F.when(total > 0, F.pow(total, F.lit(power))).otherwise(0.0))
    turn, before = 0, None
    while True:
        for _ in range(rounds):
            for d in powers:
                now = F.sum("weight").over(Window.partitionBy(d))
                out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"target_{d}"), now), F.lit(0.0)))
        out, turn = space.keep(out, f"raked-{turn}"), turn + 1
        error = marginal_error(out, powers)
        if error > tolerance and (before is None or error <= (1 - PROGRESS) * before):
            before = error
            continue
        if error > tolerance:
            warnings.warn(f"the targets can't be met: after {turn * rounds} rounds a marginal is off by {error:.2%}", stacklevel=2)
        return out.drop(*(f"target_{d}" for d in powers)), error


def mixed(documents: DataFrame, topic_of: Column | None = None, powers: dict[str, float] | None = None, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """documents, all columns, and last a struct mix of tokens, source, lang, topic, probability, weight, selected.

    Expected tokens of the selected rows, times their weights, are rate * all tokens, shared out by the fitted cells.
    """
    powers = powers or POWERS
    dims = ["source", "lang", "topic"]
    tokens = n_tokens()
    mix, factor, *cell = unused(documents, "mix", "factor", *(f"cell_{d}" for d in dims))
    named = documents.withColumn(mix, F.struct(tokens.alias("tokens"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (topic_of.cast("string") if topic_of is not None else F.lit(None).cast("string")).alias("topic")))
    if topic_of is None:
        named = named.withColumn(mix, F.col(mix).withField("topic", topic(f"{mix}.tokens")))
    cells = named.groupBy(*(F.col(f"{mix}.{d}").alias(d) for d in dims)).agg(F.sum(f"{mix}.tokens").alias("tokens"))
    space = Workspace(documents.sparkSession, "mix")
    cells, _ = rake(space.keep(cells, "cells"), powers, space, rounds)
    total, weight = cells.agg(F.sum("tokens"), F.sum("weight")).first()
    unit = rate * float(total) / weight if weight else 0.0
    share = F.coalesce(F.try_divide(F.col("weight") * F.lit(unit), F.col("tokens").cast("double")), F.lit(0.0))
    cells = space.keep(cells.select(*(F.col(d).alias(c) for d, c in zip(dims, cell, strict=True)), F.round(share, 9).alias(factor)), "factors")
    space.only("factors")
    same = [F.col(f"{mix}.{d}").eqNullSafe(F.col(c)) for d, c in zip(dims, cell, strict=True)]
    some = F.col(f"{mix}.tokens") > 0
    out = named.join(cells, same)
    out = out.withColumn(mix, F.col(mix).withField("probability", F.when(some, F.least(factor, F.lit(1.0))).otherwise(0.0)).withField("weight", F.when(some, F.greatest(factor, F.lit(1.0))).otherwise(0.0)))
    out = out.withColumn(mix, F.col(mix).withField("selected", some & (uniform("doc_id", seed) < F.col(f"{mix}.probability"))))
    return out.select(*documents.columns, mix)


def sampled(documents: DataFrame, **how) -> DataFrame:
    """The selected rows of documents, all columns, with probability and weight."""
    out = mixed(documents, **how)
    mix = out.columns[-1]
    names = zip(("probability", "weight"), unused(documents, "probability", "weight"), strict=True)
    return out.where(f"{mix}.selected").select(*documents.columns, *(F.col(f"{mix}.{c}").alias(n) for c, n in names))
