"""Mixing sources to target weights by Pareto order sampling.

Native: DataFrame functions only.

Every document gets an expected number of copies.  Sources share the mix by
weight, and the documents of a source share its target by the weight of their
length class (the bit length of the size), never above ``max_copies`` copies
each.  The whole part of the expectation is allocated for certain.  For the
fraction ``p`` a document draws ``u`` from its own digest and is ranked by its
odds ratio ``u/(1-u) : p/(1-p)``; the smallest ranks of each source are taken
until the words that are left of its target are filled to the nearest document.

The cut of a source is searched in fixed-point bins of the rank, 4096 bins a
level, so that a source with a third of all rows is summed map-side and no task
or driver holds its documents.

Defined cases: null texts have size 0; size 0 takes no words; a null source is
a source of its own, ordered last; repeated rows are separate documents, of
which any may fill the last place; no row gives no row.  Working columns start
with ``__mix_``; other columns pass through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import written

#: Words are runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
#: Bits of the fixed-point rank, and of one level of the search.
RANK_BITS, LEVEL_BITS = 48, 12


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits, fixed by the given columns."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def measured(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds the size, the length class and the random number of each document."""
    size = word_count(F.col("text"))
    return docs.withColumns({"__mix_size": size, "__mix_u": uniform(F.lit(seed), F.col("doc_id"), F.col("text"))}).withColumn(
        "__mix_class", F.length(F.bin("__mix_size")).cast("long")
    )


def _filled(df: DataFrame, by: list[str], total: Column, weight: str, cap: str, out: str) -> DataFrame:
    """Shares ``total`` by ``weight``, none above ``cap``, the excess reshared.

    With parts in ascending order of cap / weight, the level at which the
    first i parts stand at their caps is ``(total - caps so far) / weights
    left``; the true level is the largest of these.
    """
    parts = Window.partitionBy(*by)
    before = parts.orderBy(F.col("__r"), F.col("__tie")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__r", F.col(cap) / F.col(weight))
    df = df.withColumns({
        "__caps": F.coalesce(F.sum(cap).over(before), F.lit(0)), "__weights": F.coalesce(F.sum(weight).over(before), F.lit(0)),
        "__all": F.sum(weight).over(parts), "__most": F.sum(cap).over(parts), "__total": total,
    })
    df = df.withColumn("__level", F.max((F.col("__total") - F.col("__caps")) / (F.col("__all") - F.col("__weights"))).over(parts))
    level = F.when(F.col("__total") >= F.col("__most"), F.col(cap).cast("double")).otherwise(F.least(F.col(cap).cast("double"), F.col("__level") * F.col(weight)))
    return df.withColumn(out, level).drop("__r", "__caps", "__weights", "__all", "__most", "__total", "__level")


def expectations(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source and length class: sizes, targets, expected copies.

    The windows run over this summary: at most 63 classes of each source.
    """
    strata = rows.groupBy(F.col("source").alias("__s"), F.col("__mix_class").alias("__c")).agg(F.sum("__mix_size").alias("__size"))
    sources = strata.groupBy("__s").agg(F.sum("__size").alias("__source"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("__s").asc_nulls_last())
    sources = sources.withColumn("__n", F.row_number().over(order))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("__n") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"__w": pick.cast("long"), "__cap": F.col("__source") * max_copies, "__tie": F.col("__n"), "__g": F.lit(0)})
    total = F.sum("__source").over(Window.partitionBy("__g")) * F.lit(float(share))
    sources = _filled(sources, ["__g"], total, "__w", "__cap", "__target").select(F.col("__s").alias("__t"), "__source", "__target")
    classes = strata.filter("__size > 0").join(sources, F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    classes = classes.withColumns({"__w": F.col("__size") * F.col("__c"), "__cap": F.col("__size") * max_copies, "__tie": F.col("__c")})
    shared = _filled(classes, ["__s"], F.first("__target").over(Window.partitionBy("__s")), "__w", "__cap", "__part")
    shared = shared.withColumn("__e", F.least(F.lit(float(max_copies)), F.col("__part") / F.col("__size")))
    shared = shared.withColumn("__whole", F.floor("__e").cast("long"))
    zero = strata.filter("__size = 0").join(sources, F.col("__s").eqNullSafe(F.col("__t"))).select("__s", "__c", "__size", "__source", "__target", F.lit(0.0).alias("__e"), F.lit(0).cast("long").alias("__whole"))
    both = shared.select(*zero.columns).unionByName(zero)
    left = F.col("__target") - F.sum(F.col("__whole") * F.col("__size")).over(Window.partitionBy("__s"))
    return both.withColumn("__left", left)


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns and the fixed-point rank; null: never sampled."""
    df = rows.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__mix_class") == F.col("__c")))
    p = F.col("__e") - F.col("__whole")
    odds = F.col("__mix_u") / (F.lit(1.0) - F.col("__mix_u")) * ((F.lit(1.0) - p) / p)
    rank = F.floor(odds / (odds + F.lit(1.0)) * F.lit(float(1 << RANK_BITS))).cast("long")
    return df.withColumn("__rank", F.when((p > 0) & (F.col("__mix_size") > 0), rank))


def cuts(slim: DataFrame, plan: DataFrame, levels: int = 2) -> DataFrame:
    """Per source: the rank where the sample ends, and how many rows of that rank it takes.

    ``slim`` should be a written table of the measures, as it is read once a level.
    """
    ranked = _ranked(slim, plan).filter("__rank is not null").select("__s", "__rank", "__left", F.col("__mix_size").alias("__size"))
    found = None
    for level in range(1, levels + 1):
        shift = RANK_BITS - level * LEVEL_BITS
        inside = ranked.withColumn("__bin", F.shiftright("__rank", shift))
        if found is not None:
            near = found.select(F.col("__s").alias("__t"), F.col("__bin").alias("__up"), "__before")
            inside = inside.join(near, F.col("__s").eqNullSafe(F.col("__t")) & (F.shiftright("__bin", LEVEL_BITS) == F.col("__up"))).drop("__t", "__up")
        else:
            inside = inside.withColumn("__before", F.lit(0).cast("long"))
        sums = inside.groupBy("__s", "__bin").agg(F.sum("__size").alias("__sum"), F.first("__left").alias("__left"), F.first("__before").alias("__before"))
        upto = Window.partitionBy("__s").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__sum").over(upto), F.lit(0)))
        # the bin that holds the end is the last one that starts below it
        found = sums.filter(F.col("__before") < F.col("__left")).groupBy("__s").agg(F.max_by(F.struct("__bin", "__before"), "__bin").alias("__x"))
        found = found.select("__s", "__x.__bin", "__x.__before")
    near = found.select(F.col("__s").alias("__t"), F.col("__bin").alias("__up"), "__before")
    last = ranked.join(near, F.col("__s").eqNullSafe(F.col("__t")) & (F.shiftright("__rank", RANK_BITS - levels * LEVEL_BITS) == F.col("__up")))
    order = Window.partitionBy("__s").orderBy("__rank", "__size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("__before") + F.coalesce(F.sum("__size").over(order), F.lit(0))
    last = last.withColumn("__in", upto + F.col("__size") / 2 <= F.col("__left"))
    ties = last.groupBy("__s", "__rank").agg(F.sum(F.col("__in").cast("long")).alias("__take"), F.count("*").alias("__of"))
    # all ranks below the cut are taken; of those at the cut, __take
    kept = ties.filter("__take > 0").groupBy("__s").agg(F.max_by(F.struct("__rank", "__take", "__of"), "__rank").alias("__x"))
    edge = found.select("__s", F.shiftleft("__bin", RANK_BITS - levels * LEVEL_BITS).alias("__start"))
    kept = kept.select(F.col("__s").alias("__t"), F.col("__x.__rank").alias("__cut"), F.col("__x.__take").alias("__take"), F.col("__x.__of").alias("__of"))
    cut = edge.join(kept, F.col("__s").eqNullSafe(F.col("__t")), "left")
    return cut.select(F.col("__s").alias("__t"), F.coalesce("__cut", F.col("__start") - 1).alias("__cut"), F.coalesce("__take", F.lit(0)).alias("__take"), F.coalesce("__of", F.lit(0)).alias("__of"))


def mixed(rows: DataFrame, slim: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """``rows`` with __mix_source (its source's size), __mix_target and __mix_copies.

    ``rows`` has the columns of ``measured``; ``slim`` is a written table of the
    same documents with at least source, __mix_size, __mix_class and __mix_u.
    """
    plan = written(expectations(slim, weights, share, max_copies), "mix-plan")
    cut = written(cuts(slim, plan), "mix-cut")
    ranked = _ranked(rows, plan).join(cut, F.col("__s").eqNullSafe(F.col("__t")), "left")
    part = "coalesce(__rank = __cut and __take < __of, false)"
    below = F.coalesce((F.col("__rank") <= F.col("__cut")).cast("long"), F.lit(0))
    if cut.filter("__take < __of").isEmpty():
        out = ranked.withColumn("__more", below)
    else:  # repeated rows share the last place: so many of them as fit
        place = F.row_number().over(Window.partitionBy("__s").orderBy("doc_id", "__mix_u"))
        some = ranked.filter(part).withColumn("__more", (place <= F.col("__take")).cast("long"))
        out = ranked.filter(f"not {part}").withColumn("__more", below).unionByName(some)
    out = out.withColumns({"__mix_copies": F.col("__whole") + F.col("__more"), "__mix_source": F.col("__source"), "__mix_target": F.col("__target")})
    return out.drop("__s", "__c", "__t", "__size", "__source", "__target", "__e", "__whole", "__left", "__rank", "__cut", "__take", "__of", "__more")


def slim_of(rows: DataFrame) -> DataFrame:
    """The written measures that ``mixed`` plans from."""
    return written(rows.select("doc_id", "source", "__mix_size", "__mix_class", "__mix_u"), "mix-rows")


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mix itself: the columns of ``docs``, a document as often as it is taken."""
    rows = measured(docs)
    out = mixed(rows, slim_of(rows), weights, share, max_copies).filter("__mix_copies > 0")
    repeat = F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies").cast("int")))
    return out.withColumn("__mix_one", repeat).select(*docs.columns)
