"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target share of all words (water-filling: by weight, capped at ``max_copies`` times the
source's own words, the excess shared again by weight). A document is expected ``target / source words``
times: the whole part is allotted as certain copies; for the fraction pi each document draws a uniform u
from its id and is ranked by

    q = (u / (1 - u)) / (pi / (1 - pi)),

and documents are taken in that order until the words still due are met as nearly as whole documents
allow. So each sample has a fixed size in words, and a rerun draws the same one.

The cut of each source is found without sorting the source: two levels of 4096 bins over q / (1 + q)
are summed, then only the documents of one cell per source are ordered. What remains is a table of one
row per source (its cut in q and doc_id), and applying it to the documents needs no shuffle.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, ranked
last; repeated rows of one doc_id in one source rank as one document and are taken together; an empty
table gives an empty result; a source of no words has target 0; a very long text counts all its words and is
taken or left whole. Other columns, whatever their names, are not read and go along in mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, fresh, kept, materialize, named, scratch

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BINS = 4096
SEED = "mix1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from 13 hexadecimal digits of an md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def odds_rank(u: Column, pi: Column) -> Column:
    """Pareto's ranking variable; null unless pi lies in (0, 1)."""
    return F.try_divide(u / (F.lit(1.0) - u), F.try_divide(pi, F.lit(1.0) - pi))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """sources(source, source_size) plus target. The windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position + 1)).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_cap), F.lit(0.0)))
    # lam is the water level if all sources before this one are full; the first source it does not fill sets it.
    filled = weighted.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("lam", level)
    filled = filled.withColumn("water", F.min(F.when(F.col("lam") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "lam"))).over(everything)["lam"])
    return filled.select("source", "source_size", F.when(F.col("water").isNull() | (F.col("ratio") < F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


def _crossing(sums: DataFrame, cell: str) -> DataFrame:
    """For each source the first cell in which the running words reach what is due, and the words before it."""
    running = Window.partitionBy("source").orderBy(cell)
    ended = sums.withColumn("end", F.sum("words").over(running) + F.col("base"))
    return ended.filter((F.col("end") >= F.col("due")) & (F.col("end") - F.col("words") < F.col("due"))).select("source", F.col(cell).alias("cut_" + cell), (F.col("end") - F.col("words")).alias("base"))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> tuple[DataFrame, int]:
    """From sized(doc_id, source, size, u): one row per source with target, whole copies and the cut; and the number of sources."""
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n_sources = sources.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = source_targets(sources, weights, max_copies).withColumn("whole", F.floor(rate).cast("long"))
    plan = plan.withColumn("pi", rate - F.col("whole")).withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    open_plan = plan.filter((F.col("pi") > 0) & (F.col("pi") < 1)).select("source", "pi", "due")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    small = broadcast_if_small(open_plan, n_sources)
    ranked = sized.join(small, same(sized, small)).select(sized["source"], "doc_id", "size", "due", odds_rank(F.col("u"), F.col("pi")).alias("q"))
    at = ranked["q"] / (ranked["q"] + 1) * BINS
    ranked = ranked.withColumn("b1", F.floor(at)).withColumn("b2", F.floor((at - F.floor(at)) * BINS))
    first = materialize(_crossing(ranked.groupBy("source", "b1").agg(F.sum("size").alias("words"), F.max("due").alias("due")).withColumn("base", F.lit(0)), "b1"), "mix-cut1")
    one = broadcast_if_small(first, n_sources)
    inside = ranked.join(one, same(ranked, one) & (F.col("b1") == F.col("cut_b1"))).select(ranked["source"], "doc_id", "size", "due", "q", "b2", "base", "cut_b1")
    inside = materialize(inside, "mix-cells")
    second = materialize(_crossing(inside.groupBy("source", "b2").agg(F.sum("size").alias("words"), F.max("due").alias("due"), F.max("base").alias("base")), "b2").withColumnRenamed("base", "base2"), "mix-cut2")
    two = broadcast_if_small(second, n_sources)
    cell = inside.join(two, same(inside, two) & (F.col("b2") <= F.col("cut_b2"))).select(inside["source"], "doc_id", "size", "due", "q", "b2", "cut_b2", "base2")
    last = cell.filter("b2 = cut_b2").groupBy("source", "q", "doc_id").agg(F.sum("size").alias("words"), F.max("due").alias("due"), F.max("base2").alias("base"))
    order = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("before", F.sum("words").over(order) - F.col("words") + F.col("base"))
    cuts = last.filter(F.col("before") + F.col("words") / 2 <= F.col("due")).groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("cut"))
    # If the first document of the cell already overshoots, the cut lies at the end of the cell before it.
    cuts = two.join(cuts, same(two, cuts), "left").select(two["source"], "cut_b2", "cut")
    ends = first.join(cuts, same(first, cuts)).select(first["source"], "cut_b1", "cut_b2", "cut")
    named = ends.select(F.col("source").alias("__source"), "cut_b1", "cut_b2", "cut")
    full = plan.join(broadcast_if_small(named, n_sources), plan["source"].eqNullSafe(F.col("__source")), "left").drop("__source")
    return materialize(full, "mix-cuts"), n_sources


def copies(u: Column, doc_id: Column, plan: Column) -> Column:
    """How often a document is taken by its source's plan, a struct of the plan's columns."""
    q = odds_rank(u, plan["pi"])
    at = q / (q + 1) * BINS
    b1, b2 = F.floor(at), F.floor((at - F.floor(at)) * BINS)
    cut_q, cut_id = plan["cut"]["q"], plan["cut"]["doc_id"]
    inside = F.when(plan["cut"].isNull(), F.lit(False)).otherwise((q < cut_q) | ((q == cut_q) & (doc_id.isNull() | F.coalesce(doc_id <= cut_id, F.lit(False)))))
    taken = (b1 < plan["cut_b1"]) | ((b1 == plan["cut_b1"]) & ((b2 < plan["cut_b2"]) | ((b2 == plan["cut_b2"]) & inside)))
    drawn = (plan["pi"] > 0) & (plan["pi"] < 1) & F.coalesce(taken, F.lit(False))
    return plan["whole"] + F.when(drawn, 1).otherwise(0)


PLAN = ("whole", "pi", "cut_b1", "cut_b2", "cut")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), word_count(named(text_col)).alias("size"), uniform(named(id_col), seed).alias("u"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row."""
    sized = materialize(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    plan, n = mixing_plan(sized, weights, max_copies)
    plan = broadcast_if_small(plan, n)
    out = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).withColumn("copies", copies(F.col("u"), F.col("doc_id"), F.struct(*PLAN)))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    with scratch(docs.sparkSession):
        plan, n = mixing_plan(materialize(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes"), weights, max_copies)
        plan = kept(plan, "mix-plan")
    source, own, times = (fresh(docs, c) for c in ("mix_source", "mix_plan", "mix_copies"))
    plan = broadcast_if_small(plan.select(F.col("source").alias(source), F.struct(*PLAN).alias(own)), n)
    out = docs.join(plan, named(source_col).eqNullSafe(F.col(source)))
    out = out.withColumn(times, copies(uniform(named(id_col), seed), named(id_col), F.col(own))).filter(F.col(times) > 0)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*map(named, docs.columns))
