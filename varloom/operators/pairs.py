"""Carriers, co-occurrence of variants and genes, power, networks and attention pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions import ordered, stats
from varloom.functions.annotation import maf_bin, maf_labels


def carriers(calls: DataFrame, key: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """Distinct carriers of each key, by label, and its first gene by name."""
    once = calls.groupBy("sample_id", *key).agg(F.max("label").alias("label"), F.min("gene").alias("gene"))
    return once.groupBy(*key).agg(F.count(F.lit(1)).alias("n_carriers"), F.count_if(F.col("label") == 1).alias("n_cases"), F.count_if(F.col("label") == 0).alias("n_controls"), F.min("gene").alias("gene"))


def top_keys(index: DataFrame, k: int, key: tuple[str, ...]) -> DataFrame:
    """The k keys of most carriers, numbered; ties by key."""
    return ordered.place(index, "i", "n_carriers", *[F.asc(c) for c in key]).where(F.col("i") <= k)


def pair_counts(calls: DataFrame, chosen: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(i, j, n11, n11_cases) of every two of the chosen, numbered keys; pairs that never meet stay with 0.

    chosen is a top-k list, so the self-join is on samples with at most k keys each.
    """
    held = calls.join(F.broadcast(chosen.select(*key, "i")), list(key)).groupBy("sample_id", "i").agg(F.max("label").alias("label"))
    both = held.alias("a").join(held.alias("b"), (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.i") < F.col("b.i")))
    met = both.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.count(F.lit(1)).alias("n11"), F.count_if(F.col("a.label") == 1).alias("n11_cases"))
    every = chosen.select("i").join(F.broadcast(chosen.select(F.col("i").alias("j"))), F.col("i") < F.col("j"))
    return every.join(met, ["i", "j"], "left").fillna(0, ["n11", "n11_cases"])


def cooccurrence(calls: DataFrame, k: int, edges: list[float], key: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """2x2 cells, expected count and ratio of the pairs of the k most carried variants, with frequency bins."""
    index = top_keys(carriers(calls, key), k, key)
    total = calls.select(F.count_distinct("sample_id").alias("n_samples"))
    side = lambda s, i: index.select(F.col("i").alias(i), *[F.col(c).alias(f"{c}_{s}") for c in (*key, "gene")], F.col("n_carriers").alias(f"n_{s}"))
    p = pair_counts(calls, index, key).join(F.broadcast(side("a", "i")), "i").join(F.broadcast(side("b", "j")), "j").crossJoin(F.broadcast(total))
    n, fa, fb = F.col("n_samples"), F.col("n_a") / F.col("n_samples"), F.col("n_b") / F.col("n_samples")
    p = p.withColumn("n10", F.col("n_a") - F.col("n11")).withColumn("n01", F.col("n_b") - F.col("n11")).withColumn("n00", n - F.col("n_a") - F.col("n_b") + F.col("n11"))
    p = p.withColumn("min_cell", F.least("n11", "n10", "n01", "n00")).withColumn("expected", fa * fb * n)
    p = p.withColumn("obs_exp_ratio", F.try_divide("n11", "expected")).withColumn("bin_a", maf_bin(fa, edges)).withColumn("bin_b", maf_bin(fb, edges)).withColumn("freq_a", fa).withColumn("freq_b", fb)
    return p.withColumn("effective_n", stats.effective_n(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00")))


def by_bin_pair(pairs: DataFrame, edges: list[float]) -> DataFrame:
    """Co-occurrence of unordered frequency-bin pairs."""
    place = lambda c: F.array_position(F.array(*map(F.lit, maf_labels(edges))), F.col(c))
    swap = place("bin_a") > place("bin_b")
    rows = pairs.withColumn("lo", F.when(swap, F.col("bin_b")).otherwise(F.col("bin_a"))).withColumn("hi", F.when(swap, F.col("bin_a")).otherwise(F.col("bin_b")))
    pct = lambda c: F.round(100.0 * F.avg(F.when(c, 1.0).otherwise(0.0)), 1)
    return rows.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("n11").alias("mean_n11"), F.median("n11").alias("median_n11"), F.count_if(F.col("n11") == 0).alias("n_zero"), F.count_if(F.col("n11") >= 5).alias("n_5"), F.count_if(F.col("n11") >= 10).alias("n_10"), F.count_if(F.col("min_cell") >= 5).alias("n_cells_5"), pct(F.col("n11") >= 5).alias("pct_5"), pct(F.col("min_cell") >= 5).alias("pct_cells_5"))


def cooccurrence_summary(pairs: DataFrame) -> DataFrame:
    q = F.percentile("n11", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    s = pairs.agg(q.alias("q"), F.avg("n11").alias("mean"), F.stddev_pop("n11").alias("std"), F.avg(F.when(F.col("min_cell") >= 5, 1.0).otherwise(0.0)).alias("testable"))
    words = F.when(F.col("q")[2] >= 30, "sufficient").when(F.col("q")[2] >= 10, "limited").otherwise("insufficient")
    return s.select(*[F.col("q")[i].alias(n) for i, n in enumerate(("min", "p25", "median", "p75", "max"))], "mean", "std", "testable", words.alias("conclusion"))


def gene_interactions(calls: DataFrame, genes: DataFrame, side: str = "greater", min_samples: int = 0, correction: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """Pairs of the listed genes (gene, score): carriers of both, Fisher's exact p against the labels
    being shared at random, rank-quantile score, corrected p."""
    own = [c for c in ("gene_key",) if c in calls.columns]
    calls = ordered.written(calls.groupBy("sample_id", "gene", *own).agg(F.max("label").alias("label")))  # read four times
    index = carriers(calls.where("gene <> ''"), ("gene_key",)) if own else carriers(calls.where("gene <> ''").withColumn("gene_key", F.col("gene")), ("gene_key",))
    listed = stats.rank_quantile(genes.select(F.col("gene").alias("gene_key"), "score"), "score", "q", "gene_key")
    chosen = listed.join(index.select("gene_key", "n_carriers"), "gene_key", "left").fillna(0, ["n_carriers"]).withColumn("i", stats.position_rank(F.asc("gene_key")))
    total = calls.select(F.count_distinct("sample_id").cast("int").alias("n"))
    facts = F.broadcast(total)  # one row
    keyed = calls.where("gene <> ''").withColumn("gene_key", F.col("gene"))
    part = lambda s, i: chosen.select(F.col("i").alias(i), F.col("gene_key").alias(f"gene_{s}"), F.col("q").alias(f"q_{s}"), F.col("n_carriers").alias(f"n_{s}"))
    p = pair_counts(keyed, chosen, ("gene_key",)).join(F.broadcast(part("a", "i")), "i").join(F.broadcast(part("b", "j")), "j").crossJoin(facts).where(F.col("n11") >= min_samples)
    p = p.withColumn("p_value", stats.fisher(None, F.col("n11"), F.col("n_a"), F.col("n_b"), F.col("n").cast("long"), side)).withColumn("interaction_score", F.sqrt(F.col("q_a") * F.col("q_b")) * F.log1p(F.col("n11")))
    return stats.correct(p.select("gene_a", "gene_b", F.col("n11").alias("n_cooccur"), F.col("n11_cases").alias("n_case"), "n_a", "n_b", "p_value", "interaction_score"), "p_value", correction, alpha)


def rollup_pairs(pairs: DataFrame) -> DataFrame:
    """Variant pairs to unordered gene pairs: how many, and their mean co-occurrence."""
    return pairs.groupBy(F.least("gene_a", "gene_b").alias("gene_a"), F.greatest("gene_a", "gene_b").alias("gene_b")).agg(F.count(F.lit(1)).alias("n_variant_pairs"), F.avg("n11").alias("mean_n11"))


def enrich_pairs(gene_pairs: DataFrame, variant_pairs: DataFrame) -> DataFrame:
    return gene_pairs.join(rollup_pairs(variant_pairs), ["gene_a", "gene_b"], "left").fillna(0, ["n_variant_pairs", "mean_n11"])


def network_nodes(edges: DataFrame) -> DataFrame:
    """Degree of each gene in a table of edges (gene_a, gene_b, weight)."""
    ends = edges.select(F.explode(F.array("gene_a", "gene_b")).alias("gene"), "weight")
    return ends.groupBy("gene").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def drawn_numbers(spark: SparkSession, n: DataFrame, most: DataFrame, seed: int) -> DataFrame:
    """(number): ``most`` distinct pair numbers of 0 .. n (n - 1) / 2 - 1, both from one-row tables, in the order
    of a seeded walk that meets each number once: the multiples of a step that shares no factor with their
    number, so nothing is enumerated but what is drawn. All numbers, where most is no less."""
    facts = n.select("n").crossJoin(most.select("most")).withColumn("all", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    # seeded steps are tried for one without a common factor
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))), lambda s: s["a"])
    tries = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda t: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), t.cast("string"))), 1, 7), 16, 10).cast("long"))
    step = F.coalesce(F.get(F.filter(tries, lambda x: (x > 1) & (gcd(x, F.col("all")) == 1)), F.lit(0)), F.lit(1).cast("long"))
    facts = facts.where("all > 0").withColumn("step", step).withColumn("start", tries[0] % F.col("all"))
    rows = facts.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.least("most", "all") - 1)))  # the budget's rows
    return rows.where("most > 0").select(F.pmod(F.col("start") + F.col("at") % F.col("all") * F.col("step"), "all").alias("number"), "at", "n")


def unranked(numbers: DataFrame) -> DataFrame:
    """Pair numbers to places i < j from 1, in the order of combinations: (1, 2), (1, 3), ..."""
    back = (F.col("n") * (F.col("n") - 1) / 2).cast("long") - 1 - F.col("number")  # counted from the last pair
    root = F.floor((F.sqrt(8.0 * back + 1) - 1) / 2).cast("long")
    fix = F.when((root + 1) * (root + 2) / 2 <= back, root + 1).when(root * (root + 1) / 2 > back, root - 1).otherwise(root)
    return numbers.withColumn("_b", back).withColumn("_r", fix).select("at", (F.col("n") - 1 - F.col("_r")).alias("i"), (F.col("n") - (F.col("_b") - (F.col("_r") * (F.col("_r") + 1) / 2).cast("long"))).alias("j"))


def select_pairs(index: DataFrame, top: int, most: int, rare_below: int, seed: int, key: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """(part, place, key_a, key_b) of a budget of pairs: those of the ``top`` variants of most carriers, a tenth
    of the budget (from 10 on) and what they leave free for pairs among rarer variants, of which ``top`` are
    drawn by a seeded digest. Pairs are drawn by their numbers, so a budget of C(n, 2) costs no enumeration."""
    spark = index.sparkSession
    low = 0 if most < 10 else max(int(most * 0.1), 1)
    placed = ordered.place(index.select(*key, "n_carriers"), "i", "n_carriers", *[F.asc(c) for c in key])
    head = placed.where(F.col("i") <= top)
    rare = placed.where((F.col("i") > top) & (F.col("n_carriers") < rare_below))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])), 1, 13), 16, 10).cast("long")
    few = ordered.place(rare.drop("i").withColumn("_d", digest), "i", "_d", *[F.asc(c) for c in key], descending=False).where(F.col("i") <= top)
    size = lambda t: t.agg(F.count(F.lit(1)).alias("n"))
    every = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    common = size(head).select("n", F.lit(most - low).cast("long").alias("most"))
    spare = common.select((F.lit(most) - F.least(every, F.col("most"))).cast("long").alias("most"))

    def pairs(part: str, chosen: DataFrame, budget: DataFrame) -> DataFrame:
        at = unranked(drawn_numbers(spark, size(chosen), budget, seed))
        side = lambda s, i: chosen.select(F.col("i").alias(i), *[F.col(c).alias(f"{c}_{s}") for c in key])
        return at.join(side("a", "i"), "i").join(side("b", "j"), "j").select(F.lit(part).alias("part"), F.col("at").alias("place"), *[f"{c}_{s}" for s in "ab" for c in key])

    return pairs("top", head, common).union(pairs("rare", few, spare))


def power_by_bin(pairs: DataFrame, sigma: float, alpha: float, threshold: float = 0.1) -> DataFrame:
    """Minimum detectable effects by bin pair; infinite ones stay out of medians and count as undetectable."""
    mde = stats.minimum_effect(F.col("effective_n"), sigma, alpha)
    rows = pairs.withColumn("mde", mde).withColumn("finite", F.col("mde") < F.lit(float("inf")))
    return rows.groupBy("bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"), F.median("n11").alias("median_n"), F.median("effective_n").alias("median_n_eff"), F.median(F.when(F.col("finite"), F.col("mde"))).alias("median_mde"), F.count_if("finite").alias("n_finite"), F.count_if(F.col("mde") <= threshold).alias("n_testable"))


def detection_rates(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    ok = F.col("mde") < F.lit(float("inf"))
    hit = F.count_if(F.col("mde") <= threshold)
    return pairs.agg(F.count_if(ok).alias("n_finite"), F.try_divide(hit, F.count_if(ok)).alias("rate_finite"), F.try_divide(hit, F.count(F.lit(1))).alias("rate_all"), F.median(F.when(ok, F.col("mde"))).alias("median_mde"))


def common_pair_rates(pairs: DataFrame, common: float = 0.05) -> DataFrame:
    both = pairs.where((F.col("freq_a") >= common) & (F.col("freq_b") >= common))
    return both.agg(F.median(F.when(F.col("effective_n") > 0, F.col("effective_n") / F.col("n_samples"))).alias("effective_fraction"), F.median(F.when(F.col("n11") > 0, F.col("n11") / F.col("n_samples"))).alias("cooccurrence_rate"))


def infer_cohort_size(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.median(F.try_divide("expected", F.col("freq_a") * F.col("freq_b")))).cast("long").alias("n_samples"))


def noise_sigma(null: DataFrame, score: str = "null_score", key: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """sqrt(3) times the deviation of null scores, and of a variant's scores (root of the mean variance)."""
    pooled = null.agg((F.sqrt(F.lit(3.0)) * F.stddev_pop(score)).alias("sigma_null"))
    each = null.groupBy(*key).agg(F.var_samp(score).alias("v"), F.count(score).alias("n")).where("n >= 2")
    return pooled.crossJoin(each.agg((F.sqrt(F.lit(3.0)) * F.sqrt(F.avg("v"))).alias("sigma_within")))


def interactions_across_samples(pairs: DataFrame, min_samples: int = 2, chrom: bool = True) -> DataFrame:
    """Attention pairs of samples (gene/pos of both ends, score) gathered by unordered pair."""
    end = lambda s: F.struct(*([F.col(f"chrom_{s}").alias("chrom")] if chrom else []), F.col(f"pos_{s}").alias("pos"), F.col(f"gene_{s}").alias("gene"))
    rows = pairs.select("sample_id", "score", F.least(end("a"), end("b")).alias("lo"), F.greatest(end("a"), end("b")).alias("hi"))
    # a sample's first row of a pair is marked by sorting, which spills; distinct counts hold all (sample, pair) in two hash tables
    first = F.row_number().over(Window.partitionBy("sample_id", "lo", "hi").orderBy("score")) == 1
    rows = rows.withColumn("_first", first & F.col("sample_id").isNotNull())
    out = rows.groupBy("lo", "hi").agg(F.count_if("_first").alias("n_samples"), F.count(F.lit(1)).alias("n_occurrences"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")).where(F.col("n_samples") >= min_samples)
    return out.select(*[F.col(f"{e}.{c}").alias(f"{c}_{s}") for e, s in (("lo", "a"), ("hi", "b")) for c in (("chrom",) if chrom else ()) + ("pos", "gene")], "n_samples", "n_occurrences", "mean_score", "max_score", (F.col("lo.gene") == F.col("hi.gene")).alias("same_gene"), F.abs(F.col("lo.pos") - F.col("hi.pos")).alias("distance"))


def top_attention(pairs: DataFrame, k: int, threshold: float, mode: str = "absolute") -> DataFrame:
    """Top pairs of each (sample_id, chunk) above a score or a percentile of its own matrix."""
    w = Window.partitionBy("sample_id", "chunk")
    upper = pairs.where("i < j")
    if mode == "percentile":
        upper = upper.withColumn("_t", F.percentile("score", threshold).over(w)).where("score >= _t").drop("_t")
    elif mode == "absolute":
        upper = upper.where(F.col("score") > threshold)
    else:
        raise ValueError(f"unknown threshold mode {mode!r}")
    return upper.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "i", "j"))).where(F.col("rank") <= k)


def reduce_attention(heads: DataFrame, layers: str = "mean", over: str = "mean") -> DataFrame:
    """(sample_id, chunk, i, j, score) of attention by layer and head."""
    pick = {"mean": F.avg, "max": F.max}
    if layers not in (*pick, "last") or over not in pick:
        raise ValueError(f"unknown reduction {layers!r}, {over!r}")
    one = heads.groupBy("sample_id", "chunk", "layer", "i", "j").agg(pick[over]("score").alias("score"))
    if layers == "last":
        return one.groupBy("sample_id", "chunk", "i", "j").agg(F.max_by("score", "layer").alias("score"))
    return one.groupBy("sample_id", "chunk", "i", "j").agg(pick[layers]("score").alias("score"))


def attention_entropy(pairs: DataFrame) -> DataFrame:
    p = F.col("score") + F.lit(1e-10)
    return pairs.groupBy("sample_id", "i").agg((-F.sum(F.col("score") * F.ln(p))).alias("entropy"))


def attention_times_attribution(pairs: DataFrame, attributions: DataFrame, least: float = 0.01, top: int = 50) -> DataFrame:
    """attention * (|a_i| + |a_j|) above a floor; the largest of all."""
    a = lambda n: attributions.select("sample_id", F.col("i").alias(n), F.abs("score").alias(f"s_{n}"))
    both = pairs.where("i < j").join(a("i"), ["sample_id", "i"]).join(a("j"), ["sample_id", "j"])
    return both.withColumn("interaction", F.col("score") * (F.col("s_i") + F.col("s_j"))).where(F.col("interaction") > least).orderBy(F.desc("interaction"), "sample_id", "i", "j").limit(top)


def synergy(f00: Column, f10: Column, f01: Column, f11: Column) -> tuple[Column, Column, Column]:
    """Counterfactual synergy, its class and whether it is significant."""
    s = f11 - f10 - f01 + f00
    return s, F.when(F.abs(s) <= 0.01, "independent").when(s > 0, "synergistic").otherwise("antagonistic"), F.abs(s) > 0.05


def synergy_summary(tested: DataFrame) -> DataFrame:
    return tested.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("synergistic", "antagonistic", "independent")], F.avg("synergy").alias("mean_synergy"), F.max("synergy").alias("max_synergy"), F.min("synergy").alias("min_synergy"))


def pair_window(n: Column, i: Column, j: Column, chunk: int) -> Column:
    """Start of a chunk of a sample's n variants centred on the pair i < j; null where they lie too far apart."""
    span = j - i + 1
    return F.when(span <= chunk, F.greatest(F.lit(0), F.least(i - F.floor((F.lit(chunk) - span) / 2).cast("int"), F.greatest(n - chunk, F.lit(0)))))
