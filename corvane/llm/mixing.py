"""Mixing sources to target weights."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.session import materialise

#: Buckets of one refinement of the hash range, and bits that the hash has in all.
BITS, HASH_BITS = 10, 60
#: Sources whose totals the driver holds while it works out budgets.
MAX_SOURCES = 100_000
#: Single documents a source that may fill what the threshold leaves.
TOP_UPS = 3


def _hash(*cols) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - HASH_BITS)


def plan_budgets(tokens: dict[str, int], weights: list[tuple[str, float, int]], total: int | None = None) -> list[tuple[str, float, float, int, int, int]]:
    """(source, target_share, share wanted of the result, available tokens, max_repeats, budget).

    A source that has no tokens can't take part: its share is divided among the others in
    proportion to theirs. Without `total` the result is as large as it can be with every share met
    exactly, each source giving at most max_repeats times its tokens. With a larger `total` sources
    that run out give all they may, and the rest is divided among the others in proportion.
    """
    live = [(s, Fraction(w), tokens.get(s, 0), max(0, r)) for s, w, r in weights]
    able = {s: (w, n * r) for s, w, n, r in live if w > 0 and n > 0 and r > 0}
    budget = {s: Fraction(0) for s, *_ in live}
    weight = sum(w for w, _ in able.values())
    if able:
        if total is None:
            size = min(cap / (w / weight) for w, cap in able.values())
            budget |= {s: size * w / weight for s, (w, _) in able.items()}
        else:
            left, open_ = Fraction(total), dict(able)
            while open_:
                share = sum(w for w, _ in open_.values())
                full = [s for s, (w, cap) in open_.items() if left * w / share >= cap]
                if not full:
                    budget |= {s: left * w / share for s, (w, _) in open_.items()}
                    break
                for s in full:
                    budget[s] = Fraction(open_.pop(s)[1])
                    left -= budget[s]
    return [(s, float(w), float(w / weight) if s in able else 0.0, n, r, round(budget[s])) for s, w, n, r in live]


def choose_thresholds(sized: DataFrame, remainders: DataFrame) -> DataFrame:
    """For each source the hash below which documents fit into its remainder: source, threshold, left.

    `sized` has source, h (a hash below 2**HASH_BITS), tokens; `remainders` has source and rest. Token
    sums by source and hash bucket give the bucket in which the running sum passes `rest`; only that
    bucket is refined, into as many buckets again, until it holds one document in every source (or
    the hash has no more bits). `left` is what the documents below the threshold leave of `rest`. No documents are sorted; a histogram has at most 2**BITS rows a source.
    """
    bucket_type = "array<struct<bucket:bigint,tokens:bigint,documents:bigint>>"
    state = remainders.select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("over"), F.lit(2).cast("long").alias("documents"), F.lit(True).alias("open"))
    shift = HASH_BITS
    while shift > 0 and not state.where("open and documents > 1").isEmpty():
        shift -= BITS
        prefix = state.select("source", F.col("bucket").alias("prefix")).where("open")
        inside = lookup_join(sized, prefix, ["source"], salt_on=["h"]).where(F.shiftrightunsigned("h", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftrightunsigned("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
        filled = sums.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("bucket", "tokens", "documents"))).alias("histogram"))

        # Walk the histogram: how much fits below, and the first bucket that does not fit as a whole.
        def end(left, bucket, over, documents, found):
            return F.struct(left.alias("left"), bucket.alias("bucket"), over.alias("over"), documents.alias("documents"), found.alias("found"))

        nothing = F.lit(0).cast("long")

        def step(so_far, x):
            fits = end(so_far["left"] - x["tokens"], so_far["bucket"], so_far["over"], so_far["documents"], F.lit(False))
            passed = end(so_far["left"], x["bucket"], x["tokens"], x["documents"], F.lit(True))
            return F.when(so_far["found"], so_far).when(x["tokens"] <= so_far["left"], fits).otherwise(passed)

        # Where everything fits, the threshold lies at the end of the bucket that was refined.
        behind = F.shiftleft(F.col("s.bucket") + 1, BITS)
        walk = F.aggregate(F.coalesce("f.histogram", F.array().cast(bucket_type)), end(F.col("s.left"), behind, nothing, nothing, F.lit(False)), step)
        walked = state.alias("s").join(filled.alias("f"), "source", "left").select(
            "source", F.when(F.col("s.open"), walk).otherwise(end(F.col("s.left"), F.shiftleft("s.bucket", BITS), nothing, nothing, F.lit(False))).alias("end")
        )
        state = materialise(walked.select("source", "end.left", "end.bucket", "end.over", "end.documents", F.col("end.found").alias("open")))
    return state.select("source", F.shiftleft("bucket", shift).alias("threshold"), "left")


def top_up(docs: DataFrame, bounds: DataFrame, id_cols: list[str], rounds: int = TOP_UPS) -> DataFrame:
    """Single documents beyond the threshold that come nearest to what is left: source and `id_cols`.

    Each round takes, per source, the one document that brings the sum nearest to the budget, if any
    brings it nearer than it is.
    """
    picks = None
    state = bounds
    for _ in range(rounds):
        beyond = lookup_join(docs, state, ["source"], salt_on=["h"]).where("h >= threshold and left > 0 and tokens < 2 * left")
        if picks is not None:
            beyond = lookup_join(beyond, picks, ["source", *id_cols], "left_anti", salt_on=["h"])
        best = beyond.groupBy("source").agg(F.min(F.struct(F.abs(F.col("left") - F.col("tokens")).alias("off"), "h", *id_cols, "tokens")).alias("best"))
        best = materialise(best.select("source", "best.tokens", *(F.col("best." + c) for c in id_cols)))
        state = materialise(state.join(best.select("source", "tokens"), "source").select("source", "threshold", (F.col("left") - F.col("tokens")).alias("left")))
        new = best.drop("tokens")
        picks = new if picks is None else picks.unionByName(new)
    return picks


def mix_sources(sized: DataFrame, weights: DataFrame, id_cols: list[str], total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Which documents the mixture holds and how often, and the shares it reaches.

    `sized` has source, tokens and `id_cols`; `weights` has source, target_share and max_repeats.
    Gives (chosen, report). chosen: `id_cols`, source, tokens, copies, copies at most max_repeats. report:
    one row per source of either side with target_share, wanted_share (the target among sources
    that can take part), available_tokens, max_repeats, mixed_documents, mixed_tokens,
    actual_share. See `plan_budgets` for the size of the mixture.

    Every document of a source is used as often as its tokens go into the budget as a whole; the rest
    of the budget goes to the documents whose hash lies below a threshold, each once more, and a few
    single documents fill what these leave. Documents
    without tokens, source or a positive target are not used. Weights of a repeated source are
    added, and the smallest of its max_repeats counts; a null share counts as 0, a null max_repeats as 1.
    """
    spark = sized.sparkSession
    docs = sized.select(*id_cols, "source", "tokens").where("tokens > 0 and source is not null")
    docs = materialise(docs.withColumn("h", _hash(*id_cols, "source")))
    totals_df = materialise(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    wanted = weights.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    rows = wanted.join(totals_df, "source", "left").select("source", "share", "repeats", "tokens").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} weighted sources")
    plan = plan_budgets({r.source: int(r.tokens or 0) for r in rows}, [(r.source, r.share, r.repeats) for r in rows], total)
    data = [(s, share, want, n, r, b, b // n if n else 0, b % n if n else 0) for s, share, want, n, r, b in plan]
    budgets = spark.createDataFrame(data, "source string, target_share double, wanted_share double, available_tokens long, max_repeats int, budget long, whole long, rest long")
    bounds = choose_thresholds(docs, budgets.where("rest > 0").select("source", "rest"))
    bounds = materialise(bounds)
    extra = top_up(docs, bounds, id_cols).withColumn("extra", F.lit(1))
    rule = budgets.join(bounds, "source", "left").select("source", "max_repeats", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    copies = F.least(F.col("whole") + F.when((F.col("h") < F.col("threshold")) | F.col("extra").isNotNull(), 1).otherwise(0), F.col("max_repeats").cast("long")).cast("int")
    chosen = lookup_join(lookup_join(docs, rule, ["source"], salt_on=["h"]), extra, ["source", *id_cols], "left", salt_on=["h"]).withColumn("copies", copies).where("copies > 0").select(*id_cols, "source", "tokens", "copies")
    got = chosen.groupBy("source").agg(F.sum("copies").alias("mixed_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    all_tokens = got.agg(F.sum("mixed_tokens")).first()[0] or 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = (
        budgets.drop("available_tokens")
        .join(totals_df.withColumnRenamed("tokens", "available_tokens"), "source", "full")
        .join(got, "source", "left")
        .select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("wanted_share", F.lit(0.0)).alias("wanted_share"), zero("available_tokens"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), zero("mixed_documents"), zero("mixed_tokens"),
                F.coalesce(F.col("mixed_tokens") / F.lit(all_tokens), F.lit(0.0)).alias("actual_share"))
    )
    return chosen, report
