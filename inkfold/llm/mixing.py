"""Mixing sources by temperature, with DataFrame functions only.

A source's weight is its share of tokens to the power tau, normalised. tau = 1 keeps the corpus as it is and
tau = 0 makes all sources equal; entropy falls and the repetition of small sources falls as tau grows. tau is
bisected to the target entropy, by aggregations over the table of sources that try ``PROBES`` exponents at once; where a
small source would then be repeated more than ``max_epochs`` times as often as the least repeated one, tau is bisected to
that limit.

The budget is ``budget_tokens``, or else as many tokens as let the least repeated source be used exactly once,
so that no document is lost. A source's share of the budget is realised as whole epochs and a part of
one: its documents lie in ``2**block_bits`` blocks, the blocks are permuted by a hash, and whole blocks are
taken in that order until the budget ends within one; in that one, documents are taken in hashed order until
the budget is reached. A copy never exceeds the source's budget.

There may be any number of sources; their table is broadcast if it was counted to be small, else its hot sources are. A
source of any size is spread over its blocks, which are summed before the shuffle; windows run over a source's
blocks and over one block's documents only.

Nulls: a null source is a source of its own; a null text has no tokens; null ids are ordered by the hash of
null. Repeated rows are documents of their own and are taken or left together; so are rows that tie in rank. A text of
any length counts whole. Columns of df named like the three of the result are replaced, others of any name stay. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkfold.llm.common import fresh, label_join, materialise

#: Exponents that one aggregation tries, and how many aggregations there are: tau is found to PROBES ** -ROUNDS.
PROBES, ROUNDS = 64, 8
STEPS = 60


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    # Of each word its first character stays.
    firsts = F.regexp_replace(text, r"[\x20\x09-\x0D]+|([^\x20\x09-\x0D])[^\x20\x09-\x0D]*", "$1")
    return F.coalesce(F.length(firsts), F.lit(0)).cast("long")


def _by_entropy(shares: DataFrame, entropy_share: float) -> float:
    """The largest tau in 0..1 at which the entropy still is at least the target, from shares(p double)."""

    def entropies(taus: list[float]) -> list[float]:
        """log of the sum of powers minus the mean of their logs: - sum w ln w."""
        tau = F.explode(F.transform(F.array(*map(F.lit, taus)), lambda t, i: F.struct(i.alias("i"), t.alias("tau"))))
        power = F.exp(F.col("t.tau") * F.log("p"))
        sums = shares.select("p", tau.alias("t")).groupBy("t.i").agg(F.sum(power).alias("z"), F.sum(power * F.col("t.tau") * F.log("p")).alias("logs"))
        found = {r["i"]: r["h"] for r in sums.select("i", (F.log("z") - F.col("logs") / F.col("z")).alias("h")).collect()}
        return [found[i] for i in range(len(taus))]

    most, own = entropies([0.0, 1.0])
    target = own + entropy_share * (most - own)
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        taus = [lo + (hi - lo) * k / PROBES for k in range(1, PROBES)]
        good = sum(h >= target for h in entropies(taus))  # it falls, so these come first
        lo, hi = ([lo] + taus)[good], (taus + [hi])[good]
    return lo


def _by_epochs(spread: float, max_epochs: float) -> float:
    """The least tau in 0..1 at which epochs, in proportion to share ** (tau - 1), differ by max_epochs at most."""
    lo, hi = 0.0, 1.0
    if spread <= max_epochs:
        return lo
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if spread ** (1 - mid) <= max_epochs else (mid, hi)
    return hi


def mixture(sources: DataFrame, *, entropy_share: float, max_epochs: float) -> float:
    """tau for sources(tokens long).

    The target entropy lies entropy_share of the way from the corpus's own to that of equal sources.
    """
    some = sources.where("tokens > 0")
    row = some.agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if row["n"] < 2:
        return 1.0
    if entropy_share <= 0 or row["least"] == row["most"]:
        return 1.0
    shares = some.select((F.col("tokens") / F.lit(float(row["total"]))).alias("p"))
    return max(_by_entropy(shares, entropy_share), _by_epochs(row["most"] / row["least"], max_epochs))


def _block(row_id: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(row_id, F.lit(5)), 64 - bits)


def _rank(source: Column, row_id: Column, bits: int, seed: int) -> Column:
    """A document's place: its block's place in the permutation, then its own in the block."""
    place = F.shiftrightunsigned(F.xxhash64(source, _block(row_id, bits), F.lit(seed)), 33)
    return F.shiftleft(place, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(row_id, F.lit(seed + 1)), 32))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    *,
    entropy_share: float = 0.5,
    max_epochs: float = 4.0,
    budget_tokens: int | None = None,
    block_bits: int = 12,
    seed: int = 1,
) -> DataFrame:
    """df's rows, each as often as its source's weight asks for, with mix_tokens long (of the row), mix_epoch int
    (from 0) and mix_rank long (its place in the last, broken epoch); such columns of df are replaced."""
    bare = df.drop("mix_tokens", "mix_epoch", "mix_rank")
    # A source's name, which isn't null.
    source = F.concat(F.when(F.col(source_col).isNull(), "").otherwise("="), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    slim = materialise(
        df.select(
            source.alias("s"), F.col(id_col).cast("string").alias("id"), word_tokens(F.col(text_col)).alias("tokens"),
        ).withColumn("rank", _rank(F.col("s"), F.col("id"), block_bits, seed))
    )
    per_source = materialise(slim.groupBy("s").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies")))
    tau = mixture(per_source, entropy_share=entropy_share, max_epochs=max_epochs)
    # Epochs of a source: c * tokens ** (tau - 1).
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(tau - 1)))
    if budget_tokens is None:
        scale = per_source.agg(1 / F.min(power)).first()[0]
    else:
        scale = per_source.agg(F.lit(float(budget_tokens)) / F.sum(power * F.col("tokens"))).first()[0]
    epochs = F.coalesce(power * F.lit(scale if scale is not None else 1.0), F.lit(1.0))
    plan = per_source.withColumn("epochs", epochs).select(
        "s",
        "copies",
        # 1e-9: the least repeated source's epochs are 1 but for rounding.
        F.floor(F.col("epochs") + 1e-9).cast("int").alias("whole"),
        F.greatest(F.lit(0), F.floor((F.col("epochs") - F.floor(F.col("epochs") + 1e-9)) * F.col("tokens") + 1e-6)).cast("long").alias("rest"),
    )
    # The block in which a source's budget ends, from its blocks' sums ...
    block = F.shiftright("rank", 32)
    sums = materialise(slim.groupBy("s", block.alias("place")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies")))
    running = F.sum("tokens").over(Window.partitionBy("s").orderBy("place"))
    ends = (
        sums.withColumn("end", running).join(plan.select("s", "rest"), "s")
        .where("rest > 0 and end > rest").groupBy("s")
        .agg(F.min(F.struct("place", (F.col("end") - F.col("tokens")).alias("before"), "rest", F.col("copies"))).alias("e"))
        .select("s", "e.*")
    )
    # ... and the document in it.
    inside = label_join(slim.select("s", block.alias("place"), "rank", "tokens"), materialise(ends), ["s", "place"]).where("rest is not null")
    upto = F.sum("tokens").over(Window.partitionBy("s").orderBy("rank"))
    cut = inside.withColumn("end", F.col("before") + upto).where("end > rest").groupBy("s").agg(F.min("rank").alias("cut"))
    names = {c: fresh(bare, f"mix_{c}") for c in ("s", "whole", "cut", "copies")}
    # No cut: the budget takes no part of an epoch, or (of no tokens) all of it.
    last = plan.join(cut, "s", "left").select(
        F.col("s").alias(names["s"]), F.col("whole").alias(names["whole"]), F.coalesce("cut", F.lit(0).cast("long")).alias(names["cut"]), F.col("copies").alias(names["copies"])
    )
    ranked = bare.withColumns({"mix_tokens": word_tokens(F.col(f"`{text_col}`")), names["s"]: source})
    ranked = ranked.withColumn("mix_rank", _rank(F.col(names["s"]), F.col(id_col).cast("string"), block_bits, seed))
    joined = label_join(ranked, materialise(last), [names["s"]], names["copies"])
    copies = F.col(names["whole"]) + (F.col("mix_rank") < F.col(names["cut"])).cast("int")
    return (
        joined.withColumn(names["copies"], copies)
        .where(F.col(names["copies"]) > 0)
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col(names["copies"]) - 1)))
        .select(*[F.col(f"`{c}`") for c in bare.columns], "mix_tokens", "mix_rank", "mix_epoch")
    )
