"""Mixing sources by temperature: weights from token shares, realised as budgeted permutations of blocks."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.llm.common import renamed
from alarmspan.session import cut_lineage

# Exponents tried in one pass over the sources (four bisections at once), and passes.
SECTIONS, PASSES = 15, 12


@dataclass(frozen=True)
class Target:
    """What the exponent must meet.

    ``evenness``: the entropy of the weights as a share of the largest possible (log of the number of sources).
    ``most_passes``: no source is read more often than this.  ``budget``: tokens to emit; None: as many as it takes for
    every source to be read once in full.
    """
    evenness: float = 0.97
    most_passes: float = 2.0
    budget: int | None = None


def word_count(text: Column) -> Column:
    """Tokens of a text for the shares: words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(totals: DataFrame, target: Target) -> float:
    """The largest exponent in [0, 1] whose weights are even enough, raised until no source is repeated beyond the limit
    if both cannot be had.

    Weights are share^exponent, normalised.  A smaller exponent gives evener weights and repeats small sources more often,
    both monotonically, so each bound is bisected, several exponents per aggregate over the table of sources; sums and
    extremes reach the driver.  Sources without tokens have no weight.
    """
    live = totals.where("tokens > 0")
    total, n, most, least = live.agg(F.sum("tokens"), F.count(F.lit(1)), F.max("tokens"), F.min("tokens")).first()
    if not n:
        return 1.0
    shares = live.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def measure(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy as a share of the largest, passes over the smallest source) of each exponent."""
        powers = [F.pow("p", F.lit(a)) for a in exponents]
        row = shares.agg(*[F.sum(w) for w in powers], *[F.sum(w * F.ln("p")) for w in powers]).first()
        out = []
        for a, z, zl in zip(exponents, row, row[len(exponents):]):
            entropy = math.log(z) - a * zl / z
            passes = (most / least) ** (1 - a) if target.budget is None else target.budget * (least / total) ** a / z / least
            out.append((entropy / math.log(n) if n > 1 else 1.0, passes))
        return out

    def bisect(below) -> float:
        """Where ``below`` (of evenness and passes) turns from true to false."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            inner = [low + (high - low) * i / (SECTIONS + 1) for i in range(1, SECTIONS + 1)]
            held = [a for a, m in zip(inner, measure(inner)) if below(*m)]
            edge = [low, *inner, high]
            low, high = edge[len(held)], edge[len(held) + 1]
        return high

    (evenness, passes), = measure([1.0])
    even = 1.0 if evenness >= target.evenness else bisect(lambda e, _: e >= target.evenness)
    if even < 1.0 and measure([even])[0][1] > target.most_passes:
        even = bisect(lambda _, times: times > target.most_passes)
    return even


def mix(docs: DataFrame, target: Target = Target(), seed: int = 1, block_docs: int = 1000, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """Rows of ``docs`` as often as the mix reads them, with the order of reading.

    Source shares are counted in words.  A source's passes are its weight times the budget over its tokens: so many whole
    permutations of it, then part of one more, up to its budget.  A permutation orders blocks of documents by a hash of
    seed, pass, source and block, and documents in a block by a hash of seed, pass and doc_id; the part that is read ends
    with the document that reaches the budget.  Prefix sums run over blocks, and over documents in the one block of a source
    that is cut, so a source with a third of all rows is spread like any other.

    Added columns (under free names): n_tokens, pass, block, block_key, doc_key; (pass, block_key, doc_key) sorts the mix.
    Null sources are one source; null and empty texts have no tokens and are read with their source's whole passes; a source
    without any tokens is read once.  Repeated rows count each; null doc_ids share a place in the order; an empty
    table gives no rows.
    """
    n_tokens, nth, block, block_key, doc_key = added_columns(docs)
    blocks = max(1, math.ceil(docs.count() / block_docs))
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    counted = docs.withColumns({n_tokens: word_count(F.col(text)), block: _hashed(F.lit(str(seed)), ident) % blocks})
    sums = cut_lineage(counted.groupBy(F.col(source).alias("_source"), F.col(block).alias("_block"))
                              .agg(F.sum(n_tokens).alias("tokens")), "mix-blocks")
    totals = sums.groupBy("_source").agg(F.sum("tokens").alias("tokens"))
    power = exponent(totals, target)
    live = totals.where("tokens > 0").agg(F.sum("tokens"), F.max("tokens"), F.sum(F.pow("tokens", F.lit(power)))).first()
    t = F.col("tokens").cast("double")
    if target.budget is None:
        quota = F.floor(t * F.pow(F.lit(float(live[1] or 0)) / t, F.lit(1 - power)))
    else:
        quota = F.floor(F.lit(float(target.budget)) * F.pow(t, F.lit(power)) / F.lit(float(live[2] or 1)))
    read = totals.select("_source", F.when(F.col("tokens") > 0, quota).alias("quota"), "tokens").select(
        F.col("_source").alias("_reader"), F.coalesce(F.floor(F.col("quota") / F.col("tokens")), F.lit(1)).cast("long").alias("_whole"),
        F.coalesce(F.col("quota") % F.col("tokens"), F.lit(0)).cast("long").alias("_rest"))
    named = F.coalesce(F.col("_source").cast("string"), F.lit(""))
    places = sums.join(read, F.col("_source").eqNullSafe(F.col("_reader"))).select(
        "_source", "_block", "tokens", "_whole", "_rest",
        _hashed(F.lit(str(seed)), F.col("_whole").cast("string"), named, F.col("_block").cast("string")).alias("_place"))
    before = Window.partitionBy("_source").orderBy("_place", "_block").rowsBetween(Window.unboundedPreceding, -1)
    of, at, whole, room, times = renamed(docs, "_of", "_at", "_whole", "_room", "_times")
    places = places.select(F.col("_source").alias(of), F.col("_block").alias(at), F.col("_whole").alias(whole),
                           (F.col("_rest") - F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias(room))
    joined = counted.join(places, counted[source].eqNullSafe(places[of]) & (counted[block] == places[at]))
    inside = Window.partitionBy(of, at).orderBy(
        _hashed(F.lit(str(seed)), F.col(whole).cast("string"), ident), n_tokens).rowsBetween(Window.unboundedPreceding, -1)
    read_before = F.coalesce(F.sum(n_tokens).over(inside), F.lit(0))
    emitted = joined.withColumn(times, F.col(whole) + F.when(read_before < F.col(room), 1).otherwise(0)).where(
        F.col(times) > 0).withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    named = F.coalesce(F.col(of).cast("string"), F.lit(""))
    return emitted.select(
        *[counted[c] for c in docs.columns], n_tokens, nth, block,
        _hashed(F.lit(str(seed)), F.col(nth).cast("string"), named, F.col(block).cast("string")).alias(block_key),
        _hashed(F.lit(str(seed)), F.col(nth).cast("string"), ident).alias(doc_key))


def added_columns(docs: DataFrame) -> list[str]:
    return renamed(docs, "n_tokens", "pass", "block", "block_key", "doc_key")


def _hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")
