"""Mixing sources to target weights, with DataFrame and SQL functions only.

Method: a source's natural share p of the tokens becomes a weight in proportion to
p ** exponent.  The exponent is bisected (64 ways a step, over aggregates of the table of
sources) for the largest one whose weights reach the target entropy, and raised where that
is needed to keep every source within the repetition limit.  Weights times budget are token
budgets.  A source's documents lie in hashed blocks in a hashed order (a block permutation);
a budget takes whole passes over the source and then blocks in that order; the block
that would overrun is cut within the same kind of order over its documents.

Per-source decisions are one small row each, broadcast for up to ``BROADCAST_SOURCES`` sources;
running sums go over hashed ranges of blocks first and blocks within a range
second, so no task holds a whole source.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and
follow their block; repeated rows fall together; an empty table stays empty; where even
natural shares exceed the repetition limit, natural shares are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_broadcast, release, settle

#: Ways of a bisection step, steps, digits kept of a weight.
WAYS, STEPS, DIGITS = 64, 5, 9
#: Sources (a row of about 100 bytes each) broadcast at most; more meet in a shuffle join.
BROADCAST_SOURCES = 100_000
#: Hashed ranges of a source's blocks.
RANGES = 1024

_BLANK = r"[\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words of a text (0 for null or blank)."""
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.isNull() | (bare == ""), 0).otherwise(F.size(F.split(bare, _BLANK, -1))).cast("long")


def hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def _measures(sources: DataFrame, brackets: list[tuple[float, float]], budget: float) -> list[list]:
    """For each bracket, cut in ``WAYS``: entropy and largest number of repetitions at each exponent."""
    places = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(lo).alias("lo"), F.lit(hi - lo).alias("width")) for j, (lo, hi) in enumerate(brackets)])
    rows = sources.select("t", F.log("p").alias("l"), F.explode(places).alias("g")).select("t", "l", "g.*", F.explode(F.sequence(F.lit(0), F.lit(WAYS))).alias("i"))
    rows = rows.withColumn("a", F.col("lo") + F.col("width") * F.col("i") / WAYS).withColumn("w", F.exp(F.col("a") * F.col("l")))
    z = F.sum("w")
    found = rows.groupBy("j", "i").agg((F.log(z) - F.first("a") * F.sum(F.col("w") * F.col("l")) / z).alias("h"), (F.max(F.col("w") / F.col("t")) * F.lit(budget) / z).alias("r"))
    out: list[list] = [[None] * (WAYS + 1) for _ in brackets]
    for r in found.collect():
        out[r["j"]][r["i"]] = r["h"], r["r"]
    return out


def find_exponent(sources: DataFrame, entropy_share: float, max_repeats: float, budget: float) -> float:
    """Exponent in [0, 1] for sources (t tokens, p share): both limits are bisected side by side."""
    n = sources.count()
    if n < 2:
        return 1.0
    target = entropy_share * math.log(n)
    even, rare = (0.0, 1.0), (0.0, 1.0)
    for _ in range(STEPS):
        by_entropy, by_repeats = _measures(sources, [even, rare], budget)
        # Entropy falls as the exponent grows; so does the number of repetitions.
        k = max((i for i, (h, _) in enumerate(by_entropy) if h >= target), default=0)
        even = tuple(even[0] + (even[1] - even[0]) * i / WAYS for i in (k, min(k + 1, WAYS)))
        k = min((i for i, (_, r) in enumerate(by_repeats) if r <= max_repeats), default=WAYS)
        rare = tuple(rare[0] + (rare[1] - rare[0]) * i / WAYS for i in (max(k - 1, 0), k))
    return max(even[0], rare[1])


def plan(docs: DataFrame, entropy_share: float = 0.95, max_repeats: float = 4.0, budget_share: float = 1.0, block_tokens: int = 100_000, seed: int = 7) -> DataFrame:
    """One row a source: natural share, weight, budget, passes and where its last pass ends.

    ``docs`` has __s (source key), __id, __n (tokens).
    """
    sources = settle(docs.groupBy("__s").agg(F.sum("__n").alias("t")))
    total = sources.agg(F.sum("t")).first()[0] or 0
    budget = float(math.floor(budget_share * total))
    live = sources.filter("t > 0").withColumn("p", F.col("t") / F.lit(float(max(total, 1))))
    alpha = find_exponent(live, entropy_share, max_repeats, budget)
    power = F.exp(F.lit(alpha) * F.log("p"))
    z = live.agg(F.sum(power)).first()[0] or 1.0
    weights = live.withColumn("weight", F.round(power / F.lit(z), DIGITS)).withColumn("budget", F.floor(F.col("weight") * F.lit(budget)))
    weights = weights.withColumn("passes", F.floor(F.col("budget") / F.col("t"))).withColumn("rest", F.col("budget") - F.col("passes") * F.col("t"))
    weights = sources.select("__s").join(weights, "__s", "left").na.fill(0)
    weights = settle(weights.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("t") / block_tokens))))

    n_sources = weights.count()
    placed = docs.join(maybe_broadcast(weights.select("__s", "blocks", "rest"), n_sources, BROADCAST_SOURCES), "__s").filter("rest > 0").withColumns(_place(seed))
    blocks = settle(placed.groupBy("__s", "rest", "block", "block_order").agg(F.sum("__n").alias("n")))
    ranges = blocks.groupBy("__s", _range().alias("part")).agg(F.sum("n").alias("n"))
    before = ranges.withColumn("before", F.sum("n").over(Window.partitionBy("__s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"]).drop("n")
    inner = Window.partitionBy("__s", "part").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.withColumn("part", _range()).join(before, ["__s", "part"]).withColumn("done", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    cut = runs.filter("done <= rest and done + n > rest").groupBy("__s").agg(F.min(F.struct("block_order", "block", (F.col("rest") - F.col("done")).alias("left"))).alias("c"))
    cut = cut.select("__s", "c.block_order", "c.block", "c.left")
    doc_order = hashed(F.lit(f"{seed}d"), F.col("__id"))
    cut = settle(cut)
    inside = placed.join(maybe_broadcast(cut, n_sources, BROADCAST_SOURCES), ["__s", "block_order", "block"]).select("__s", "left", doc_order.alias("o"), "__n")
    reach = inside.groupBy("__s", "left", "o").agg(F.sum("__n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("__s").orderBy("o")))
    last = reach.filter("upto <= left").groupBy("__s").agg(F.max("o").alias("last_order"))
    out = weights.join(cut.select("__s", F.col("block_order").alias("cut_order"), F.col("block").alias("cut_block")), "__s", "left").join(last, "__s", "left")
    return settle(out)


def _range() -> Column:
    return F.shiftright(F.col("block_order"), 50).cast("int")


def _place(seed: int) -> dict[str, Column]:
    block = F.pmod(hashed(F.lit(f"{seed}b"), F.col("__id")), F.col("blocks"))
    return {"block": block, "block_order": hashed(F.lit(f"{seed}o"), F.col("__s"), block.cast("string"))}


MADE = ("n_tokens", "weight", "copies", "block", "block_order")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokens: str | None = None, entropy_share: float = 0.95, max_repeats: float = 4.0, budget_share: float = 1.0, block_tokens: int = 100_000, seed: int = 7) -> DataFrame:
    """``docs`` plus n_tokens, weight (of the source), copies (times the document is taken),
    block and block_order (sort by these for the permuted order).

    Such columns are replaced; all others, of whatever names, pass through.  Texts are read once
    for the plan and once for the result; where ``docs`` has the numbers of tokens in a column
    ``tokens``, not at all.
    """
    read = [doc_id, source, text if tokens is None else tokens]
    count = n_tokens(F.col(text)) if tokens is None else F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long"))
    key = F.concat(F.when(F.col(source).isNull(), "-").otherwise("+"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    own = [F.col(c).alias(f"__{k}") for k, c in enumerate(read)]
    extra = F.struct(*[c for c in docs.columns if c not in read]).alias("__extra")
    marked = docs.select(*own, extra, key.alias("__s"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__id"), count.alias("__n"))
    slim = settle(marked.select("__s", "__id", "__n"))
    sources = plan(slim, entropy_share, max_repeats, budget_share, block_tokens, seed)
    release(slim)
    slim = sources.select("__s", "weight", "passes", "rest", "blocks", "cut_order", "cut_block", "last_order")
    found = marked.join(maybe_broadcast(slim, sources.count(), BROADCAST_SOURCES), "__s").withColumns(_place(seed))
    order = hashed(F.lit(f"{seed}d"), F.col("__id"))
    earlier = (F.col("block_order") < F.col("cut_order")) | ((F.col("block_order") == F.col("cut_order")) & (F.col("block") < F.col("cut_block")))
    at_cut = (F.col("block_order") == F.col("cut_order")) & (F.col("block") == F.col("cut_block")) & (order <= F.col("last_order"))
    one_more = F.when(F.col("rest") > 0, F.coalesce(earlier | at_cut, F.lit(False))).otherwise(F.lit(False))
    back = [F.col(f"__{read.index(c)}" if c in read else f"__extra.`{c}`").alias(c) for c in docs.columns if c not in MADE]
    copies = (F.col("passes") + one_more.cast("long")).cast("long").alias("copies")
    return found.select(*back, F.col("__n").alias("n_tokens"), "weight", copies, "block", "block_order")
