"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is to give a number of words. That number is turned into blocks of equal length by highest
quotients ``target / (2 k + 1)``: first among the sources, then among the shards of each source, in proportion to
their words. A shard's quota is an integer number of blocks, and its blocks are taken in a seeded order until
the quota is full. What is asked for beyond a shard's own words goes round again as whole passes.

No step sees a source, or all sources, in one task. The seats that can be in doubt are few: with ``n`` parties and
``q`` seats, a party of the share ``v`` has at least ``v (q - n / 2) - 1 / 2`` and at most ``v (q + n / 2) + 1 / 2`` of
them, so only a number of quotients in proportion to ``n`` has to be put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.operators.joins import dealt as dealt_out
from likeness.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 18


def seeded(seed: int, *values: Column) -> Column:
    """A repeatable order by a hash that every engine has."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[v.cast("string") for v in values]))


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Rows with their place, from 0, in one order over all of them; sorted in parts, each part counted.

    The offsets have a row for each part, however many rows there are.
    """
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + within).drop("_part", "_at", "_before")


def highest_quotients(parties: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``quota``, the integer number of seats of each party by Sainte-Laguë, within each group.

    ``parties`` has ``votes``, its group's ``seats`` and the ``group`` as a whole number; ``order`` settles equal quotients. The quotients
    above the lower bound and below the upper one are put in order and the highest take the seats that are left.
    """
    sums = parties.groupBy(group).agg(F.sum("votes").alias("_all"), F.count_if(F.col("votes") > 0).alias("_n"))
    known = parties.join(sums, group)
    share = F.when(F.col("_all") > 0, F.col("votes") / F.col("_all")).otherwise(F.lit(0.0))
    low = F.greatest(F.floor(share * (F.col("seats") - F.col("_n") / 2) - 0.5) - 1, F.lit(0)).cast("long")
    high = F.when(share > 0, F.ceil(share * (F.col("seats") + F.col("_n") / 2) + 0.5) + 1).otherwise(0).cast("long")
    bounded = stored(known.withColumns({"_low": low, "_high": high}).drop("_all", "_n"), "parties")
    open_seats = bounded.filter("_high > _low").select(
        group, *order, "votes", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat")
    )
    quotient = F.col("votes") / (2 * F.col("_seat") + 1)
    lined = stored(
        numbered(open_seats.withColumn("_quotient", quotient), [group, F.desc("_quotient"), *order]), "quotients"
    )
    left = bounded.groupBy(group).agg((F.max("seats") - F.sum("_low")).alias("_left"))
    cut = lined.groupBy(group).agg(F.min("number").alias("_first")).join(left, group)
    won = lined.join(cut, group).filter(F.col("number") - F.col("_first") < F.col("_left"))
    more = won.groupBy(group, *order).agg(F.count("*").alias("_more"))
    return bounded.join(more, [group, *order], "left").withColumn(
        "quota", F.col("_low") + F.coalesce("_more", F.lit(0))
    ).drop("_low", "_high", "_more")


def with_targets(sources: DataFrame, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Add ``target`` to sources with ``source_size`` and ``weight``.

    ``share`` of all sizes is dealt by weight; sources that would get more than ``limit`` times their size get just that, and what is
    over is dealt among the others again, until no more source is full. Each round is one sum over the table;
    the level only rises, and few rounds are needed.
    """
    level = (0.0, 0, 1)
    while True:
        words, full, open_weight = level
        per_weight = (words - full) / open_weight
        capped = limit * F.col("source_size") < F.col("weight") * F.lit(per_weight)
        found = sources.agg(
            F.sum("source_size"), F.sum(F.when(capped, limit * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        following = (share * (found[0] or 0), found[1] or 0, found[2] or 0)
        if not following[2] or following == level:
            break
        level = following
    words, full, open_weight = level
    dealt = F.col("weight") * F.lit(float(words - full)) / F.lit(float(open_weight))
    return sources.withColumn("target", F.least(dealt, (limit * F.col("source_size")).cast("double")))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    limit: int = LIMIT,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 42,
) -> DataFrame:
    """What the mix takes of every document: doc_id, source, size, source_size, target, shard, passes, spans, taken.

    ``passes`` tells how often the whole document is taken, ``spans`` which runs of its words (start, end, from 0)
    once more; ``taken`` is their words. A source gives its quota of blocks, at most ``limit`` times its words.
    ``docs`` has ``doc_id``, ``source`` and ``text``; other columns are ignored. A null or empty text has size 0 and gives nothing, a null
    source is a source of its own, the last one, a null doc_id an id like any other, equal rows count each. An empty table gives an empty result.
    """
    facts = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
            F.col("source").isNull().alias("unnamed"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    sums = facts.groupBy("unnamed", "name").agg(F.sum("size").alias("source_size"))
    lined = numbered(sums, ["unnamed", "name"], "source_no")
    weight = F.element_at(F.lit(list(weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    # All sources are one group; the column is read back, so that joins by it are not folded into cross joins.
    whole = stored(lined.withColumns({"weight": weight, "all": F.lit(0)}), "sources")
    sources = with_targets(whole, share, limit)
    wanted = sources.agg(F.sum("target")).first()[0] or 0.0
    seated = sources.withColumns({"votes": F.col("target"), "seats": F.lit(int(wanted / block + 0.5))})
    quotas = highest_quotients(seated, "all", ["source_no"])
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long").alias("shards")
    given = stored(
        quotas.select("unnamed", "name", "source_no", "source_size", "target", F.col("quota").alias("seats"), shards),
        "quotas",
    )

    order = seeded(seed, F.col("doc_id"))
    dealt = F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.col("shards"))
    placed = stored(
        facts.join(given.drop("seats"), ["unnamed", "name"]).withColumn("order", order).withColumn("shard", dealt).drop("shards"),
        "placed",
    )
    cells = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("cell_size"))
    votes = cells.join(given.select("source_no", "seats"), "source_no").withColumn("votes", F.col("cell_size").cast("double"))
    cells = highest_quotients(votes, "source_no", ["shard"])

    # A shard's quota in words, as whole passes, whole blocks, and words of one more block.
    asked = F.least(F.col("quota") * block, limit * F.col("cell_size"))
    blocks = F.floor((F.col("cell_size") - 1) / block)  # all but the last, which may be short and comes last
    inner = F.when(blocks > 0, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array().cast("array<long>"))
    keyed = F.transform(inner, lambda i: seeded(seed, F.col("source_no"), F.col("shard"), i))
    # A short row stands for many blocks, so the rows are dealt out first.
    filled = dealt_out(cells.filter("cell_size > 0"), "source_no", "shard").withColumn("asked", asked).select(
        "source_no",
        "shard",
        F.floor(F.col("asked") / F.col("cell_size")).alias("passes"),
        F.floor(F.col("asked") % F.col("cell_size") / block).alias("whole"),
        (F.col("asked") % F.col("cell_size") % block).alias("part"),
        F.array_sort(keyed).alias("keys"),
        blocks.alias("last"),
    )
    cuts = filled.select("source_no", "shard", "passes", "whole", "part", "last", F.get("keys", F.col("whole").cast("int")).alias("cut"))

    lying = Window.partitionBy("source_no", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lines = placed.withColumn("start", F.coalesce(F.sum("size").over(lying), F.lit(0)))
    both = lines.join(cuts, ["source_no", "shard"], "left")

    def span(i: Column) -> Column:
        """The words of block ``i`` that are the document's, as far as the block is taken."""
        key = seeded(seed, F.col("source_no"), F.col("shard"), i)
        inside = i < F.col("last")
        chosen = F.when(inside & (F.col("cut").isNull() | (key < F.col("cut"))), block)
        # Past the other blocks comes the last one, as the one that is cut.
        split = F.when(inside, key == F.col("cut")).otherwise(F.col("cut").isNull() & (F.col("whole") == F.col("last")))
        n = F.coalesce(chosen, F.when(split, F.col("part")), F.lit(0))
        return F.struct(
            F.greatest(i * block - F.col("start"), F.lit(0)).cast("long").alias("start"),
            F.least(i * block + n - F.col("start"), F.col("size")).cast("long").alias("end"),
        )

    touched = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    spans = F.filter(F.transform(touched, span), lambda s: s["end"] > s["start"])
    once_more = (F.col("whole") > 0) | (F.col("part") > 0)
    marked = both.withColumn("spans", F.when((F.col("size") > 0) & once_more, spans).otherwise(F.array().cast("array<struct<start:long,end:long>>")))
    passes = F.coalesce("passes", F.lit(0)).cast("long")
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return marked.select(
        "doc_id",
        F.when(~F.col("unnamed"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        "shard",
        passes.alias("passes"),
        "spans",
        (passes * F.col("size") + extra).alias("taken"),
    )


def op11_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def sql(weights=WEIGHTS, share=SHARE, limit=LIMIT, block=BLOCK_WORDS, shard_words=SHARD_WORDS) -> str:
    """The same in SQL: all quotients are listed and ranked, all blocks and words laid out."""
    return f"""
WITH facts AS (
  SELECT doc_id, coalesce(source, '') AS name, source IS NULL AS unnamed,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT *, row_number() OVER (ORDER BY unnamed, name) - 1 AS source_no
  FROM (SELECT unnamed, name, sum(size)::BIGINT AS source_size FROM facts GROUP BY ALL)
), weighted AS (
  SELECT *, [{", ".join(map(str, weights))}][(source_no % {len(weights)} + 1)::INT] AS weight FROM sources
), lined AS (
  SELECT *, {limit} * source_size / weight AS fills_at,
         coalesce(sum({limit} * source_size) OVER before, 0) AS full_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
         {share} * sum(source_size) OVER () AS words
  FROM weighted
  WINDOW before AS (ORDER BY {limit} * source_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (words - full_before)::DOUBLE AS rest, open_weight::DOUBLE AS open_weight FROM lined
  WHERE (words - full_before) / open_weight <= fills_at ORDER BY fills_at, source_no LIMIT 1
), targets AS (
  SELECT w.*, least(weight * rest / level.open_weight, ({limit} * source_size)::DOUBLE) AS target FROM weighted w, level
), seats AS (
  SELECT t.source_no, target / (2 * k + 1) AS quotient, k FROM targets t, unnest(range((target / {block})::BIGINT + (SELECT count(*) FROM targets) + 2)) AS u(k)
  WHERE target > 0
), quotas AS (
  SELECT source_no, count(*) AS seats FROM (
    SELECT *, row_number() OVER (ORDER BY quotient DESC, source_no) AS place FROM seats)
  WHERE place <= (SELECT floor(sum(target) / {block} + 0.5) FROM targets) GROUP BY source_no
), placed AS (
  SELECT f.doc_id, f.size, t.source_no, t.source_size, t.target, md5('42' || coalesce('|' || doc_id, '')) AS ord,
         ('0x' || md5('42' || coalesce('|' || doc_id, ''))[1:8])::BIGINT % greatest(ceil(source_size / {shard_words}), 1)::BIGINT AS shard
  FROM facts f JOIN targets t USING (unnamed, name)
), cells AS (
  SELECT source_no, shard, sum(size)::BIGINT AS cell_size, coalesce(any_value(seats), 0) AS seats
  FROM placed LEFT JOIN quotas USING (source_no) GROUP BY ALL
), cell_seats AS (
  SELECT c.source_no, shard, row_number() OVER (PARTITION BY c.source_no ORDER BY cell_size::DOUBLE / (2 * k + 1) DESC, shard) AS place, seats
  FROM cells c, unnest(range(seats + 1)) AS u(k) WHERE cell_size > 0
), cell_quotas AS (
  SELECT source_no, shard, cell_size, coalesce(quota, 0) AS quota FROM cells LEFT JOIN (
    SELECT source_no, shard, count(*) AS quota FROM cell_seats WHERE place <= seats GROUP BY ALL) USING (source_no, shard)
), asked AS (
  SELECT *, least(quota * {block}, {limit} * cell_size) AS asked FROM cell_quotas WHERE cell_size > 0
), blocks AS (
  SELECT source_no, shard, b, asked // cell_size AS passes, asked % cell_size AS rest, least({block}, cell_size - b * {block}) AS long,
         sum(least({block}, cell_size - b * {block})) OVER (PARTITION BY source_no, shard
           ORDER BY b = (cell_size - 1) // {block}, md5('42|' || source_no || '|' || shard || '|' || b) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM asked, unnest(range((cell_size - 1) // {block} + 1)) AS u(b)
), taken_blocks AS (
  SELECT source_no, shard, passes, b * {block} AS first, b * {block} + greatest(least(long, rest - coalesce(before, 0)), 0) AS stop FROM blocks
), lines AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source_no, shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         row_number() OVER () AS row_no
  FROM placed
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       coalesce(any_value(passes) * any_value(size) + sum(greatest(least(stop, start + size) - greatest(first, start), 0)), 0)::BIGINT AS taken
FROM lines LEFT JOIN taken_blocks USING (source_no, shard) GROUP BY row_no
"""


SQL = sql()
