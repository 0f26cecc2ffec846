"""N-gram Jaccard join: exact, by partition of the universe.

Two sets with Jaccard similarity ``t`` or more differ in at most ``2 n (1 - t) / (1 + t)`` elements, ``n``
being the size of the larger. Elements are hashed into segments, whose number depends on the set's size
band. If the larger set picks segments worth more than that many differences, at least one of them must
agree: a segment picked exactly stands for one difference, one picked with its one-deletion neighbourhood
for two, as two sets that differ in one element there have a neighbour in common. Every set picks what is
cheapest, by how many sets have the same subsets; subsets that no other set has cost nothing.

Sets that meet are first compared with one of each meeting, another one in each of two rounds, which links most
near copies to a group. Only meetings with several groups left are compared further, and only across groups.
So links that can join two groups are all verified, and no meeting is expanded into all its pairs. Every set
has a bitmap in which each element turns a bit over; two sets differ in at least as many elements as their
bitmaps in bits. Pairs that differ too much by this are out before any set is looked up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.llm.components import components
from likeness.llm.keys import counted, group_starts, places, shared_keys, told_keys
from likeness.llm.packs import Pack, bucketed, chosen_documents, mix, pack_documents, rest_of, unpacked, with_rest
from likeness.llm.words import LOWER, WordSpans
from likeness.session import stored

#: Bands: upper size (exclusive), number of segments (0: one for each element), one-deletion neighbourhoods.
BANDS = [(64, 0, False), (96, 24, True), (192, 48, True), (384, 192, False)]
BANDS += [(768 << i, 256 << i, False) for i in range(32)]
UPPER = np.array([b[0] for b in BANDS])
#: 64-bit words of a bitmap, and rounds in which meetings are compared with one set each.
WORDS = 16
ROUNDS = 2
#: Members of a block, about; two blocks are compared at a time.
BLOCK = 500


def shingle_sets(pack: Pack, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per pack the sets of word runs, one after the other and each in order, and where each begins."""
    spans = WordSpans(pack, pack.data.translate(LOWER))
    hashes = spans.hashes()
    n_words = np.diff(spans.starts)
    n_runs = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    doc = np.repeat(np.arange(len(n_words)), n_runs)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + spans.starts[doc]
    length = np.minimum(n_words, size)[doc]
    runs = length.astype("u8")
    padded = np.append(hashes, np.zeros(size, "u8"))
    for i in range(size):
        runs = np.where(i < length, mix(runs * np.uint64(0x9E3779B97F4A7C15) + padded[first + i]), runs)
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    return runs[new], np.searchsorted(doc[new], np.arange(len(n_words) + 1))


def most_differences(n: np.ndarray, percent: int) -> np.ndarray:
    return 2 * n * (100 - percent) // (100 + percent)


class Segments:
    """The segments of some sets in one band: ``exact`` keys by segment, ``less`` keys by element, sizes, owner."""

    def __init__(self, sets: np.ndarray, starts: np.ndarray, docs: np.ndarray, band: int, seed: int):
        _, m, deletions = BANDS[band]
        sizes = starts[docs + 1] - starts[docs]
        owner = np.repeat(docs, sizes)
        spot = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
        values = mix(sets[spot] + np.uint64((band + 1) * 0xA0761D6478BD642F + seed * 0xE7037ED1A0B428DB & (1 << 64) - 1))
        if m:
            segment = ((values >> np.uint64(32)) % np.uint64(m)).astype("i8")
            order = np.argsort(owner * m + segment, kind="stable")
            values, owner, segment = values[order], owner[order], segment[order]
            first = group_starts(owner * m + segment)
            total = np.add.reduceat(values, first) if len(first) else values
            salt = segment.astype("u8") + np.uint64(1)
        else:
            first, total, salt = np.arange(len(values)), values, np.zeros(len(values), "u8")
        self.owner, self.first = owner[first], first
        self.size = np.diff(np.append(first, len(values)))
        self.exact = mix(total * np.uint64(0x8EBC6AF09C88C6E3) + salt[first])
        self.deletions = deletions
        if deletions:
            rest = np.repeat(total, self.size) - values
            self.less = mix(rest * np.uint64(0x8EBC6AF09C88C6E3) + salt)
            self.worth = np.where(self.size > 1, 2, 1)
        else:
            self.worth = np.ones(len(first), "i8")

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys with their owners; what is left of a segment of one element is not a key."""
        if not self.deletions:
            return self.exact, self.owner
        several = np.repeat(self.size > 1, self.size)
        return np.append(self.exact, self.less[several]), np.append(self.owner, np.repeat(self.owner, self.size)[several])


def views(sets: np.ndarray, starts: np.ndarray, docs: np.ndarray, percent: int, seed: int):
    """The bands in which the given documents take part, with their segments and whether the band is theirs."""
    n = starts[docs + 1] - starts[docs]
    own = np.searchsorted(UPPER, n, "right")
    near = n * 100 >= UPPER[own] * percent
    for band in np.unique(np.append(own, own[near] + 1)).tolist():
        mine = (own == band) | (near & (own + 1 == band))
        yield Segments(sets, starts, docs[mine], band, seed), own == band


def _members(pack: Pack, row: dict, starts: np.ndarray) -> np.ndarray:
    """The pack's documents that take part: with a set, and the first of all with this set."""
    out = np.diff(starts) > 0
    again = row["again"].as_py() if "again" in row else None
    out[np.array(again or [], "i8")] = False
    return np.flatnonzero(out)


def _sets_of(size: int, percent: int, seed: int):
    """A row for each document: its place, size, fingerprint, and whether its band serves it too few segments."""

    def run(batches):
        for pack, _ in unpacked(batches):
            sets, starts = shingle_sets(pack, size)
            n = np.diff(starts)
            one, two = (np.append(np.cumsum(mix(sets + np.uint64(c))), np.uint64(0)) for c in (1, 2))
            sums = [np.where(n > 0, t[starts[1:] - 1] - np.where(starts[:-1] > 0, t[starts[:-1] - 1], np.uint64(0)), np.uint64(0)) for t in (one, two)]
            short = np.zeros(len(n), bool)
            for part, own in views(sets, starts, np.flatnonzero(n > 0), percent, seed):
                docs = np.flatnonzero(n > 0)[own]
                worth = np.bincount(part.owner, part.worth, len(n))[docs]
                short[docs] = worth <= most_differences(n[docs], percent)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((pack.number << 16) + np.arange(len(n))),
                    pa.array(np.full(len(n), pack.number)),
                    pa.array(pack.ids),
                    pa.array(n.astype("i8")),
                    pa.array(sums[0].view("i8")),
                    pa.array(sums[1].view("i8")),
                    pa.array(short),
                ],
                names=["ref", "pack", "doc_id", "n_shingles", "print1", "print2", "short"],
            )

    return run, "ref long, pack long, doc_id long, n_shingles long, print1 long, print2 long, short boolean"


def _emit(size: int, percent: int, seed: int):
    def emit(pack: Pack, row: dict):
        sets, starts = shingle_sets(pack, size)
        found = [part.keys() for part, _ in views(sets, starts, _members(pack, row, starts), percent, seed)]
        if not found:
            return counted(np.zeros(0, "u8"), np.zeros(0, "i8"))
        keys, docs, _ = counted(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return keys, docs, docs

    return emit


def chosen(cost_one: np.ndarray, cost_two: np.ndarray, worth: np.ndarray, owner: np.ndarray, need: np.ndarray) -> np.ndarray:
    """How far each segment is picked (0 not, 1 exactly, 2 with deletions): the cheapest that meet ``need`` by owner."""
    second = cost_two - cost_one
    dear = second < cost_one  # then the first step alone is no bargain
    step_one = np.where(dear & (worth > 1), cost_two / 2, cost_one)
    step_two = np.where(dear, cost_two / 2, second)
    both = np.flatnonzero(worth > 1)
    who = np.append(owner, owner[both])
    segment = np.append(np.arange(len(owner)), both)
    cost = np.append(step_one, step_two[both])
    turn = np.append(np.zeros(len(owner), "i1"), np.ones(len(both), "i1"))
    order = np.lexsort((turn, segment, cost, who))
    first = group_starts(who[order])
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    taken = order[place < need[who[order]]]
    return np.bincount(segment[taken], minlength=len(owner))


def bitmaps(sets: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each of the given sets."""
    out = np.zeros((len(docs), WORDS), "i8")
    spots = (mix(sets + np.uint64(WORDS)) >> np.uint64(32)) % np.uint64(64 * WORDS)
    for i, d in enumerate(docs.tolist()):
        odd = np.bincount(spots[starts[d] : starts[d + 1]].astype("i8"), minlength=64 * WORDS) & 1
        out[i] = np.packbits(odd.astype("u1")).view("i8")
    return out


def _meetings(size: int, percent: int, seed: int):
    """Rows of two kinds: keys of sets that may have a partner, and these sets themselves."""
    schema = "key long, ref long, n long, probe boolean, shingles binary, bits array<long>"

    def batch(keys, refs, n, probe, shingles, bits=None):
        count = len(refs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys.view("i8")) if keys is not None else pa.nulls(count, pa.int64()),
                pa.array(refs),
                pa.array(n),
                pa.array(probe) if probe is not None else pa.nulls(count, pa.bool_()),
                pa.array(shingles, pa.binary()) if shingles is not None else pa.nulls(count, pa.binary()),
                pa.array(list(bits), pa.list_(pa.int64())) if bits is not None else pa.nulls(count, pa.list_(pa.int64())),
            ],
            names=["key", "ref", "n", "probe", "shingles", "bits"],
        )

    def run(batches):
        for pack, row in unpacked(batches):
            shared, docs_of, _ = told_keys(row["replies"])
            if not len(shared):
                continue
            sets, starts = shingle_sets(pack, size)
            n = np.diff(starts)
            docs = _members(pack, row, starts)
            active = np.zeros(len(n), bool)
            found = []
            for part, own in views(sets, starts, docs, percent, seed):
                hit, at = places(shared, part.exact)
                others = np.where(hit, docs_of[at] - 1, 0) if len(docs_of) else np.zeros(len(hit), "i8")
                agree = np.bincount(part.owner, hit, len(n))
                there = np.bincount(part.owner, minlength=len(n))
                # A partner differs in so few elements that this many segments at least must be the same.
                active |= (there > 0) & (agree >= np.maximum(1 - part.deletions, there - n * (100 - percent) // percent))
                cost_one, cost_two = others, others
                if part.deletions:
                    hit_less, at_less = places(shared, part.less)
                    more = np.where(hit_less, docs_of[at_less] - 1, 0)
                    cost_two = others + np.add.reduceat(more, part.first) if len(part.first) else others
                mine = np.zeros(len(n), bool)
                mine[docs[own]] = True
                need = np.where(mine, most_differences(n, percent) + 1, 0)
                pick = chosen(cost_one, cost_two, part.worth, part.owner, need)
                found.append((part.exact[hit], part.owner[hit], pick[hit] > 0))
                if part.deletions:
                    hit_less &= np.repeat(part.size > 1, part.size)
                    owner = np.repeat(part.owner, part.size)
                    found.append((part.less[hit_less], owner[hit_less], np.repeat(pick > 1, part.size)[hit_less]))
            if not found:
                continue
            keys, owner, probe = (np.concatenate([f[i] for f in found]) for i in range(3))
            kept = active[owner]
            keys, owner, probe = keys[kept], owner[kept], probe[kept]
            if not len(keys):
                continue
            ref = (pack.number << 16) + owner
            yield batch(keys, ref, n[owner].astype("i8"), probe, None)
            members = np.unique(owner)
            blobs = [sets[a:b].tobytes() for a, b in zip(starts[members].tolist(), starts[members + 1].tolist())]
            yield batch(None, (pack.number << 16) + members, n[members].astype("i8"), None, blobs, bitmaps(sets, starts, members))

    return run, schema


@F.pandas_udf(T.LongType())
def _common(one: pd.Series, two: pd.Series) -> pd.Series:
    count = [len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True)) for a, b in zip(one, two)]
    return pd.Series(count, dtype="int64")


def fitting(n1: Column, n2: Column, percent: int) -> Column:
    """Sizes at which the threshold can be met."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def alike(one: str, two: str, percent: int) -> Column:
    """Whether the bitmaps allow for the threshold."""
    apart = sum(F.bit_count(F.col(f"bits{one}")[i].bitwiseXOR(F.col(f"bits{two}")[i])) for i in range(WORDS))
    return apart * (100 + percent) <= (F.col(f"n{one}") + F.col(f"n{two}")) * (100 - percent)


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps leave."""
    side = lambda name: sets.select(F.col("ref").alias(name), F.col("n").alias(f"n{name}"), F.col("bits").alias(f"bits{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(alike("a", "b", percent)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold."""
    side = lambda name: sets.select(F.col("ref").alias(name), F.col("n").alias(f"n_{name}"), F.col("shingles").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), _common("set_a", "set_b").alias("common"))
    return common.filter(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent).select("a", "b")


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different groups that some meeting holds and that sizes and bitmaps leave.

    Meetings that share members often hold the same pairs many times. Where the pairs of all members of such
    meetings are no more than the pairs of each of them, the members are compared as one team; elsewhere each
    meeting is a team. The members of a team are dealt into blocks, and each two blocks are compared on their own.
    """
    several = placed.groupBy("meeting").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("ref").alias("head"), F.count("*").alias("met"))
    several = stored(several.filter("low < high").select("meeting", "head", "met"), "several")
    at = stored(placed.join(several, "meeting"), "open")
    teams = stored(components(at.select(F.col("head").alias("a"), F.col("ref").alias("b"))).select(F.col("node").alias("ref"), F.col("root").alias("team")), "teams")
    at = at.join(teams, "ref")
    pairs = at.groupBy("team").agg(F.sum("met").alias("pairs")).join(teams.groupBy("team").agg(F.count("*").alias("size")), "team")
    costs = stored(pairs.select("team", "size", (F.col("size") * F.col("size") <= F.col("pairs")).alias("joint")), "costs")
    at = stored(at.join(costs, "team"), "in-teams")
    # Members of one team meet in many places; one row of each does.
    joint = at.filter("joint").groupBy("team", "ref").agg(*[F.first(c).alias(c) for c in ("n", "root", "size")])
    single = at.filter("not joint").select(F.col("meeting").alias("team"), "ref", "n", "root", F.col("met").alias("size"), "probe")
    # Both sides are read from one copy.
    members = stored(joint.withColumn("probe", F.lit(True)).unionByName(single), "team-members").join(sets.select("ref", "bits"), "ref")
    members = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("ref", F.lit(ROUNDS)), "blocks"))
    side = lambda name, one, two: members.select("team", one.alias("i"), two.alias("j"), *[F.col(c).alias(f"{c}{name}") for c in ("ref", "n", "probe", "root", "bits")])
    left = side("1", F.col("block"), F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = side("2", F.explode(F.sequence(F.lit(0).cast("long"), "block")), F.col("block"))
    # Little data, much comparing: partitions that are not put together again.
    keys = (int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "team", "i", "j")
    left, right = left.repartition(*keys), right.repartition(*keys)
    fit = fitting(F.col("n1"), F.col("n2"), percent) & (F.col("probe1") | F.col("probe2"))
    other = (F.col("root1") != F.col("root2")) & ((F.col("i") < F.col("j")) | (F.col("ref1") < F.col("ref2")))
    met = left.join(right, ["team", "i", "j"]).filter(other & fit & alike("1", "2", percent))
    return met.select(F.least("ref1", "ref2").alias("a"), F.greatest("ref1", "ref2").alias("b")).distinct()


def _grouped(packs: DataFrame, size: int, percent: int) -> DataFrame:
    """Each document of the packs with the root of its group: ref, pack, doc_id, n_shingles, root."""
    if not 75 <= percent <= 100:
        raise ValueError("the bands are laid out for 75 to 100 percent")
    for seed in range(8):
        run, schema = _sets_of(size, percent, seed)
        facts = stored(packs.mapInArrow(run, schema), "sets")
        # Chance may leave a set too few segments; another seed serves it. Hardly ever more than one is needed.
        if facts.filter("short").isEmpty():
            break
    else:
        raise RuntimeError("no partition of the universe serves all sets")

    prints = ["n_shingles", "print1", "print2"]
    firsts = facts.filter("n_shingles > 0").groupBy(*prints).agg(F.min("ref").alias("rep"), F.count("*").alias("copies"))
    repeated = facts.join(stored(firsts.filter("copies > 1").drop("copies"), "firsts"), prints).select("ref", "rep", "pack")
    again = repeated.filter("ref != rep").groupBy("pack").agg(F.collect_list(F.col("ref").bitwiseAND(65535)).alias("again"))
    told = stored(again, "again")
    sources = packs.join(told, "pack", "left")

    shared = shared_keys(sources, _emit(size, percent, seed), 1 / 8)
    gathered = shared.groupBy("pack").agg(F.collect_list(F.struct("keys", "docs", "occurrences")).alias("replies"))
    run, schema = _meetings(size, percent, seed)
    rows = stored(sources.join(gathered, "pack").mapInArrow(run, schema), "meetings")
    entries = rows.filter("key is not null").select("key", "ref", "n", "probe")
    # Pairs look up sets in every round: only the pairs move, not the sets.
    sets = bucketed(rows.filter("key is null").select("ref", "n", "shingles", "bits"), "sets", "ref")

    # A meeting's members are told by two sums over them, so meetings of the same sets are one.
    who = [F.sum(F.xxhash64("ref", F.lit(i)).bitwiseAND((1 << 40) - 1)).alias(f"who{i}") for i in (1, 2)]
    groups = entries.groupBy("key").agg(*who, F.count("*").alias("size"), F.max("probe").alias("any"))
    met = entries.join(groups.filter("size > 1 and any"), "key")
    meeting = ["meeting"]
    met = met.withColumn("meeting", F.xxhash64("who1", "who2", "size"))
    members = met.groupBy(*meeting, "ref", "n").agg(F.max("probe").alias("probe")).withColumn("root", F.col("ref"))
    members, groups_of = stored(members, "members"), None
    fit = lambda one, two: fitting(F.col(f"n{one}"), F.col(f"n{two}"), percent) & (F.col(f"probe{one}") | F.col(f"probe{two}"))
    side = lambda df, name: df.select(*meeting, *[F.col(c).alias(f"{c}{name}") for c in ("ref", "n", "probe", "root")])

    def merged(links: DataFrame, so_far: DataFrame | None) -> DataFrame:
        """(node, root) of all sets that are linked, after further links between groups."""
        step = components(links)
        if so_far is None:
            return step
        moved = so_far.join(step.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
        moved = moved.select("node", F.coalesce("above", "root").alias("root"))
        return stored(moved.unionByName(step.join(so_far, "node", "left_anti")), "groups")

    def placed() -> DataFrame:
        """The members of all meetings with the groups found so far."""
        at = members.drop("root").join(groups_of.withColumnRenamed("node", "ref"), "ref", "left")
        return at.withColumn("root", F.coalesce("root", "ref"))

    for turn in range(ROUNDS):
        # At first meetings of about the same sets have the same centre, so there are few pairs. Later each has
        # its own, so a set that is still apart is compared with as many centres as it has meetings.
        order = F.xxhash64("ref", "meeting", F.lit(turn)) if turn else F.lit(0)
        at = stored(placed(), "placed") if turn else members
        centres = at.groupBy(*meeting).agg(F.min(F.struct(order.alias("o"), "ref", "n", "probe", "root")).alias("c"))
        centres = centres.select(*meeting, *[F.col(f"c.{c}").alias(f"{c}2") for c in ("ref", "n", "probe", "root")])
        stars = side(at, "1").join(centres, meeting).filter((F.col("root1") != F.col("root2")) & fit("1", "2"))
        pairs = stars.groupBy(F.col("ref1").alias("a"), F.col("ref2").alias("b")).agg(F.first("root1").alias("root1"), F.first("root2").alias("root2"))
        pairs = stored(pairs, "pairs")
        near = verified(possible(pairs.select("a", "b"), sets, percent), sets, percent).join(pairs, ["a", "b"])
        links = stored(near.select(F.col("root1").alias("a"), F.col("root2").alias("b")).distinct(), "near")
        groups_of = merged(links, groups_of)
    last = stored(placed(), "placed")
    rest = verified(_across(last, sets, percent), sets, percent)
    copies = repeated.filter("ref != rep").select(F.col("rep").alias("a"), F.col("ref").alias("b"))
    # Groups found so far stand for their links.
    so_far = groups_of.select(F.col("root").alias("a"), F.col("node").alias("b"))
    whole = components(so_far.unionByName(rest).unionByName(copies))

    root = F.coalesce("root", "ref").alias("root")
    return facts.join(whole, facts.ref == whole.node, "left").select("ref", "pack", "doc_id", "n_shingles", root)


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their word runs: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A document's set holds its
    different runs of ``size`` words; one with fewer words has them all as one run; one without words has an
    empty set and no link. ``percent`` is the threshold, from 75 to 100. ``component_id`` is the smallest
    doc_id reachable by links, or the document's own. Every row gets a result: null texts have empty sets,
    rows with equal ids are judged each by its text. Rows without an id are left out. Other columns than
    ``doc_id`` and ``text`` are ignored. An empty table gives an empty result.
    """
    named = _grouped(pack_documents(docs), size, percent)
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(ids, "root").select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The documents of which each group keeps one, that of the smallest id (of equal ids, one), as they are.

    Groups, nulls and the rest as for ``jaccard_groups``; documents with an empty set all stay. ``docs`` may
    have further columns, which are handed on.
    """
    packs = pack_documents(docs.withColumn("_rest", rest_of(docs)), "_rest")
    named = stored(_grouped(packs, size, percent), "grouped")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "ref", "pack")).alias("first")).select("first.*")
    return with_rest(chosen_documents(packs, first.select("pack", F.col("ref").bitwiseAND(65535).alias("idx"))), docs)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
