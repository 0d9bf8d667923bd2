"""Links between records that share a key, however many share it, without pairing up what is connected already."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Each gives another order of the records, and with it another hub for every key.
ORDERS = (0, 0x2545F4914F6CDD1D)
#: Records of a key that are compared with each other, or with as many others, in one place.
BLOCK = 512


def _open(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """k, u and component c of the members of keys that the links leave unconnected."""
    comp = components(reduce(DataFrame.unionByName, links))
    known = members.join(comp.select(F.col("node").alias("u"), F.col("component").alias("__c")), "u", "left").select("k", "u", F.coalesce("__c", "u").alias("c"))
    known = common.materialize(known, "keys")
    apart = known.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("k")
    out = common.materialize(known.join(apart, "k", "left_semi"), "open-keys")
    common.drop(comp, known)
    return out


def _through_hubs(rest: DataFrame, marks: DataFrame, alike: Callable, verified: Callable) -> tuple[list[DataFrame], DataFrame]:
    """Links of the records of each key (``rest``: k, u) with its hubs, and k, u and component c of the keys that these leave unconnected."""
    ends = [marks.select(F.col("u").alias(u), F.col("mark").alias("m" + u)).hint("shuffle_hash") for u in ("u", "v")]
    found, rest, last = [], rest.withColumn("c", F.col("u")), []
    for order in ORDERS:
        hub = F.min(F.struct(F.col("u").bitwiseXOR(F.lit(order)).alias("x"), "c")).alias("h")
        hubs = rest.groupBy("k").agg(hub).select("k", F.col("h.x").bitwiseXOR(F.lit(order)).alias("v"), F.col("h.c").alias("cv"))
        star = common.materialize(rest.join(hubs, "k").where("c <> cv").select("u", "v").distinct(), "pairs")
        met = star.join(ends[0], "u").join(ends[1], "v").where(alike(F.col("mu"), F.col("mv")))
        found.append(common.materialize(verified(met.select("u", "v", "mu", "mv")), "links"))
        still = _open(rest.select("k", "u"), found)  # a key that is connected stays so
        common.drop(star, *last)
        rest, last = still, [still]
    return found, rest


def _every_pair(rest: DataFrame, marks: DataFrame, alike: Callable, verified: Callable) -> DataFrame:
    """Links between records of different components of a key (``rest``: k, u, c), paired up within a join."""
    sizes = rest.groupBy("k", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("k").agg(F.max(F.struct("n", "c")).alias("x")).select("k", F.col("x.c").alias("main"))
    own = rest.groupBy("u").agg(F.collect_list("k").alias("all"))
    sides = common.materialize(rest.join(main, "k").join(own, "u").join(marks, "u"), "open-keys")
    one, other = (sides.select("k", *(F.col(c).alias(c + u) for c in ("c", "all")), F.col("u").alias(u), F.col("mark").alias("m" + u), "main") for u in ("u", "v"))
    # All of a key but its greatest component, against all of it. Whatever key two records of different components share is open for both.
    once = (F.col("cu") != F.col("cv")) & ((F.col("cv") == F.col("main")) | (F.col("u") < F.col("v")))
    first = F.array_min(F.array_intersect("allu", "allv")) == F.col("k")
    pairs = one.where("cu <> main").join(other.drop("main"), "k").where(once & alike(F.col("mu"), F.col("mv")) & first)
    out = common.materialize(verified(pairs.select("u", "v", "mu", "mv")), "links")
    common.drop(sides)
    return out


def dealt(rest: DataFrame) -> DataFrame:
    """k, i, j, b, u, c and ``lower``: records of keys (``rest``: k, u, c) dealt to blocks b, once for each pair i <= j of blocks that theirs is one of.

    The greatest component of a key, which is connected, has blocks of its own, after the others'; these are not paired with each other. ``lower`` are
    the lesser keys of a record: two that share one of them meet there.
    """
    sizes = rest.groupBy("k", "c").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("k").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("x"))
    many = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    # A key of one block needs no second one for its greatest component: its pairs of equal components are left out where they are compared.
    one = F.col("n") <= BLOCK
    whole = whole.select("k", F.when(~one, F.col("x.c")).alias("main"), F.when(one, 1).otherwise(many(F.col("n") - F.col("x.n"))).alias("others"), F.when(one, 0).otherwise(many(F.col("x.n"))).alias("mains"))
    spread = lambda n: F.pmod(F.xxhash64("u"), n).cast("int")
    within = F.col("main").isNotNull() & (F.col("c") == F.col("main"))
    rows = rest.join(whole, "k").withColumn("b", F.when(within, F.col("others") + spread(F.greatest("mains", F.lit(1)))).otherwise(spread(F.col("others"))))
    last = F.when(within, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    rows = rows.select("k", "u", "c", "b", F.explode(F.sequence(F.lit(0), last)).alias("x"))
    own = rest.groupBy("u").agg(F.collect_list("k").alias("all"))
    lower = F.filter("all", lambda x: x < F.col("k")).alias("lower")
    return rows.join(own, "u").select("k", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "b", "u", "c", lower)


def _different(members: DataFrame) -> DataFrame:
    """k and n, its number of records, of one key (the least) of all that have the same records (``members``: k, u, each once), told by 128 bits.

    Records that share a key share the one that stays for it, so no pair is lost; similar records have most of their keys in common.
    """
    sets = members.groupBy("k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u")).alias("x"), F.bit_xor(F.xxhash64("u", F.lit(1))).alias("y"))
    return sets.groupBy("n", "x", "y").agg(F.min("k").alias("k")).select("k", "n")


def linked(keyed: DataFrame, prepare: Callable, alike: Callable[[Column, Column], Column], verified: Callable[[DataFrame], DataFrame] = lambda pairs: pairs.select("u", "v"), compared: Callable | None = None) -> DataFrame:
    """Links (u, v) that connect all pairs of records that share a key and that the check accepts.

    ``keyed``: k, u; repeated rows count once. ``prepare`` gets the records (u) that share a key with another
    and returns a table u, mark; ``alike`` tells from two marks whether a pair is a link, or may be one: ``verified`` gets such pairs (u, v, mu, mv: the marks)
    and returns the links among them.

    First each record is checked against a hub of each of its keys, and against another while the key isn't connected: that
    leaves little of a key of copies. Then every pair of a key that this has not connected is checked, whatever the size of the key: no
    candidate is given up. That is done within the join, so only links are ever written or sent, and at the least of the keys that a pair shares, so once.

    With ``compared`` pairs are never rows: the records are dealt to pairs of blocks (see ``dealt``), and ``compared`` gets them, each beside its mark, and returns
    links that connect what is alike within each pair of blocks. Only keys of more than ``BLOCK`` records have hubs then, and of keys with the same records one is worked on.
    """
    of_key = Window.partitionBy("k")  # rows are sent once
    shared = keyed.select("k", "u", F.min("u").over(of_key).alias("a"), F.max("u").over(of_key).alias("b")).where("a <> b")
    members = common.materialize(shared.select("k", "u").dropDuplicates(["k", "u"]), "keys")
    marks = prepare(members.select("u").distinct())
    if compared is None:
        found, rest = _through_hubs(members, marks, alike, verified)
        found.append(_every_pair(rest, marks, alike, verified))
        used = [rest]
    else:
        kinds = common.materialize(_different(members), "different-keys")
        own = members.join(kinds, "k")
        found, used, rest = [], [kinds], own.select("k", "u", F.col("u").alias("c"))
        hot = F.col("n") > BLOCK
        if not kinds.where(hot).isEmpty():
            found, still = _through_hubs(own.where(hot).select("k", "u"), marks, alike, verified)
            rest = own.where(~hot).select("k", "u", F.col("u").alias("c")).unionByName(still.select("k", "u", "c"))
            used.append(still)
        found.append(common.materialize(compared(dealt(rest).join(marks.hint("shuffle_hash"), "u")), "links"))
    out = common.materialize(reduce(DataFrame.unionByName, found), "links")
    common.drop(members, *used, *found)
    return out
