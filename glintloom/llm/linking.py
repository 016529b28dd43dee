"""Connected components over candidate buckets, without all pairs of a bucket.

A bucket is a set of nodes that share a key. Two nodes are linked if they share a
bucket and pass a test. Components over all links are found in two passes:

1. Each member is tested against one member of its bucket, drawn by a hash of bucket
   and node, so that each bucket draws differently. The components of these links
   already hold most of every dense group.
2. Only pairs of a bucket that are still in different components can matter, and pairs
   with the drawn member are settled. Buckets whose other members lie in one component
   drop out whole, whatever the drawn member's is. In those that are left a member
   outside the component of most is tested against the members of other components.

Every pair of a bucket is either inside one component after pass 1 or tested in pass 1
or 2, so the components are exactly those of all links, while pairs inside a dense
group are never listed.

What grows: keys have a fixed number of bits, so the strangers of a bucket grow with the
number of nodes, and each is tested once against the drawn member. Where they are many,
finer keys (refine) cut the bucket before strangers are tested against each other: the
pairs of pass 2 grow as nodes x nodes / 2 ** (bits of key and finer key).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.llm.common import BROADCAST_CELLS, join_sized, materialise

#: Rounds after which components() gives up; the number needed grows with the logarithm of the longest chain.
MAX_ROUNDS = 60
#: Tests that a bucket may take in pass 2: where it would take more it is cut into finer ones, if there is a rule for it.
MOST_TESTS = 64 * 64


#: What a test of two nodes reads: their columns by name.
Fields = dict[str, Column]


def within(max_bits: int) -> Callable[[Fields, Fields], Column]:
    """The test whether two signatures differ in at most max_bits bits."""
    return lambda a, b: F.bit_count(a["sig"].bitwiseXOR(b["sig"])) <= max_bits


def components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, component), component being the smallest node reachable.

    edges has columns a and b of one type, a <> b; nodes without edges do not appear.
    Alternates large-star and small-star steps until no edge changes; every round is
    written to the shared folder. Minima are taken before rows are moved. The minima of
    few nodes are broadcast; those of many are joined after a shuffle, where adaptive
    execution splits the partition of a node with very many neighbours.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark, n = None, now.count()
    for _ in range(MAX_ROUNDS):
        small_side = F.broadcast if 2 * n <= BROADCAST_CELLS else (lambda df: df)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(small_side(low), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_side(low2), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialise(small)
        # a forest of stars on smallest nodes stays as it is: then each node has one edge and no centre is a leaf
        seen = now.agg(F.count("*").alias("n"), F.count_distinct("a").alias("leaves"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        n = seen["n"]
        if mark == seen or not n:
            break
        if n == seen["leaves"] and now.join(small_side(now.select(F.col("b").alias("a")).distinct()), "a", "left_semi").isEmpty():
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def spread(nodes: DataFrame) -> DataFrame:
    """nodes dealt evenly to as many tasks as a shuffle has, before each becomes many rows."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def bucket_components(
    members: DataFrame,
    near: Callable[[Fields, Fields], Column],
    confirm: Callable[[DataFrame], DataFrame] | None = None,
    refine: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Components of the nodes of members (key, id, sig and others): (node, component) for nodes with links.

    Two nodes of a bucket may be linked if near holds for their columns other than key
    and id; it is symmetric, and a conjunction of tests of one column each. confirm takes
    distinct pairs (a, b) of ids and returns those that are linked; without it, all of these are.
    Buckets of two, most of which two strangers share by chance, are settled while
    buckets are counted and leave no row unless they may be linked. Members are moved by
    key once; counting and joining read the same shuffle. Members may repeat, but not
    once for each row of a hot group. A node has many keys, so the key of a large group
    holds a small part of all members.

    refine(key, sig) gives finer keys, at least one of which any two near members of a
    bucket share. They take the place of the key where pass 2 would take more than
    MOST_TESTS tests in its bucket, so that strangers in a crowded bucket are not
    compared with each other.
    """
    confirm = confirm or (lambda pairs: pairs)
    fields = [c for c in members.columns if c not in ("key", "id")]
    named = lambda suffix: {c: F.col(f"{c}_{suffix}") for c in fields}
    renamed = lambda suffix: [F.col(c).alias(f"{c}_{suffix}") for c in fields]
    own = {c: F.col(c) for c in fields}
    mix = F.xxhash64("key")
    dealt = members.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    drawn = dealt.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mix)).alias("least"), F.max(F.col("id").bitwiseXOR(mix)).alias("most"), F.count("*").alias("n"), *[f(c).alias(f"{c}_{x}") for c in fields for f, x in ((F.min, "low"), (F.max, "high"))])
    drawn = drawn.where((F.col("least") != F.col("most")) & ((F.col("n") > 2) | near(named("low"), named("high")))).select("key", "least", "n")
    shared = dealt.join(drawn.hint("shuffle_hash"), "key").select("key", "id", *fields, F.col("least").bitwiseXOR(mix).alias("head"), "n")
    shared = materialise(shared.dropDuplicates(["key", "id"]))
    wide = shared.where("n > 2").select("key", "id", *fields, "head", "n")
    heads = wide.where("id = head").select("key", *renamed("head"))
    tested = wide.where("id <> head").join(heads, "key").where(near(own, named("head")))
    twos = shared.where("n = 2 AND id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    first = materialise(confirm(twos.unionByName(tested.select(F.col("id").alias("a"), F.col("head").alias("b"))).distinct()))
    groups = materialise(components(first))
    # pass 2: buckets of two are settled, and so are pairs with the drawn member
    wide = join_sized(wide.where("id <> head"), groups.withColumnRenamed("node", "id"), ["id"], "left", groups.count())
    wide = materialise(wide.select("key", "id", *fields, F.coalesce("component", "id").alias("component")))
    parts = wide.groupBy("key", "component").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("x")).where("kinds > 1")
    mixed = materialise(mixed.select("key", F.col("x.component").alias("main"), ((F.col("all") - F.col("x.m")) * F.col("all")).alias("tests")))
    odd = wide.join(mixed, "key").where("component <> main").select("key", F.col("id").alias("a"), *renamed("a"), F.col("component").alias("component_a"), "main", "tests")
    odd = materialise(odd)
    mates = wide.select("key", F.col("id").alias("b"), *renamed("b"), F.col("component").alias("component_b"))
    # of two odd members one order is enough
    new = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("main")) | (F.col("a") < F.col("b"))) & near(named("a"), named("b"))
    crowded = F.col("tests") > (MOST_TESTS if refine is not None else (1 << 63) - 1)
    more = odd.where(~crowded).join(mates, "key").where(new).select("a", "b")
    if refine is not None and not (cut := mixed.where(crowded).select("key")).isEmpty():
        finer = [t.withColumn("sub", F.explode(refine(F.col("key"), F.col(f"sig_{x}")))) for x, t in (("a", odd.where(crowded)), ("b", mates.join(cut, "key", "left_semi")))]
        more = more.unionByName(finer[0].join(finer[1], ["key", "sub"]).where(new).select("a", "b"))
    more = more.distinct()
    more = materialise(confirm(more))
    if more.isEmpty():
        return groups
    links = groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialise(components(links.unionByName(more)))
