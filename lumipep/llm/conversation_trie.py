"""The prefix trie of conversations, by binary search for the depth from which each conversation owns its nodes.

A node is a distinct sequence of first turns; its owner is the smallest conversation that starts so. A conversation
that owns a node owns all below it on its own way, so what it owns is a chain: its prefixes from a first depth on.
That depth is found by binary search, for all conversations at a time: each round joins the digest of every open
conversation's middle prefix to the table of prefixes and their smallest conversations. A last such join finds the
owner of the prefix above, on whose chain this one hangs.

Chains are the tree: a chain's own sums go up to the chains above it by pointer doubling (rounds: the logarithm of
the deepest nesting), then a running sum along each chain gives its nodes their subtrees.

Prefix digests are 128 bits, the XOR of two hashes of each (depth, SHA-256 of the turn), so that they are running
aggregates. Those, and all others along a conversation, are made over range partitions with what a partition passes
on to the next (`Runs`): one conversation may hold any share of the rows. A prefix that many conversations share is
broadcast with its owner; there are HOT_PARTS such prefixes at most, as each has more than that part of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .common import HOT_PARTS, HOT_ROWS, in_arrow, spread_join, stage, table

#: Ids that are joined to one string at a time.
IDS = 4096
PLACE = ["depth", "k1", "k2"]


class Runs:
    """Rows in the order of (key, order), as a written table of range partitions; running aggregates along each key."""

    def __init__(self, df: DataFrame, key: str, order: list):
        self.key = key
        self.rows = stage(df.orderBy(key, *order).withColumns({"_part": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}), "sorted")
        #: Of each partition that has rows: its number, first and last key.
        self.ends = [tuple(r) for r in self.rows.groupBy("_part").agg(F.min(key), F.max(key)).orderBy("_part").collect()]
        self.within = Window.partitionBy("_part", key).orderBy("_mid")

    def _beside(self, rows: DataFrame, values: list[tuple], kinds: str) -> DataFrame:
        """rows with the columns of `kinds`, one row of values for each partition."""
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(p, *v) for (p, _, _), v in zip(self.ends, values, strict=True)], f"_part int, {kinds}")), "_part")

    def along(self, rows: DataFrame, sums: dict[str, tuple[Column, Callable, Callable]]) -> DataFrame:
        """rows (self.rows, perhaps with further columns) with, for each name, the aggregate of a long column over the key's rows so far. sums: column, Spark aggregate, and how two results add up in Python; 0 has to be neutral."""
        if not self.ends:
            return rows.withColumns({name: F.lit(0).cast("long") for name in sums})
        last = self._beside(rows, [(z,) for _, _, z in self.ends], "_last long").filter(F.col(self.key) == F.col("_last"))
        tails = {r["_part"]: r for r in last.groupBy("_part").agg(*[agg(c).alias(name) for name, (c, agg, _) in sums.items()]).collect()}
        carried: list[tuple] = [(self.ends[0][1], *[0] * len(sums))]
        for (part, first, z), (_, following, _) in zip(self.ends, self.ends[1:], strict=False):
            of = lambda i, name, plus: plus(tails[part][name], carried[-1][i + 1]) if first == z else tails[part][name]  # noqa: B023, E731
            carried.append((following, *[of(i, name, plus) if following == z else 0 for i, (name, (_, _, plus)) in enumerate(sums.items())]))
        names = [f"_in{i}" for i in range(len(sums))]
        rows = self._beside(rows, carried, "_first long, " + ", ".join(f"{n} long" for n in names))
        both = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
        so_far = self.within.rowsBetween(Window.unboundedPreceding, 0)
        for n, (name, (c, agg, _)) in zip(names, sums.items(), strict=True):
            own = agg(c).over(so_far).cast("long")
            rows = rows.withColumn(name, F.when(F.col(self.key) == F.col("_first"), both[agg.__name__](own, F.col(n))).otherwise(own))
        return rows.drop("_first", *names)

    def with_last(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with a boolean: whether the row is its key's last."""
        if not self.ends:
            return rows.withColumn(name, F.lit(True))
        goes_on = [(z if z == following else None,) for (_, _, z), (_, following, _) in zip(self.ends, self.ends[1:], strict=False)] + [(None,)]
        last = F.lead(self.key).over(self.within).isNull() & ~F.col(self.key).eqNullSafe(F.col("_on"))
        return self._beside(rows, goes_on, "_on long").withColumn(name, last).drop("_on")


def _add(a: int, b: int) -> int:
    return a + b


def _xor(a: int, b: int) -> int:
    return a ^ b


def signed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, digest (of role and text; null is empty), bytes (of the text). Rows without a conversation are left out."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256))
    return turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("bytes"))


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv, at (1, 2 ... in the order of turn, null first; of equal ones by digest), digest, bytes. rows as `signed`."""
    runs = Runs(rows, "conv", [F.col("turn").asc_nulls_first(), "digest"])
    return runs.along(runs.rows, {"at": (F.lit(1), F.sum, _add)}).select("conv", "at", "digest", "bytes")


def prefixes(rows: DataFrame, order: list) -> DataFrame:
    """conv, depth, k1, k2 (digest of the conversation's first `depth` turns), bytes (of the last of them), last."""
    runs = Runs(rows, "conv", order)
    deep = runs.along(runs.rows, {"depth": (F.lit(1), F.sum, _add)})
    keyed = runs.along(deep, {"k1": (F.xxhash64("depth", "digest"), F.bit_xor, _xor), "k2": (F.xxhash64("digest", "depth", F.lit("second")), F.bit_xor, _xor)})
    return runs.with_last(keyed, "last").select("conv", *PLACE, "bytes", "last")


class Owners:
    """The smallest conversation of any conversation's prefix of any depth."""

    def __init__(self, places: DataFrame, nodes: DataFrame):
        """places: conv, PLACE; nodes: PLACE, owner, n_convs; both written."""
        total = places.count()
        n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        is_hot = F.col("n_convs") > max(HOT_ROWS, total // HOT_PARTS)
        hot = nodes.filter(is_hot).select(*PLACE, F.col("owner").alias("known"))
        # Both lie where the probes are sent, so a round moves probes only.
        self.places = places.select("conv", *PLACE).join(F.broadcast(hot), PLACE, "left").repartition(n, "conv", "depth").persist(StorageLevel.MEMORY_AND_DISK)
        self.minima = nodes.filter(~is_hot).select(*PLACE, "owner").repartition(n, *PLACE).persist(StorageLevel.MEMORY_AND_DISK)

    def of(self, probes: DataFrame) -> DataFrame:
        """probes: conv, depth, further columns; with `owner`."""
        at = probes.join(self.places, ["conv", "depth"])
        known = at.filter("known is not null").withColumn("owner", F.col("known"))
        return known.unionByName(at.filter("known is null").join(self.minima, PLACE)).drop("k1", "k2", "known")

    def close(self) -> None:
        self.places.unpersist()
        self.minima.unpersist()


def chains(places: DataFrame, nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv, n (turns), first (the depth from which conv owns its prefixes; n + 1: none), up (the owner of the prefix above `first`; null for the root's)."""
    owners = Owners(places, nodes)
    state = stage(sizes.select("conv", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi")), "search")
    longest = state.agg(F.max("hi")).first()[0] or 0
    for _ in range(longest.bit_length()):
        probes = state.filter("lo < hi").withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long"))
        owns = F.col("owner") == F.col("conv")
        halved = owners.of(probes).select("conv", "n", F.when(owns, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owns, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        state = stage(halved.unionByName(state.filter("lo >= hi")), "search")
    above = owners.of(state.filter("lo > 0").select("conv", "n", "lo", (F.col("lo") - 1).alias("depth"))).select("conv", "n", F.col("lo").alias("first"), F.col("owner").alias("up"))
    top = state.filter("lo = 0").select("conv", "n", F.col("lo").alias("first"), F.lit(None).cast("long").alias("up"))
    out = stage(above.unionByName(top), "chains")
    owners.close()
    return out


def chain_totals(own: DataFrame, names: list[str]) -> DataFrame:
    """own: conv, up (the chain above; null: none), sums. The sums of each chain and all chains below it, by pointer doubling: after k rounds those less than 2^k steps below."""
    state = stage(own, "totals")
    while not (below := state.filter("up is not null")).isEmpty():
        more = below.groupBy("up").agg(*[F.sum(c).alias(f"_{c}") for c in names]).withColumnRenamed("up", "conv")
        jumps = stage(spread_join(below.select("conv", "up"), state.select(F.col("conv").alias("up"), F.col("up").alias("next")), ["up"], ["conv"]).select("conv", "next"), "jumps")
        grown = state.drop("up").join(more, "conv", "left").join(jumps, "conv", "left")
        state = stage(grown.select("conv", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names]), "totals")
    return state.drop("up")


def id_digests(ends: DataFrame) -> DataFrame:
    """ends: owner, depth, conv. owner, depth, ends_sha256: of the decimal ids of a node in order, joined by commas. Ids are joined IDS at a time; the strings of a node that has several are hashed as a stream."""
    part = numbered(ends, ["owner", "depth", "conv"], "number").withColumn("chunk", F.shiftright("number", IDS.bit_length() - 1))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    pieces = stage(part.groupBy("owner", "depth", "chunk").agg(ids.alias("ids")), "ids")
    once = pieces.groupBy("owner", "depth").agg(F.count(F.lit(1)).alias("c"), F.min("chunk").alias("chunk"))
    single = pieces.join(once.filter("c = 1").select("owner", "depth"), ["owner", "depth"]).select("owner", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    several = pieces.join(once.filter("c > 1").select("owner", "depth"), ["owner", "depth"]).select("owner", "depth", "chunk", "ids")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([sha.hexdigest()])], ["owner", "depth", "ends_sha256"])
        for b in batches:
            for owner, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if (owner, depth) != node:
                    if node is not None:
                        yield row()
                    node, sha = (owner, depth), hashlib.sha256(ids.as_buffer())
                else:
                    sha.update(b",")
                    sha.update(ids.as_buffer())
        if node is not None:
            yield row()

    streamed = in_arrow(several.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "chunk"), hashed, "owner long, depth long, ends_sha256 string")
    return single.unionByName(streamed)


def trie_of(rows: DataFrame, order: list, ids: DataFrame) -> DataFrame:
    """The trie of conversations given as digests. rows: conv, the columns of `order`, digest, bytes; ids: conv, each once, those without turns too. Columns as `prefix_trie`."""
    turns = stage(prefixes(rows, order), "prefixes")
    zero = F.lit(0).cast("long")
    sizes = stage(ids.select("conv").join(turns.filter("last").select("conv", F.col("depth").alias("n")), "conv", "left").select("conv", F.coalesce("n", zero).alias("n")), "sizes")
    places = stage(turns.drop("last").unionByName(sizes.select("conv", *[zero.alias(c) for c in (*PLACE, "bytes")])), "places")
    nodes = stage(places.groupBy(*PLACE).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")), "nodes")
    chain = chains(places, nodes, sizes)
    owning, hanging = chain.filter("first <= n"), chain.filter("first <= n and first > 0")

    def facts(df: DataFrame, owner: str, depth: Column, **known: Column) -> DataFrame:
        """What df says of nodes; what it does not say is null."""
        names = ("n_convs", "bytes", "ends", "above", "kids")
        return df.select(F.col(owner).alias("owner"), depth.alias("depth"), *[known.get(c, F.lit(None)).cast("long").alias(c) for c in names])

    said = [
        facts(nodes, "owner", F.col("depth"), n_convs=F.col("n_convs"), bytes=F.col("bytes")),
        facts(owning, "conv", F.col("n"), ends=F.lit(1)),
        facts(hanging, "conv", F.col("first"), above=F.col("up")),
        facts(hanging, "up", F.col("first") - 1, kids=F.lit(1)),
    ]
    node = reduce(DataFrame.unionByName, said).groupBy("owner", "depth").agg(*[F.max(c).alias(c) for c in ("n_convs", "bytes", "ends", "above")], F.sum("kids").alias("kids"))
    children = F.coalesce("kids", zero) + F.when(F.col("ends").isNull(), 1).otherwise(0)
    node = node.withColumn("n_children", children).withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    node = stage(node.select("owner", "depth", "n_convs", "above", "n_children", "n_leaves", "saved_tokens"), "node")

    sums = ["n_leaves", "saved_tokens"]
    own = node.groupBy(F.col("owner").alias("conv")).agg(*[F.sum(c).alias(c) for c in sums])
    total = chain_totals(own.join(owning.select("conv", "up"), "conv").select("conv", "up", *sums), sums)
    below = hanging.join(total, "conv").select(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth"), *sums)
    alone = node.select("owner", "depth", *sums).unionByName(below).groupBy("owner", "depth").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    runs = Runs(alone, "owner", [F.desc("depth")])
    subtree = runs.along(runs.rows, {c: (F.col(f"_{c}"), F.sum, _add) for c in sums}).select("owner", "depth", *sums)

    ends = chain.select(F.when(F.col("first") <= F.col("n"), F.col("conv")).otherwise(F.col("up")).alias("owner"), F.col("n").alias("depth"), "conv")
    out = node.drop(*sums).join(subtree, ["owner", "depth"]).join(id_digests(ends), ["owner", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "owner"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", *sums, F.coalesce("ends_sha256", none).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by `turn`, null first, of equal ones by the digest of role and text; repeated rows are turns of
    their own. A null role or text is empty. Rows with a null conversation are left out. No rows, no nodes. Further
    columns are ignored; texts may be of any length, as only their digests move.
    """
    rows = stage(numbered_turns(signed(turns, conv, turn, role, text)), "turns")
    return trie_of(rows, ["at"], rows.select("conv").distinct())


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of op13's contract from numbered turns: conv, head (1: taken from the first of five), at, digest, bytes; and all ids.

    Conversation c takes the first h turns of conversation c - c % 5, then its own after its first h; h is crc32(c) % 9.
    """
    ids = stage(rows.select("conv").distinct(), "ids")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    five = F.sequence(F.col("base") - F.when(F.col("base") <= 0, 4).otherwise(0), F.col("base") + F.when(F.col("base") >= 0, 4).otherwise(0))
    heads = rows.filter("conv % 5 = 0 and at <= 8").withColumnRenamed("conv", "base").withColumn("conv", F.explode(five)).filter(F.col("at") <= h).join(ids, "conv", "left_semi")
    tails = rows.filter(F.col("at") > h)
    return heads.select("conv", F.lit(0).alias("tail"), "at", "digest", "bytes").unionByName(tails.select("conv", F.lit(1).alias("tail"), "at", "digest", "bytes")), ids


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(numbered_turns(signed(table(spark, sf_dir, "conversations"))), "turns")
    rows, ids = rebuilt(turns)
    return trie_of(rows, ["tail", "at"], ids)


#: crc32 of a string of ASCII characters, which DuckDB lacks: bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda y: y::UBIGINT)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END)), 4294967295::UBIGINT)"
SQL = {
    "op13_conversation_trie": r"""
WITH digested AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS bytes
                  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS place FROM digested),
ids AS (SELECT c, """
    + _CRC.format("c::VARCHAR")
    + r""" % 9 AS h FROM (SELECT DISTINCT c FROM own)),
whole AS (SELECT ids.c, 0 AS tail, place, g, bytes FROM ids JOIN own o ON o.c = ids.c - ids.c % 5 WHERE place <= h
          UNION ALL SELECT c, 1, place, g, bytes FROM ids JOIN own USING (c) WHERE place > h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY tail, place) AS d, g, bytes FROM whole),
pre AS (SELECT c, d, bytes, sha256(string_agg(g, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM turns UNION ALL SELECT c, 0, 0, '' FROM ids),
node AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM pre GROUP BY key, d),
size AS (SELECT c, max(d) AS d FROM pre GROUP BY c),
ending AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM pre JOIN size USING (c, d) GROUP BY key),
kids AS (SELECT a.key, count(*) AS n FROM node x JOIN pre a ON a.c = x.conv_id AND a.d = x.d - 1 GROUP BY a.key),
sub AS (SELECT a.key, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved_tokens, sum((k.n IS NULL)::BIGINT)::BIGINT AS n_leaves
        FROM node x LEFT JOIN kids k USING (key) JOIN pre a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.key)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node x JOIN sub USING (key) LEFT JOIN kids k USING (key) LEFT JOIN ending USING (key)
LEFT JOIN pre a ON a.c = x.conv_id AND a.d = x.d - 1 LEFT JOIN node p ON p.key = a.key"""
}
QUERIES = {"op13_conversation_trie": op13_conversation_trie}
