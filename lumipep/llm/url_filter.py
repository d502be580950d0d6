"""URL filters by a cascade of Bloom filters.

The keys of a rule list are strings host + path, such as `net/de/`. A URL's candidate keys are the endings of
its host (whole labels) joined to beginnings of its path, of the lengths that occur in the list. Level 1 of a
cascade encodes the listed keys; level 2 the candidate keys of the corpus that level 1 wrongly passes; level 3
the listed keys that level 2 wrongly passes, and so on until no error is left. For each key of the corpus the
first level that does not hold it then tells exactly whether it is listed, with no join.

Each level is built by the executors: they set bits and OR the words; the driver gets the words of one
bitmap, whose size is checked against MAX_BITMAP_BYTES before.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant, lower_ascii, stage, table

MAX_BITMAP_BYTES = 64 << 20
#: Bits a key and hash functions: level 1, later levels.
FIRST_LEVEL, LATER_LEVELS = (10, 5), (4, 3)

#: The rules of op1: (key, verdict).
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to '?', '#' or the end."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return lower_ascii(host), path


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every key that a rule fitting this URL could have, longest first. labels: most host labels in a rule."""
    names = F.split(host, r"\.", -1)
    n = F.size(names)
    tails = F.transform(F.sequence(F.greatest(n - labels, F.lit(0)), n - 1), lambda i: F.array_join(F.slice(names, i + 1, n - i), "."))
    fits = F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]), lambda x: x <= F.length(path))
    keys = F.flatten(F.transform(tails, lambda t: F.transform(fits, lambda x: F.concat(t, F.substring(path, F.lit(1), x)))))
    return F.transform(F.reverse(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k), k.alias("k"))))), lambda s: s["k"])


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(level)), F.xxhash64(key, F.lit(-level))
    return [F.pmod(F.shiftright(a, 1) + F.shiftright(b, 2).bitwiseOR(F.lit(1)) * F.lit(i) % F.lit(bits), F.lit(bits)) for i in range(hashes)]


@dataclass
class Level:
    bits: int
    hashes: int
    words: str = ""

    def holds(self, key: Column, level: int) -> Column:
        words, out = constant(self.words, "array<bigint>"), F.lit(True)
        for p in _positions(key, level, self.bits, self.hashes):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            # getbit reads one bit of the word
            out = out & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
        return out


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Exact for every listed key and every key of the corpus that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(self.levels[i - 1].holds(key, i), out).otherwise(F.lit(i % 2 == 0))
        return out


def _bloom(keys: DataFrame, level: int, shape: tuple[int, int]) -> Level | None:
    n = keys.count()
    if n == 0:
        return None
    per_key, hashes = shape
    bits = max(64, -(-n * per_key // 64) * 64)
    if bits // 8 > MAX_BITMAP_BYTES:
        raise ValueError(f"level {level} of the cascade needs {bits // 8} bytes; the bound is {MAX_BITMAP_BYTES}")
    p = F.explode(F.array(*_positions(F.col("key"), level, bits, hashes)))
    words = (
        keys.select(p.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v"))
    )
    out = [0] * (bits // 64)
    for r in words.collect():  # at most bits / 64 rows
        out[r["w"]] = r["v"]
    return Level(bits, hashes, json.dumps(out))


def build_cascade(listed: DataFrame, universe: DataFrame, first=FIRST_LEVEL, later=LATER_LEVELS) -> Cascade:
    """listed, universe: distinct strings in a column `key`. An empty list gives a cascade that holds nothing."""
    cascade = Cascade()
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    while True:
        level = len(cascade.levels) + 1
        made = _bloom(inside, level, first if level == 1 else later)
        if made is None:
            return cascade
        cascade.levels.append(made)
        # What this level wrongly passes is what the next one encodes.
        inside, outside = outside.filter(made.holds(F.col("key"), level)), inside
        inside = stage(inside, "cascade")


def url_verdicts(
    pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", otherwise: str = "allow", first=FIRST_LEVEL, later=LATER_LEVELS
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, and judged_by ('rule' or 'cascade').

    rules: key (host + path), verdict ('block' or 'allow'). A rule fits its host and all subdomains, if the
    URL's path begins with the rule's path; the longest key wins. Without a fitting rule, rule is null and the
    verdict is that of a key that no cascade holds (`otherwise`). A null URL or one without '://' has an empty
    host and path. A key listed with both verdicts is an error of the list: block wins. Rows that repeat are
    each judged; no rules or no pages are fine.
    """
    rules = rules.select("key", "verdict").filter("key is not null").distinct()
    host, path = host_path(F.col(url))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    cut = F.instr("key", "/")
    rule_path = F.when(cut > 0, F.length("key") - cut + 1).otherwise(0)
    rule_host = F.when(cut > 0, F.substring(F.col("key"), F.lit(1), cut - 1)).otherwise(F.col("key"))
    shape = rules.agg(F.collect_set(rule_path).alias("lengths"), F.max(F.size(F.split(rule_host, r"\."))).alias("labels")).first()
    lengths, labels = [int(x) for x in shape["lengths"]], int(shape["labels"] or 1)
    keys = candidate_keys(F.col("host"), F.col("path"), labels, lengths) if lengths else F.expr("cast(array() as array<string>)")
    universe = stage(parts.select(F.explode(keys).alias("key")).distinct(), "universe")
    block = build_cascade(rules.filter("verdict = 'block'").select("key"), universe, first, later)
    allow = build_cascade(rules.filter("verdict = 'allow'").select("key"), universe, first, later)
    judged = F.transform(
        keys,
        lambda k: F.struct(k.alias("rule"), F.when(block.contains(k), "block").when(allow.contains(k), "allow").alias("verdict")),
    )
    hit = F.get(F.filter("_judged", lambda s: s["verdict"].isNotNull()), F.lit(0))
    return parts.withColumn("_judged", judged).withColumn("_hit", hit).select(
        id_col,
        "host",
        "path",
        F.col("_hit.rule").alias("rule"),
        F.coalesce("_hit.verdict", F.lit(otherwise)).alias("verdict"),
        F.when(F.col("_hit").isNull(), "cascade").otherwise("rule").alias("judged_by"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "key string, verdict string"))


SQL = {
    "op1_url_filter": r"""
WITH r(key, verdict) AS (VALUES """
    + ", ".join(f"('{k}', '{v}')" for k, v in RULES)
    + r"""),
rr AS (SELECT key, verdict, substr(key, 1, instr(key, '/') - 1) AS rh, substr(key, instr(key, '/')) AS rp FROM r),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT c.page_id, max_by(struct_pack(key := key, verdict := verdict), length(key)) AS hit FROM c JOIN rr
      ON (c.host = rh OR ends_with(c.host, '.' || rh)) AND starts_with(c.path, rp) GROUP BY c.page_id)
SELECT c.page_id, host, path, hit.key AS rule, coalesce(hit.verdict, 'allow') AS verdict,
       CASE WHEN hit IS NULL THEN 'cascade' ELSE 'rule' END AS judged_by
FROM c LEFT JOIN m ON m.page_id = c.page_id"""
}
QUERIES = {"op1_url_filter": op1_url_filter}
