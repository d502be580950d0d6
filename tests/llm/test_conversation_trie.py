"""op13: nodes of the trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lumipep.llm import conversation_trie as ct

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(rows):
    """Conversation: its turns in order."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            out[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest(), (r, t)))
    return {c: [x[2] for x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted([(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(k)) for k, m in members.items()], key=str)


def result(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, owner string, depth int").repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    say = ["hello", "héllo", "a", "", None, "long " * 50]
    out = []
    for c in r.sample(range(1, 400), 90):
        for t in range(r.randrange(1, 13)):
            out.append((c, t, r.choice(["user", "assistant", None]) if t > 3 else "user", r.choice(say) if t > 2 else "hello"))
    out += [(500, t, "user", "hello") for t in range(300)]  # one long conversation
    out += [(501, t, "user", "hello") for t in range(250)] + [(502, 0, "user", "héllo")]
    out += [(503, None, "user", "first"), (503, 1, "user", "then"), (503, 1, "user", "then"), (503, None, None, None), (None, 1, "user", "nobody")]
    return out


def test_brute(spark, rows):
    assert result(ct.prefix_trie(frame(spark, rows))) == brute(turns_of(rows))


def test_rebuilt(spark, rows):
    turns = ct.stage(ct.numbered_turns(ct.signed(frame(spark, rows))), "turns")
    got, ids = ct.rebuilt(turns)
    assert result(ct.trie_of(got, ["tail", "at"], ids)) == brute(rebuilt(turns_of(rows)))


def test_small_parts(spark, rows, monkeypatch):
    """Ids hashed as a stream of pieces, prefixes that are broadcast, and a conversation over many partitions."""
    monkeypatch.setattr(ct, "IDS", 2)
    monkeypatch.setattr(ct, "HOT_ROWS", 3)
    more = [*rows, *[(600 + i, 0, "user", "hello") for i in range(40)]]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(ct.prefix_trie(frame(spark, more))) == brute(turns_of(more))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark, rows):
    assert ct.prefix_trie(frame(spark, rows).limit(0)).count() == 0
    assert ct.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    assert result(ct.prefix_trie(frame(spark, [(4, None, None, None)]))) == brute({4: [("", "")]})


def test_nested_chains(spark):
    """Each conversation leaves the one before it a turn later: chains hang on chains."""
    paths = [(c, t, "user", f"own {t}" if t < c else f"other {c}") for c in range(12) for t in range(c + 2)]
    assert result(ct.prefix_trie(frame(spark, paths))) == brute(turns_of(paths))
