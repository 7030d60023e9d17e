"""The trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from loglathe.llm import prefix_trie

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("turns", T.IntegerType()),
        T.StructField("depth", T.StringType()),
    ]
)


def _brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(c - rest, [])[:h] + ts[h:])
    members = {}
    for c, p in built.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def leaves(p):
        return sum(leaves(q) for q in children[p]) if p in children else 1

    def saved(p):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        return own + sum(saved(q) for q in children.get(p, []))

    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == p))
        out.append(
            (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), leaves(p), saved(p),
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def _order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def _rows(seed):
    rnd = random.Random(seed)
    rows = []
    first = [("user", "same start " * 5), ("assistant", "é" * 30)]
    for c in range(0, 300):
        kind = rnd.random()
        turns = [*first] if kind < 0.7 else []
        if kind < 0.3:
            turns = first * 6  # a third of the conversations are equal
        else:
            turns = turns + [(rnd.choice(["user", None, ""]), rnd.choice(["a", "b", None, "c" * 200])) for _ in range(rnd.randint(0, 14))]
        rows += [(c, k, r, t, 1, "x") for k, (r, t) in enumerate(turns)]
        if turns and rnd.random() < 0.1:
            rows.append((c, None, "system", "first", None, None))
    rows += [(None, 1, "user", "no id", 0, ""), (-7, 0, "u", "t", 0, ""), (-5, 0, "u", "s", 0, "")]
    rows += [(100_000, k, "user", "long %d" % (k // 2), 0, "") for k in range(90)]
    rows += [(100_001, k, "user", "long %d" % (k // 2), 0, "") for k in range(89)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "shard, splitter, skeleton", [(256 << 10, 1024, 1_000_000), (1500, 1024, 1_000_000), (400, 3, 1_000_000), (300, 1024, 40)]
)
def test_against_all_prefixes(spark, monkeypatch, shard, splitter, skeleton):
    monkeypatch.setattr(prefix_trie, "SHARD_BYTES", shard)
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", splitter)
    monkeypatch.setattr(prefix_trie, "SKELETON_TURNS", skeleton)
    monkeypatch.setattr(prefix_trie, "END_BYTES", 100)
    rows = _rows(shard)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == prefix_trie.COLUMNS
    assert _order(got.collect()) == _order(_brute(rows))


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).collect() == []
    # 3 takes all of its 1st turn's place from absent conversation 0, so it may be turnless
    for rows in ([(3, 0, "u", "t", 0, "")], [(5, None, None, None, 0, "")], [(0, 1, "u", "t", 0, ""), (0, 1, "u", "t", 0, "")]):
        got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
        assert _order(got) == _order(_brute(rows))


def test_skeleton_is_the_trie_of_the_splitters():
    a, b, c = (bytes([x]) * prefix_trie.TURN_BYTES for x in (1, 2, 3))
    made = prefix_trie.Skeleton.of([(b"", 4), (a + b, 1), (a + b, 7), (a + c, 2), (b, 0)])
    assert [w.tolist() for w in made.nodes] == [[0], [0, 1, 2], [0, 1, 2], [0, 1, 3], [0, 4]]
    assert made.parent == [-1, 0, 1, 1, 0] and made.depth == [0, 1, 2, 2, 1]
