import hashlib
import random
import zlib

from cardtrail.llm.conversation_trie import NODE, _carried, marks, numbered, prefix_trie
from cardtrail.llm.common import Scratch
from cardtrail.llm.queries import ORACLE_SQL, QUERIES

from .helpers import SF001
from .oracles import same_as_sql

BIG = 9007199254740993
TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, family=20, heads=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda t: (*t[:3], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest() if ties else t[3])
    ties = True
    own = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(abs(c) % family * (1 if c >= 0 else -1))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    out, below = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        words = len(n[-1][1].encode().split()) if n else 0
        kids = [below[k] for k in children.get(n, [])]
        leaves, saved = sum(k[0] for k in kids) or 1, sum(k[1] for k in kids) + (len(nodes[n]) - 1) * words
        below[n] = leaves, saved
        ends = ",".join(str(c) for c in sorted(nodes[n]) if full[c] == n)
        out[min(nodes[n]), len(n)] = (min(nodes[n]), len(n), min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(kids), leaves, saved,
                                      hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def check(spark, rows, **clash):
    df = spark.createDataFrame(rows, TURNS)
    for name in ("depth", "key", "n", "pos", "part"):
        df = df.withColumn(name, df["text"])
    got = prefix_trie(df)
    assert got.columns == NODE
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_matches_sql(spark):
    same_as_sql(QUERIES["op11_conversation_trie"](spark, SF001), ORACLE_SQL["op11_conversation_trie"], SF001)


def test_awkward_conversations(spark):
    long = "word " * 50_000
    rows = [
        (0, 0, "user", "a b"), (0, 1, "bot", "c"), (0, 2, "user", "d e f"), (0, 3, "bot", "g"),
        (1, None, "user", "x"), (1, 5, None, "y"), (1, 5, None, "y"), (1, 7, "user", None),
        (20, 0, None, None), (21, 0, "", ""), (22, 0, "a", "bc"), (23, 0, "ab", "c"),
        (40, 0, "user", long), (41, 0, "user", long), (41, 1, "user", " \t "), (42, 0, "user", long),
        (None, 0, "user", "nobody"), (-5, 0, "user", "a b"), (-41, 0, "user", "z"), (-40, 0, "user", "z"),
        (BIG, 0, "user", "big id"), (BIG + 2, 0, "user", "big id"), (BIG + 2, 0, "user", "big id")]
    rows += [(c, t, "user", f"shared {t}") for c in range(100, 108) for t in range(c - 98)]
    check(spark, rows)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b b", ""])) for c in range(80) for t in rng.sample(range(12), rng.randint(1, 5))]
    check(spark, rows)


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", "hello all" if t == 0 or c % 3 else f"own {c}") for c in range(600) for t in range(2)]
    check(spark, rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(3000)] + [(c, t, "user", f"{c}") for c in range(12) if c != 7 for t in range(3)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    scratch = Scratch(spark, "test-trie")
    turns = numbered(scratch.cut(marks(df), "marks"), scratch)
    local = spark.read.parquet(scratch.path("local"))
    if local.select("part").distinct().count() > 1:
        assert _carried(local)
    assert sorted(r["pos"] for r in turns.where("conv_id = 7").collect()) == list(range(1, 3001))
    check(spark, rows)


def test_no_conversations(spark):
    check(spark, [])
    check(spark, [(None, 0, "user", "nobody")])
