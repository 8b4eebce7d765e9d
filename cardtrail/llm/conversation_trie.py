"""Prefix trie of conversations by truncation peeling.

Every conversation starts with turns of a shared one: conversation c keeps its own turns
behind its first h and gets the first h turns of conversation c - c % ``family`` before
them (h from a hash of c). Each distinct sequence of first d turns is a node.

1. Marks. A turn becomes four 31-bit numbers of the MD5 of role and text and its number of
   words; texts go no further.
2. Positions and prefix hashes by a scan over range-partitioned turns: each task numbers
   its turns and sums t * B^position modulo 2^31 - 1 (four bases), and what a partition's
   first conversation had before it is added afterwards, from at most two rows per
   partition. So the turns of one conversation may fill any number of partitions. Such
   sums can be shifted, so rebuilding conversations needs no second scan.
3. Equal conversations merge: one with n members goes on, that of the smallest id.
4. Peeling. The turns that a conversation shares with no other different one are peeled as
   one run: their nodes have its n members, one leaf and at most one child. From the
   greatest depth that different conversations share down to the root, every round merges
   the conversations ending there with the nodes that survive from below, by one
   aggregation on the prefix hash that also sums members, children, leaves and saved
   tokens; then it strips the last turn, which leaves the parent's hash. The rounds are as
   many as the longest prefix that two different conversations share.
5. The ids of the conversations that end at a node are sorted by range, cut into runs of
   text of up to ``RUN`` ids in parallel, and the runs of a node pass through SHA-256.

Every table is written to the shared folder before it is used twice. No step collects the
rows of a key: hot first turns, copies and single long conversations are pre-aggregated
before any shuffle or split by range.

Defined results: turns are ordered by turn (null first), then role, then the MD5 of the
turn; repeated rows are turns of their own. Null role and text are empty. Rows without
conv_id belong to no conversation and are left out; a table without conversations has no
node, not even the root. Only conv_id, turn, role and text are read; ids stay exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardtrail.llm.common import WORD, Scratch, map_arrow

PRIME = (1 << 31) - 1
#: Bases of the four hashes (fixed values, any numbers below PRIME).
BASES = (1_103_515_245, 1_812_433_253, 1_664_525_111, 1_370_716_703)
N = len(BASES)
RUN = 1024
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base^e modulo PRIME for every e >= 0."""
    out, square, left = np.ones(len(exponents), dtype=np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def marks(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, t0..t3, n_words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    # 32 bits modulo the prime; from 1, so that no turn vanishes from a sum
    parts = [(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") % (PRIME - 1) + 1).alias(f"t{i}") for i in range(N)]
    return (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), *parts, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words")))


LOCAL = ("part int, seg long, conv_id long, pos long, n_words long, w long, "
         + ", ".join(f"h{i} long" for i in range(N)) + ", " + ", ".join(f"q{i} long" for i in range(N)))


def _scan(batches):
    """Turns sorted by conversation: part, seg (0: the partition's first conversation), pos,
    sum of words and of hashes up to (h) and before (q) each turn, from the partition's start."""
    from pyspark import TaskContext

    part, seg = TaskContext.get().partitionId(), -1
    last, pos0, w0, h0 = None, 0, 0, [0] * N
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        rows = np.arange(len(conv))
        new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1            # -1: goes on from the batch before
        start = np.where(group < 0, 0, first[np.maximum(group, 0)] if len(first) else 0)
        carried = group < 0
        pos = rows - start + 1 + np.where(carried, pos0, 0)
        words = batch.column("n_words").to_numpy()

        def summed(x, before, modulus=None):
            total = np.cumsum(x)
            out = total - np.where(start > 0, total[start - 1], 0) + np.where(carried, before, 0)
            return out % modulus if modulus else out

        w = summed(words, w0)
        hs, qs = [], []
        for i in range(N):
            term = batch.column(f"t{i}").to_numpy() * power(BASES[i], pos) % PRIME
            hs.append(summed(term, h0[i], PRIME))
            qs.append((hs[-1] - term) % PRIME)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(conv), part, dtype=np.int32)), pa.array(group + 1 + seg), batch.column("conv_id"), pa.array(pos), pa.array(words), pa.array(w), *map(pa.array, hs + qs)],
            names=["part", "seg", "conv_id", "pos", "n_words", "w", *(f"h{i}" for i in range(N)), *(f"q{i}" for i in range(N))])
        seg, last, pos0, w0, h0 = int(group[-1]) + 1 + seg, conv[-1], int(pos[-1]), int(w[-1]), [int(h[-1]) for h in hs]


def _carried(local: DataFrame) -> list[tuple]:
    """(part, turns, words, hashes...) before the first conversation of each partition that
    begins inside one. From one row per partition."""
    names = ["conv_id", "pos", "w", *(f"h{i}" for i in range(N))]
    of_first, of_last = F.when(F.col("seg") == 0, F.col("pos")), F.col("seg") * F.lit(1 << 31) + F.col("pos")
    ends = local.groupBy("part").agg(
        *(F.max_by(F.when(F.col("seg") == 0, F.col(c)), of_first).alias(f"first_{c}") for c in names),
        *(F.max_by(c, of_last).alias(f"last_{c}") for c in names), F.max("seg").alias("segs"))
    out, conv, before = [], None, (0,) * (2 + N)
    for r in sorted(ends.collect()):
        if r["first_conv_id"] != conv:
            before = (0,) * (2 + N)
        elif before[0]:
            out.append((r["part"], *before))
        conv, *more = (r[f"last_{c}"] for c in names)
        if r["segs"]:
            before = tuple(more)
        else:
            scale = [pow(b, before[0], PRIME) for b in BASES]
            before = (before[0] + more[0], before[1] + more[1], *((b + s * m) % PRIME for b, s, m in zip(before[2:], scale, more[2:])))
    return out


def numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), n_words, w (words up to the turn), hash (of the turns up to
    it), before (the hash without it) of every turn."""
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", *(f"t{i}" for i in range(N))]
    dealt = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = scratch.cut(map_arrow(dealt, _scan, LOCAL), "local")
    carried = [(*c, *(pow(b, c[1], PRIME) for b in BASES)) for c in _carried(local)]
    if carried:  # at most one row per partition
        names = ["part", "n0", "w0", *(f"b{i}" for i in range(N)), *(f"s{i}" for i in range(N))]
        offsets = local.sparkSession.createDataFrame(carried, ", ".join(f"{n} long" for n in names)).withColumn("seg", F.lit(0).cast("long"))
        there = F.col("n0").isNotNull()
        local = local.join(F.broadcast(offsets), ["part", "seg"], "left")
        local = local.withColumns(
            {"pos": F.when(there, F.col("pos") + F.col("n0")).otherwise(F.col("pos")), "w": F.when(there, F.col("w") + F.col("w0")).otherwise(F.col("w"))}
            | {f"{x}{i}": F.when(there, (F.col(f"b{i}") + F.col(f"s{i}") * F.col(f"{x}{i}")) % PRIME).otherwise(F.col(f"{x}{i}")) for x in "hq" for i in range(N)})
    return local.select("conv_id", "pos", "n_words", "w", _struct(F.col(f"h{i}") for i in range(N)).alias("hash"), _struct(F.col(f"q{i}") for i in range(N)).alias("before"))


def _struct(parts) -> Column:
    return F.struct(*(p.alias(f"x{i}") for i, p in enumerate(parts)))


def _fields(name: str) -> list[Column]:
    return [F.col(f"{name}.x{i}") for i in range(N)]


def _shifted(name: str) -> Column:
    """Hash ``name`` of a conversation's own turns as one of its rebuilt turns."""
    return _struct((a + s * x) % PRIME for a, s, x in zip(_fields("a"), _fields("s"), _fields(name)))


def rebuilt(turns: DataFrame, family: int, heads: int, scratch: Scratch) -> DataFrame:
    """A row per conversation: conv_id, h, k (turns taken from the base), base (the base's
    first turns), what shifts the hashes and words of its own turns (a, s, wa), n_turns, end
    (hash of all turns), words."""

    def head(i: int) -> Column:
        of = lambda c: F.max(F.when(F.col("pos") == i, F.col(c)))
        there = F.struct(_struct(of(f"hash.x{j}") for j in range(N)).alias("hash"), of("w").alias("w"), of("n_words").alias("n_words"),
                         _struct(of(f"before.x{j}") for j in range(N)).alias("before"))
        return F.when(F.max("pos") >= i, there)

    spine = scratch.cut(turns.groupBy("conv_id").agg(
        F.max("pos").alias("own"), _struct(F.max_by(f"hash.x{j}", "pos") for j in range(N)).alias("own_end"), F.max("w").alias("own_words"),
        F.array_compact(F.array(*(head(i) for i in range(1, heads)))).alias("first")), "spine")
    bases = spine.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base_id"), F.col("first").alias("base"))
    spine = spine.withColumns({"base_id": F.col("conv_id") - F.col("conv_id") % family, "h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")})
    convs = spine.join(bases, "base_id", "left")
    convs = convs.withColumn("base", F.slice(F.coalesce("base", F.array().cast(convs.schema["base"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumns({"k": F.size("base"), "m": F.least(F.col("h"), F.col("own").cast("int"))})

    def at(turns_of: str, n: str, field: str, zero: Column) -> Column:
        return F.when(F.col(n) > 0, F.try_element_at(F.col(turns_of), F.col(n))[field]).otherwise(zero)

    zero = F.lit(0).cast("long")
    nothing = _struct([zero] * N)
    convs = convs.withColumns({
        "base_end": at("base", "k", "hash", nothing), "base_words": at("base", "k", "w", zero),
        "cut": at("first", "m", "hash", nothing), "cut_words": at("first", "m", "w", zero),
        # B^(k - h)
        "s": _struct(F.element_at(F.array(*(F.lit(pow(b, -i, PRIME)).cast("long") for i in range(heads))), F.col("h") - F.col("k") + 1) for b in BASES)})
    # a hash H of own turns becomes base_end + s * (H - cut)
    convs = convs.withColumns({
        "a": _struct((e + PRIME - s * c % PRIME) % PRIME for e, s, c in zip(_fields("base_end"), _fields("s"), _fields("cut"))),
        "wa": F.col("base_words") - F.col("cut_words")})
    more = F.col("own") > F.col("h")
    return convs.select(
        "conv_id", "h", "k", "base", "a", "s", "wa",
        (F.col("k") + F.greatest(F.col("own") - F.col("h"), zero)).alias("n_turns"),
        F.when(more, _shifted("own_end")).otherwise(F.col("base_end")).alias("end"),
        F.when(more, F.col("own_words") + F.col("wa")).otherwise(F.col("base_words")).alias("words"))


def ends(convs: DataFrame) -> DataFrame:
    """depth, key, ends_sha256 of the conversations that end at each node."""
    keys = ["depth", *(f"x{i}" for i in range(N))]
    flat = convs.select(F.col("n_turns").alias("depth"), "end.*", "conv_id")
    flat = flat.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    kinds = [(k, pa.int64()) for k in keys]

    def runs(batches):
        schema = pa.schema([*kinds, ("at", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            columns = np.array([batch.column(k).to_numpy() for k in keys])
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_pylist()
            bounds = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
            cuts = [(i, min(i + RUN, b)) for a, b in zip(bounds, bounds[1:]) for i in range(a, b, RUN)]
            starts = [a for a, _ in cuts]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in columns), pa.array([ids[a] for a in starts], pa.int64()),
                                              pa.array([",".join(map(str, ids[a:b])) for a, b in cuts], pa.string())], schema=schema)

    def hashed(batches):
        schema = pa.schema([*kinds, ("ends_sha256", pa.string())])
        last, sha = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids"))):
                if key == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append(dict(zip(keys, last)) | {"ends_sha256": sha.hexdigest()})
                last, sha = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, last)) | {"ends_sha256": sha.hexdigest()}], schema=schema)

    longs = ", ".join(f"{k} long" for k in keys)
    cut = map_arrow(flat, runs, f"{longs}, at long, ids string").repartition(*keys).sortWithinPartitions(*keys, "at")
    return map_arrow(cut, hashed, f"{longs}, ends_sha256 string").select("depth", _struct(map(F.col, keys[1:])).alias("key"), "ends_sha256")


def peel(shared: DataFrame, tops: DataFrame, turnless: DataFrame, deepest: int, scratch: Scratch) -> DataFrame:
    """Nodes at depths 0 to ``deepest``: conv_id, depth, key, parent, n_convs, n_children,
    n_leaves, saved_tokens.

    ``shared``: a row per different conversation and shared turn (depth, key, parent,
    conv_id, n_words, n: its members if it ends there, else 0). ``tops``: the topmost nodes
    of the private runs (depth, parent, conv_id, n, saved). ``turnless``: conv_id, n."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    root = _struct([zero] * N)
    columns = ["key", *(f"p{i}" for i in range(N)), "n_words", "conv_id", "n", "children", "leaves", "saved"]
    none = [F.lit(None).cast("long")] * N
    nodes = alive = None
    for depth in range(deepest, -1, -1):
        if depth:
            merged = shared.where(F.col("depth") == depth).select("key", *_fields("parent"), "n_words", "conv_id", "n", zero, zero, zero).toDF(*columns)
        else:
            merged = turnless.select(root, *none, zero, "conv_id", "n", zero, zero, zero).toDF(*columns)
        merged = merged.union(tops.where(F.col("depth") == depth + 1).select("parent", *none, zero, "conv_id", "n", one, one, "saved"))
        if alive is not None:  # stripped of its last turn, a node goes on as its parent
            merged = merged.union(alive.select("parent", *none, zero, "conv_id", "n_convs", one, "n_leaves", "saved_tokens"))
        merged = merged.groupBy("key").agg(
            *(F.max(c).alias(c) for c in columns[1:N + 2]), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in columns[-4:]))
        alive = scratch.cut(merged.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), "key", _struct(F.col(f"p{i}") for i in range(N)).alias("parent"), F.col("n").alias("n_convs"),
            F.col("children").alias("n_children"), F.greatest(F.col("leaves"), one).alias("n_leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.col("n_words")).alias("saved_tokens")), f"depth{depth}")
        nodes = alive if nodes is None else nodes.union(alive)
    return nodes


def prefix_trie(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations (columns NODE). ``heads`` is the
    modulus of h: up to ``heads`` - 1 turns come from the base."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.cut(numbered(scratch.cut(marks(conversations), "marks"), scratch), "turns")
    scratch.drop("marks", "local")
    convs = scratch.cut(rebuilt(turns, family, heads, scratch), "convs")
    digests = scratch.cut(ends(convs), "ends")
    classes = convs.groupBy("n_turns", "end").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).select("conv_id", "n")
    firsts = scratch.cut(convs.join(classes, "conv_id"), "firsts")

    whole = ["conv_id", "n", "n_turns", "words"]
    own = turns.join(firsts.drop("base"), "conv_id").where(F.col("pos") > F.col("h"))
    own = own.select(*whole, (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), _shifted("hash").alias("key"), _shifted("before").alias("parent"),
                     "n_words", (F.col("w") + F.col("wa")).alias("w"))
    taken = firsts.select(*whole, F.posexplode("base").alias("i", "t")).select(
        *whole, (F.col("i") + 1).cast("long").alias("depth"), F.col("t.hash").alias("key"), F.col("t.before").alias("parent"), "t.n_words", "t.w")
    rows = scratch.cut(own.unionByName(taken), "rows")
    scratch.drop("turns", "spine", "convs")

    root = _struct([F.lit(0).cast("long")] * N)
    several = rows.groupBy("depth", "key").agg(F.min("conv_id").alias("first"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    top = firsts.agg(F.min("conv_id").alias("first")).where("first is not null").select(F.lit(0).cast("long").alias("depth"), root.alias("key"), "first")
    several = scratch.cut(several.unionByName(top), "several")
    deepest = several.agg(F.max("depth")).first()[0] or 0
    parents = several.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("first").alias("above"))

    by_depth = lambda df: df.repartitionByRange("depth", "conv_id")  # noqa: E731  a round reads the files of its depth
    ends_here = F.when(F.col("depth") == F.col("n_turns"), F.col("n")).otherwise(0).cast("long")
    shared = rows.join(several, ["depth", "key"], "left_semi").select("depth", "key", "parent", "conv_id", "n_words", ends_here.alias("n"))
    shared = scratch.cut(by_depth(shared), "shared")
    private = rows.join(several, ["depth", "key"], "left_anti").join(parents, ["depth", "parent"], "left")
    saved = (F.col("n") - 1) * (F.col("words") - F.col("w") + F.col("n_words"))
    private = scratch.cut(private.select("conv_id", "depth", "key", "parent", "above", "n", (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), saved.alias("saved")), "private")
    tops = scratch.cut(by_depth(private.where("above is not null").select("depth", "parent", "conv_id", "n", "saved")), "tops")
    nodes = peel(shared, tops, firsts.where("n_turns = 0").select("conv_id", "n"), deepest, scratch)
    scratch.drop("rows", "shared", "tops", "firsts")

    one = F.lit(1).cast("long")
    nodes = nodes.join(parents, ["depth", "parent"], "left").withColumnRenamed("above", "parent_conv_id")
    nodes = nodes.join(digests, ["depth", "key"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
    private = private.withColumns({"parent_conv_id": F.coalesce("above", "conv_id"), "n_convs": F.col("n"), "n_leaves": one, "saved_tokens": F.col("saved")})
    inner = private.where("n_children = 1").withColumn("ends_sha256", F.lit(EMPTY_SHA))
    last = private.where("n_children = 0").join(digests, ["depth", "key"])
    return nodes.select(*NODE).unionByName(inner.select(*NODE)).unionByName(last.select(*NODE))
