"""Transfer-closure tracing: follow transfers outward from seed cards, round by
round.

Semantics (those of the traced jobs, each with a test):

* ``S0`` is the seed list; ``S(i)`` is the set of distinct endpoints (src and
  dest, one null kept) of the rows whose src or dest is in ``S(i-1)``. ``S``
  is *replaced* each round, so a seed with no row is lost after round 1.
* The loop stops after ``max_rounds`` rounds, or when ``|S(i)| == |S(i-1)|``
  (``stop="count"``, the reference; ``|S0|`` counts duplicate seeds) or when
  the sets are equal (``stop="set"``). From round 1 on, ``S`` only grows, so
  the two rules differ only in round 1.
* Row outputs of round ``r`` are matched by ``S(r-1)``, the set at the start
  of that round.

Plan, built for a history far larger than any frontier:

* The rows are reduced once to a symmetric adjacency ``(a, b)`` (each edge in
  both directions, distinct, null ``a`` dropped), written to the shared
  checkpoint folder and cached. A round is one semi join of the adjacency
  with a probe set, then the endpoints ``a, b`` of the matched rows minus the
  cards already reached: a broadcast anti join while those are few (size
  known from the previous round), else one aggregation of tagged endpoints
  and known cards sharing a single shuffle.
* ``method="delta"`` (default) probes only the cards first reached in the
  previous round: ``S(i+1) = S(i) + N(S(i) - S(i-1))`` holds for every
  ``i >= 1`` because ``S(i) ⊆ N(S(i))`` and ``N(S(i) ∩ S(i-1)) ⊆ S(i)``.
  ``method="full"`` probes all of ``S(i)``, as the reference does.
* Above ``cardtrail.trace.bucketRows`` adjacency rows, the adjacency is not
  cached whole but rewritten partitioned by a hash bucket of ``a``; the probe
  joins on (bucket, card), and dynamic partition pruning from the broadcast
  probe reads only its buckets, so a late round with a few new cards reads a
  few files instead of the whole adjacency.
* The probe is broadcast when its exact row count (known from the previous
  round) is under the session's bound. Beyond it the adjacency is laid out once
  more, bucketed on ``a`` with the rows of hubs apart (``WideAdjacency``), and a
  round shuffles only its probe.
* Each round appends the cards it reached first to a ``round``-partitioned
  Parquet table in the checkpoint folder: that cuts the lineage every round,
  survives lost executors, and gives ``S(r)`` as ``round <= r``. The only
  driver action per round is the write, whose row count comes back as an
  observed metric.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..constants import CARD, IN_COL, OUT_COL, PRI_COL, TRACED_COLUMNS
from ..functions import predicates as P
from ..operators import semi
from ..session import broadcast_row_limit, delete_path, scratch_path
from ..sinks import write_counted
from . import encoded
from .manifest import Manifest

_A, _B = "a", "b"
_ROUND = "round"


def adjacency(rows: DataFrame, src: str, dest: str, once: bool = False) -> DataFrame:
    """Distinct ``(a, b)`` pairs over both directions of every edge, null ``a``
    dropped (null never matches a card). One scan and one aggregation, with a
    map-side partial step that collapses repeated transfers of a pair before
    the shuffle. With ``once`` an edge is shuffled once, its lesser end first, and
    turned round after it; a null end is its second."""
    if not once:
        both = F.array(F.struct(F.col(src).alias(_A), F.col(dest).alias(_B)),
                       F.struct(F.col(dest).alias(_A), F.col(src).alias(_B)))
        return rows.select(F.inline(both)).filter(F.col(_A).isNotNull()).distinct()
    low, high = F.least(src, dest), F.greatest(src, dest)
    blind = F.col(src).isNull() | F.col(dest).isNull()
    edges = (rows.select(low.alias(_A), F.when(~blind, high).alias(_B))
             .filter(F.col(_A).isNotNull()).distinct())
    there = F.struct(F.col(_A), F.col(_B))
    back = F.struct(F.col(_B).alias(_A), F.col(_A).alias(_B))
    two = F.col(_B).isNotNull() & (F.col(_A) != F.col(_B))
    return edges.select(F.inline(F.when(two, F.array(there, back)).otherwise(F.array(there))))


_BUCKET = "bucket"
#: Rows of a file of the bucketed adjacency.
_BUCKET_ROWS = 2_000_000
#: Hubs that may be broadcast: rows of a card each, under 64 MB together.
_MOST_HUBS = 1_000_000


def _ends(df: DataFrame, far: bool = False):
    """The two ends of adjacency rows, or the ``far`` ones alone, ``b``, which may be a
    list of neighbours."""
    listed = isinstance(df.schema[_B].dataType, ArrayType)
    if far:
        return (F.explode(_B) if listed else F.col(_B)).alias(CARD)
    both = F.concat(F.array(F.col(_A)), F.col(_B)) if listed else F.array(F.col(_A), F.col(_B))
    return F.explode(both).alias(CARD)


def bucket_of(card, buckets: int):
    """Hash bucket of a card (``xxhash64``: stable across runs and machines)."""
    c = F.col(card) if isinstance(card, str) else card
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _bucket_plan(spark, adj_rows: int) -> int | None:
    """Buckets for the adjacency, or None to keep it whole and cached.

    Above ``cardtrail.trace.bucketRows`` rows (default 100M) a round should not
    scan all of it: it is rewritten partitioned by a hash bucket of ``a``, so
    that a round's probe prunes it to its own buckets (dynamic partition
    pruning from the broadcast probe). ``cardtrail.trace.buckets`` fixes the
    count; by default ~2M rows a bucket, between 64 and 8192.
    """
    limit = int(spark.conf.get("cardtrail.trace.bucketRows", str(100_000_000)))
    if adj_rows <= limit:
        return None
    fixed = spark.conf.get("cardtrail.trace.buckets", None)
    if fixed is not None:
        return max(int(fixed), 1)
    return min(max(adj_rows // 2_000_000, 64), 8192)


def _probe_keys(probe: DataFrame, probe_rows: int | None, buckets: int | None) -> DataFrame:
    # A null card never matches the equi-join (Catalyst adds the not-null
    # filter itself), so none is written here.
    keys = probe.select(F.col(CARD).alias("__ct_card"))
    if buckets:
        keys = keys.withColumn("__ct_bucket", bucket_of("__ct_card", buckets))
    if probe_rows is not None and probe_rows <= broadcast_row_limit(probe.sparkSession):
        keys = F.broadcast(keys)
    return keys


class WideAdjacency:
    """The adjacency laid out for probes too large to broadcast.

    Written on first use: a catalog table bucketed on ``a``, so that a round's join
    moves only the probe, and apart from it the rows of hubs, cards of more than
    ``_BUCKET_ROWS`` rows. There are at most rows / ``_BUCKET_ROWS`` hubs; if they are
    counted to be at most ``_MOST_HUBS``, the probe's hubs are broadcast and their
    rows read by file, by any number of tasks.
    """

    def __init__(self, adj: DataFrame, path: str, buckets: int):
        self.adj, self.path, self.buckets = adj, path, buckets
        self.spark = adj.sparkSession
        self.name = f"ct_adjacency_{uuid.uuid4().hex}"
        self.written = False

    def _write(self) -> None:
        degrees = self.adj.groupBy(F.col(_A).alias("__hub")).count().filter(F.col("count") > _BUCKET_ROWS)
        few = write_counted(degrees.select("__hub"), f"{self.path}/hubs") <= _MOST_HUBS
        self.near = F.broadcast if few else (lambda df: df)
        self.hubs = self.spark.read.schema(degrees.select("__hub").schema).parquet(f"{self.path}/hubs")
        is_hub = F.col(_A) == F.col("__hub")
        self.adj.join(self.near(self.hubs), is_hub, "left_semi").select(_A, _B).write.parquet(f"{self.path}/hub-rows")
        (self.adj.join(self.near(self.hubs), is_hub, "left_anti").select(_A, _B)
         .repartition(self.buckets, _A).write.bucketBy(self.buckets, _A)
         .option("path", f"{self.path}/rows").saveAsTable(self.name))
        self.written = True

    def endpoints(self, probe: DataFrame, far: bool = False) -> DataFrame:
        if not self.written:
            self._write()
        keys = probe.select(F.col(CARD).alias("__ct_card"))
        hit = F.col(_A) == F.col("__ct_card")
        plain = self.spark.table(self.name).join(keys, hit, "left_semi")
        probed_hubs = keys.join(self.near(self.hubs), F.col("__ct_card") == F.col("__hub"), "left_semi")
        rows = self.spark.read.schema(self.adj.select(_A, _B).schema).parquet(f"{self.path}/hub-rows")
        both = plain.unionAll(rows.join(self.near(probed_hubs), hit, "left_semi"))
        return both.select(_ends(both, far))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # also what a failed write left
        delete_path(self.spark, self.path)


def endpoints(adj: DataFrame, probe: DataFrame, probe_rows: int | None,
              buckets: int | None = None, wide: WideAdjacency | None = None, far: bool = False) -> DataFrame:
    """Endpoints (with repeats) of the adjacency rows whose ``a`` is in ``probe``; only
    their ``b`` with ``far``.
    On a bucketed adjacency the join also matches buckets, which lets the
    probe prune the adjacency's partitions. A probe beyond the broadcast bound
    goes to the ``wide`` layout if there is one."""
    small = probe_rows is not None and probe_rows <= broadcast_row_limit(probe.sparkSession)
    if wide is not None and not small:
        return wide.endpoints(probe, far)
    keys = _probe_keys(probe, probe_rows, buckets)
    cond = F.col(_A) == F.col("__ct_card")
    if buckets:
        cond = (F.col(_BUCKET) == F.col("__ct_bucket")) & cond
    hit = adj.join(keys, cond, "left_semi")
    return hit.select(_ends(hit, far))


def expand(adj: DataFrame, probe: DataFrame, probe_rows: int | None,
           buckets: int | None = None, wide: WideAdjacency | None = None) -> DataFrame:
    """``N(probe)``: distinct endpoints of the adjacency rows whose ``a`` is in
    ``probe``."""
    return endpoints(adj, probe, probe_rows, buckets, wide).distinct()


def new_cards(adj: DataFrame, probe: DataFrame, probe_rows: int | None,
              known: DataFrame, known_rows: int, buckets: int | None = None,
              wide: WideAdjacency | None = None) -> DataFrame:
    """``N(probe) - known``, null-safe (a null end already known stays known). The
    probe is a part of ``known``, so that only the far ends of its rows can be new.

    A known set of checked small size is broadcast to a null-safe anti join
    after the distinct. Beyond the bound, one aggregation does both: endpoints
    tagged 1 and known cards tagged 0 share one shuffle, and a card is new when
    its smallest tag is 1 (grouping treats null as a key).
    """
    if known_rows <= broadcast_row_limit(adj.sparkSession):
        k = F.broadcast(known.withColumnRenamed(CARD, "__known"))
        return endpoints(adj, probe, probe_rows, buckets, wide, far=True).distinct().join(
            k, F.col(CARD).eqNullSafe(F.col("__known")), "left_anti")
    tagged = (endpoints(adj, probe, probe_rows, buckets, wide, far=True).select(CARD, F.lit(1).alias("__t"))
              .unionAll(known.select(CARD, F.lit(0).alias("__t"))))
    return (tagged.groupBy(CARD).agg(F.min("__t").alias("__t"))
            .filter(F.col("__t") == 1).select(CARD))


@dataclass
class TraceResult:
    spark: SparkSession
    path: str
    rounds: int                     # executed rounds R
    sizes: list[int]                # sizes[0] = seed list length; sizes[i] = |S(i)|
    seeds: DataFrame                # distinct seed cards
    seed_set_size: int
    frontier_path: str
    kind: str = "string"            # of cards: string, or long for numbered ones

    @property
    def frontier(self) -> DataFrame:
        """``(card, round)``: each card reached, with the first round it was in S."""
        schema = f"{CARD} {self.kind}, {_ROUND} int"
        if self.rounds == 0:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema).parquet(self.frontier_path)
                .filter(F.col(_ROUND) <= self.rounds).select(CARD, _ROUND))

    def cleanup(self) -> None:
        """Delete this trace's folder (frontier and seeds) once its outputs are
        written; frames from this result cannot be read afterwards."""
        delete_path(self.spark, self.path)

    def known_rows(self, r: int) -> int:
        return self.seed_set_size if r == 0 else self.sizes[r]

    def cards(self, r: int | None = None) -> DataFrame:
        """``S(r)``, by default the last set."""
        r = self.rounds if r is None else r
        if r == 0:
            return self.seeds
        return self.frontier.filter(F.col(_ROUND) <= r).select(CARD)

    def sizes_df(self) -> DataFrame:
        """``(round, n_cards)`` for rounds 0..R; round 0 counts the seed list."""
        return self.spark.createDataFrame(list(enumerate(self.sizes)),
                                          f"{_ROUND} int, n_cards long")

    def lookup(self) -> DataFrame:
        """``(card, first_round, is_seed)`` for every non-null seed or reached
        card: one aggregation over the union of both (one shuffle, bounded by
        the frontier and the seed list)."""
        fr = self.frontier.select(CARD, F.col(_ROUND).alias("first_round"),
                                  F.lit(False).alias("is_seed"))
        sd = self.seeds.select(CARD, F.lit(None).cast("int").alias("first_round"),
                               F.lit(True).alias("is_seed"))
        return (fr.unionAll(sd).filter(F.col(CARD).isNotNull()).groupBy(CARD)
                .agg(F.min("first_round").alias("first_round"),
                     F.max("is_seed").alias("is_seed")))


def trace(rows: DataFrame, seeds: DataFrame, src: str, dest: str,
          max_rounds: int | None = None, stop: str = "count",
          method: str = "delta", layout: str = "pairs", run_path: str | None = None) -> TraceResult:
    """Run the closure over ``rows`` (already filtered and trimmed) from the
    one-column ``card`` DataFrame ``seeds``.

    ``layout="lists"`` numbers the cards and walks sorted neighbour lists (``encoded``);
    the result is the same.

    With ``run_path`` (a folder in the shared store) every finished step is put on record
    there. A run that was stopped, its driver lost, goes on from the last complete round
    when the same call is made again: neither the history nor an earlier round is read or
    computed again. A run on record as finished is returned as it is; a larger
    ``max_rounds`` takes it further while its adjacency is there, that is unless a stop
    rule ended it. Without ``run_path`` a failed run leaves nothing behind."""
    if stop not in ("count", "set"):
        raise ValueError(f"unknown stop rule {stop!r}")
    if method not in ("delta", "full"):
        raise ValueError(f"unknown method {method!r}")
    if layout not in ("pairs", "lists"):
        raise ValueError(f"unknown layout {layout!r}")
    spark = rows.sparkSession
    base = run_path or scratch_path(spark, "trace")
    manifest = Manifest(spark, f"{base}/manifest") if run_path else None
    if manifest is not None:
        asked = {"src": src, "dest": dest, "stop": stop, "method": method, "layout": layout}
        if manifest.steps().get("run", asked) != asked:
            raise ValueError(f"{run_path} holds a run with other settings: {manifest.steps()['run']}")
        manifest.done("run", **asked)
    try:
        return _trace(rows, seeds, src, dest, max_rounds, stop, method, layout, base, manifest)
    except BaseException:
        if manifest is None:
            delete_path(spark, base)
        raise


def _write_seeds(seeds: DataFrame, path: str) -> tuple[int, int]:
    """Write the distinct seeds; the list's length (duplicates count) and the set's size,
    both observed on the written rows."""
    seen = Observation()
    (seeds.groupBy(CARD).agg(F.count(F.lit(1)).alias("m"))
     .observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("listed"))
     .write.mode("overwrite").parquet(path))
    return int(seen.get["listed"]), int(seen.get["n"])


def _write_adjacency(adj: DataFrame, base: str) -> tuple[int, int | None]:
    """Write the adjacency below ``base``, in buckets if it is large: rows and buckets."""
    spark = adj.sparkSession
    adj_path = f"{base}/adjacency"
    adj_rows = write_counted(adj, adj_path)
    buckets = _bucket_plan(spark, adj_rows)
    if buckets is not None:
        # One pass over the adjacency (not the history). Rows of a bucket are dealt
        # to as many files as its measured size asks for: a hub's bucket to many.
        flat = spark.read.schema(adj.schema).parquet(adj_path).withColumn(_BUCKET, bucket_of(_A, buckets))
        sizes_of = flat.groupBy(_BUCKET).agg(F.ceil(F.count("*") / _BUCKET_ROWS).alias("__files"))
        # at most ``buckets`` rows of two numbers, and ``buckets`` is bounded
        (flat.join(F.broadcast(sizes_of), _BUCKET)
         .withColumn("__salt", F.pmod(F.xxhash64(F.col(_B)), F.col("__files")))
         .repartition(max(buckets, adj_rows // _BUCKET_ROWS), F.col(_BUCKET), F.col("__salt")).drop("__files", "__salt")
         .write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{base}/adjacency-buckets"))
        delete_path(spark, adj_path)
    return adj_rows, buckets


def _trace(rows, seeds, src, dest, max_rounds, stop, method, layout, base, manifest) -> TraceResult:
    spark = rows.sparkSession
    known = manifest.steps() if manifest is not None else {}
    seeds = seeds.select(F.col(CARD).cast("string").alias(CARD))
    ids, kind = None, "string"
    if layout == "lists":
        kind = "long"
        if "graph" not in known:
            graph = encoded.encode(adjacency(rows, src, dest, once=True), f"{base}/graph", more=seeds)
            encoded.neighbour_lists(graph.pairs, f"{base}/graph")
            if manifest is not None:
                manifest.done("graph")
        ids = spark.read.schema(f"{CARD} string, {encoded.ID} long").parquet(f"{base}/graph/ids")
        seeds = encoded.with_ids(seeds, ids, [CARD])
    seed_path, frontier_path = f"{base}/seeds", f"{base}/frontier"
    if "seeds" not in known:
        n_list, n_seed_set = _write_seeds(seeds, seed_path)
        if manifest is not None:
            manifest.done("seeds", listed=n_list, distinct=n_seed_set)
    else:
        n_list, n_seed_set = known["seeds"]["listed"], known["seeds"]["distinct"]
    seed_set = spark.read.schema(f"{CARD} {kind}").parquet(seed_path)
    rounds = sorted((int(step.removeprefix("round-")), facts["size"]) for step, facts in known.items() if step.startswith("round-"))
    sizes = [n_list, *(n for _, n in rounds)]
    if max_rounds is not None:
        sizes = sizes[:max(max_rounds, 0) + 1]
    result = TraceResult(spark, base, len(sizes) - 1, sizes, seed_set, n_seed_set, frontier_path, kind)
    over = "finished" in known or (max_rounds is not None and len(sizes) - 1 >= max(max_rounds, 0))
    if n_list and not over:
        _walk(rows, result, src, dest, max_rounds, stop, method, layout, manifest, known)
    return result if layout == "pairs" else _decoded(result, ids)


def _decoded(result: TraceResult, ids: DataFrame) -> TraceResult:
    """The result with cards in place of numbers."""
    spark, path = result.spark, f"{result.path}/cards"
    encoded.with_cards(result.seeds, ids).write.mode("overwrite").parquet(f"{path}/seeds")
    if result.rounds:
        encoded.with_cards(result.frontier, ids).write.mode("overwrite").partitionBy(_ROUND).parquet(f"{path}/frontier")
    return TraceResult(spark, result.path, result.rounds, result.sizes, spark.read.schema(f"{CARD} string").parquet(f"{path}/seeds"), result.seed_set_size, f"{path}/frontier")


def _walk(rows, result: TraceResult, src, dest, max_rounds, stop, method, layout, manifest, known) -> None:
    """The rounds that are left; extends ``result``."""
    spark, base, sizes, kind = result.spark, result.path, result.sizes, result.kind
    seed_set, n_seed_set, frontier_path = result.seeds, result.seed_set_size, result.frontier_path

    def frontier() -> DataFrame:
        # One listing of the frontier folder per round; probe and known sets
        # are partition-pruned views of it.
        return spark.read.schema(f"{CARD} {kind}, {_ROUND} int").parquet(frontier_path)

    def reached(upto: int, fr: DataFrame | None = None) -> DataFrame:
        fr = frontier() if fr is None else fr
        return fr.filter(F.col(_ROUND) <= upto).select(CARD)

    def finished(number: int, size: int) -> None:
        sizes.append(size)
        if manifest is not None:
            manifest.done(f"round-{number:04d}", size=size)

    adj_path, bucketed_path = f"{base}/adjacency", f"{base}/adjacency-buckets"
    cached, wide, r, ended = None, None, len(sizes) - 1, False
    try:
        if "adjacency" not in known:
            if layout == "lists":
                adj = spark.read.schema("a long, b array<long>").parquet(f"{base}/graph/lists")
            else:
                adj = adjacency(rows, src, dest, once=True)
            adj_rows, buckets = _write_adjacency(adj, base)
            if manifest is not None:
                manifest.done("adjacency", rows=adj_rows, buckets=buckets)
        else:
            adj_rows, buckets = known["adjacency"]["rows"], known["adjacency"]["buckets"]
        schema = StructType.fromDDL(f"{_A} {kind}, {_B} {'array<long>' if layout == 'lists' else kind}")
        if buckets is None:
            adj = cached = spark.read.schema(schema).parquet(adj_path).persist(StorageLevel.MEMORY_AND_DISK)
        else:
            adj = spark.read.schema(schema.add(_BUCKET, "integer")).parquet(bucketed_path)
        wide = WideAdjacency(adj, f"{base}/adjacency-wide-{uuid.uuid4().hex}", max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        if r == 0:
            # Round 1 probes the seeds.
            s1 = expand(adj, seed_set, n_seed_set, buckets, wide)
            finished(1, write_counted(s1, f"{frontier_path}/{_ROUND}=1"))
            r = 1
        while True:
            if max_rounds is not None and r >= max_rounds:
                break
            if stop == "count" and sizes[r] == sizes[r - 1]:
                ended = True
                break
            if stop == "set":
                if r == 1:
                    sd = seed_set.select(F.col(CARD).alias("__sd"))
                    inter = reached(1).join(sd, F.col(CARD) == F.col("__sd"), "left_semi").count()
                    ended = sizes[1] == n_seed_set and inter == sizes[1]
                else:
                    ended = sizes[r] == sizes[r - 1]
                if ended:
                    break
            # Round r+1.
            fr = frontier()
            if method == "delta":
                if r == 1:
                    sd = seed_set.select(F.col(CARD).alias("__sd"))
                    probe = reached(1, fr).join(sd, F.col(CARD) == F.col("__sd"), "left_anti")
                    probe_rows = sizes[1]            # an upper bound of S1 - S0
                else:
                    probe = fr.filter(F.col(_ROUND) == r).select(CARD)
                    probe_rows = sizes[r] - sizes[r - 1]
            else:
                probe, probe_rows = reached(r, fr), sizes[r]
            fresh = new_cards(adj, probe, probe_rows, reached(r, fr), sizes[r], buckets, wide)
            n_new = write_counted(fresh, f"{frontier_path}/{_ROUND}={r + 1}")
            finished(r + 1, sizes[r] + n_new)
            r += 1
        if ended and manifest is not None:
            manifest.done("finished", rounds=r)
    finally:
        # The adjacency can be as large as the window's transfers; nothing
        # reads it after the loop, unless the run may go on.
        if cached is not None:
            cached.unpersist()
        if wide is not None:
            wide.drop()
        if manifest is None or ended:
            delete_path(spark, adj_path)
            delete_path(spark, bucketed_path)
            for name in ("pairs", "lists", "places", "hubs"):
                delete_path(spark, f"{base}/graph/{name}")
    result.rounds = r


# ---- outputs of a finished trace ---------------------------------------------

def touching_rows(rows: DataFrame, result: TraceResult, cols, r: int | None = None) -> DataFrame:
    """Rows with any of ``cols`` in ``S(r-1)`` (the set that drove round ``r``,
    by default the last), each row once."""
    r = result.rounds if r is None else r
    if r == 0:
        return rows.limit(0)
    return semi.touching(rows, result.cards(r - 1), cols, result.known_rows(r - 1))


def pri_rows(rows: DataFrame, result: TraceResult, pri: str = PRI_COL,
             r: int | None = None) -> DataFrame:
    r = result.rounds if r is None else r
    if r == 0:
        return rows.limit(0)
    return semi.semi_join(rows, result.cards(r - 1), pri, result.known_rows(r - 1))


def rows_per_round(rows: DataFrame, result: TraceResult, cols) -> DataFrame:
    """Every round's matched rows in one pass, with a ``round`` column.

    A row is matched in round ``r`` when one of ``cols`` is in ``S(r-1)``:
    a seed for ``r = 1``, a card first reached in a round ``<= r-1`` for
    ``r >= 2`` (``S`` only grows from round 1). The first-reached rounds are
    looked up with one join per column, instead of one scan per round.
    """
    R = result.rounds
    if R == 0:
        return rows.limit(0).withColumn(_ROUND, F.lit(0))
    lk = result.lookup()
    # The lookup has at most |S(R)| + |seeds| rows: broadcast it under the bound.
    small = result.sizes[R] + result.seed_set_size <= broadcast_row_limit(rows.sparkSession)
    how = "inner" if len(cols) == 1 else "left"
    j = rows
    firsts, seeds_hit = [], []
    if not small and len(cols) > 1:
        # Beyond the bound: first the rows that some round matched (semi joins, which
        # runtime filters can reach), then look their first rounds up.
        matched = lk.filter(F.col("is_seed") | (F.col("first_round") <= R - 1)).select(CARD)
        rows = semi.touching(rows, matched, cols)
        j = rows
    for k, c in enumerate(cols):
        side = lk.select(F.col(CARD).alias(f"__k{k}"), F.col("first_round").alias(f"__f{k}"),
                         F.col("is_seed").alias(f"__s{k}"))
        j = j.join(F.broadcast(side) if small else side, F.col(c) == F.col(f"__k{k}"), how)
        firsts.append(F.col(f"__f{k}"))
        seeds_hit.append(F.coalesce(F.col(f"__s{k}"), F.lit(False)))
    first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    seed_hit = seeds_hit[0]
    for s in seeds_hit[1:]:
        seed_hit = seed_hit | s
    rounds = F.filter(F.sequence(F.lit(1), F.lit(R)),
                      lambda x: ((x == 1) & seed_hit) | ((x >= 2) & (first <= x - 1)))
    return j.select(*[rows[c] for c in rows.columns], F.explode(rounds).alias(_ROUND))


# ---- presets of the traced jobs ------------------------------------------------

def edge_rows(history: DataFrame, src: str, dest: str, window: Column,
              extra: Column | None = None) -> DataFrame:
    """Trimmed, non-blank (src, dest) rows of the window."""
    cond = window & P.nonblank(src, dest)
    if extra is not None:
        cond = cond & extra
    return history.filter(cond).select(F.trim(F.col(src)).alias(src),
                                       F.trim(F.col(dest)).alias(dest))


def preset_fixpoint(history, seeds, begin, end, src=OUT_COL, dest=IN_COL, **kw) -> TraceResult:
    """Half-open window, successful transactions, blank ends dropped, until the
    count stops changing."""
    rows = edge_rows(history, src, dest, P.date_window(begin, end, False), P.successful())
    return trace(rows, seeds, src, dest, max_rounds=None, **kw)


def preset_two_rounds(history, seeds, begin, end, src=IN_COL, dest=OUT_COL, **kw) -> TraceResult:
    """Half-open window, blank ends dropped, at most 2 rounds."""
    rows = edge_rows(history, src, dest, P.date_window(begin, end, False))
    return trace(rows, seeds, src, dest, max_rounds=2, **kw)


@dataclass
class EdgeTrace:
    result: TraceResult
    edges: DataFrame    # distinct (src, dest) touched in the last round


def preset_edges(history, seeds, begin, end, src=IN_COL, dest=OUT_COL,
                 max_rounds: int | None = 4, **kw) -> EdgeTrace:
    """Closed window, blank ends dropped, at most 4 rounds; keeps the last
    round's touched edges."""
    rows = edge_rows(history, src, dest, P.date_window(begin, end, True))
    res = trace(rows, seeds, src, dest, max_rounds=max_rounds, **kw)
    edges = touching_rows(rows, res, [src, dest]).select(src, dest).distinct()
    return EdgeTrace(res, edges)


@dataclass
class RowTrace:
    result: TraceResult
    consumption: DataFrame
    transfers: DataFrame


def traced_rows(history, begin, end, src=OUT_COL, dest=IN_COL,
                drop_blank: bool = False) -> DataFrame:
    """Closed window (either bound may be None), the 10 traced columns, src/dest
    trimmed. Blank ends are kept unless ``drop_blank`` (the jobs keep them, so a
    blank end spreads to every blank-ended row)."""
    cond = P.date_window(begin, end, True)
    if drop_blank:
        cond = cond & P.nonblank(src, dest)
    return (history.filter(cond)
            .select(*TRACED_COLUMNS, F.trim(F.col(src)).alias(src),
                    F.trim(F.col(dest)).alias(dest)))


def preset_all_rows(history, seeds, begin, end, src=OUT_COL, dest=IN_COL,
                    max_rounds: int | None = 5, drop_blank: bool = False, **kw) -> RowTrace:
    """All rows of the window (blank ends spread), at most 5 rounds; keeps the
    last round's consumption of the cards and its touching rows."""
    rows = traced_rows(history, begin, end, src, dest, drop_blank)
    res = trace(rows, seeds, src, dest, max_rounds=max_rounds, **kw)
    consumption = pri_rows(rows.filter(P.is_consumption()), res)
    transfers = touching_rows(rows, res, [src, dest])
    return RowTrace(res, consumption, transfers)


def preset_every_round(history, seeds, begin, end, src=OUT_COL, dest=IN_COL,
                       max_rounds: int | None = 4, drop_blank: bool = False, **kw) -> RowTrace:
    """As ``preset_all_rows`` with at most 4 rounds, keeping every round: all
    transactions of the cards and the touching rows, with a ``round`` column."""
    rows = traced_rows(history, begin, end, src, dest, drop_blank)
    res = trace(rows, seeds, src, dest, max_rounds=max_rounds, **kw)
    return RowTrace(res, rows_per_round(rows, res, [PRI_COL]),
                    rows_per_round(rows, res, [src, dest]))


__all__ = ["trace", "TraceResult", "adjacency", "expand", "touching_rows", "pri_rows",
           "rows_per_round", "WideAdjacency", "new_cards", "endpoints", "preset_fixpoint", "preset_two_rounds", "preset_edges",
           "preset_all_rows", "preset_every_round"]
