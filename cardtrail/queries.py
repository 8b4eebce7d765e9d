"""Registered queries over the driver's test tables: one per operator of the
survey's inventory. Each takes ``(spark, sf_dir)`` and returns a DataFrame whose
column names equal those of the matching SQL in ``oracle.py``.

Parameters are those of FIXTURES.md section 3: seeds/cards ``A1``..``A10``,
window 19970101 to 19970331. Every query scans the whole view (all of
``lineitem`` joined to ``orders``) under the window of the job it models.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .constants import CARD, IN_COL, OUT_COL, PRI_COL, TRACED_COLUMNS
from .functions import predicates as P
from .functions.digest import card_digest, card_message
from .functions.text import row_text
from .operators import semi, sets, summary
from .jobs import SearchArgs, parametric_trace
from .plans import closure, contraction, day_closure, two_round
from .session import scratch_path
from .sources.card_index import CardIndex
from .sources.cards import append_cards, cards_from_list, cards_from_text
from .sources.history import history_schema, register_history
from .sources.testdata import transaction_view
from .streaming import day_sums

# Query parameters of the fixtures.
CARDS = ["A1", "A2", "A3", "A4", "A5", "A6", "A7", "A8", "A9", "A10"]
BEGIN, END = "19970101", "19970331"
SECOND_RANGE = ("19980601", "19980615")
DIGEST_KEY = "demo-key"
SEGMENT = "BUILDING"
PREVIEW_ROWS = 50

Query = Callable[[SparkSession, str], DataFrame]


def _cards(spark: SparkSession) -> DataFrame:
    return cards_from_list(spark, CARDS)


def _view(spark, sf_dir, begin=BEGIN, end=END):
    """The view; the window only adds a pushed-down superset range."""
    return transaction_view(spark, sf_dir, begin, end)


def _closed(spark, sf_dir) -> DataFrame:
    """The view under the closed window, quoted-string form."""
    return _view(spark, sf_dir).filter(P.date_closed(BEGIN, END))


def _half_open(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir).filter(P.date_half_open(BEGIN, END))


def _traced(df: DataFrame, src: str, dest: str) -> DataFrame:
    """The 10-column traced projection with trimmed src/dest."""
    return df.select(*TRACED_COLUMNS, F.trim(F.col(src)).alias(src),
                     F.trim(F.col(dest)).alias(dest))


# ---- sources and projections -------------------------------------------------

def scan_project(spark, sf_dir):
    """P1 over the whole history: 10 columns, src/dest trimmed."""
    return _traced(transaction_view(spark, sf_dir), OUT_COL, IN_COL)


def scan_transfers(spark, sf_dir):
    """P2 with F2 + F5: amount, time and trimmed ends of non-blank transfers."""
    df = _closed(spark, sf_dir).filter(P.nonblank(IN_COL, OUT_COL))
    return df.select("trans_at", "loc_trans_tm", F.trim(IN_COL).alias(IN_COL),
                     F.trim(OUT_COL).alias(OUT_COL))


# ---- predicates --------------------------------------------------------------

def date_half_open(spark, sf_dir):
    return _half_open(spark, sf_dir)


def date_closed(spark, sf_dir):
    return _closed(spark, sf_dir)


def date_multi_range(spark, sf_dir):
    return (_view(spark, sf_dir, BEGIN, SECOND_RANGE[1])
            .filter(P.date_ranges([(BEGIN, END), SECOND_RANGE])))


def nonblank_ends(spark, sf_dir):
    return _closed(spark, sf_dir).filter(P.nonblank(IN_COL, OUT_COL))


def success_only(spark, sf_dir):
    return _closed(spark, sf_dir).filter(P.successful())


def success_nonblank(spark, sf_dir):
    return _closed(spark, sf_dir).filter(P.nonblank(IN_COL, OUT_COL) & P.successful())


def transfers_only(spark, sf_dir):
    return _closed(spark, sf_dir).filter(P.is_transfer())


def consumption_of_cards(spark, sf_dir):
    return semi.consumption_of(_closed(spark, sf_dir), _cards(spark), known_rows=len(CARDS))


def all_of_cards(spark, sf_dir):
    return semi.all_of(_closed(spark, sf_dir), _cards(spark), known_rows=len(CARDS))


def touching_cards(spark, sf_dir):
    """F10 on the traced projection (trimmed ends), each row once."""
    rows = _traced(_closed(spark, sf_dir), OUT_COL, IN_COL)
    return semi.touching(rows, _cards(spark), [IN_COL, OUT_COL], known_rows=len(CARDS))


def edges_touching(spark, sf_dir):
    """distinct (src, dest) of the edge list touching the cards."""
    edges = summary.edge_list(_closed(spark, sf_dir).filter(P.nonblank(IN_COL, OUT_COL)),
                              IN_COL, OUT_COL)
    return semi.touching(edges, _cards(spark), [IN_COL, OUT_COL], known_rows=len(CARDS))


def nonblank_untrimmed(spark, sf_dir):
    """F12 on the trimmed projection: not null and not empty."""
    rows = _traced(_closed(spark, sf_dir), OUT_COL, IN_COL)
    return rows.filter(P.not_null_nor_empty(IN_COL, OUT_COL))


# ---- joins -------------------------------------------------------------------

def semi_in(spark, sf_dir):
    return semi.semi_join(_closed(spark, sf_dir), _cards(spark), IN_COL, len(CARDS))


def semi_out(spark, sf_dir):
    return semi.semi_join(_closed(spark, sf_dir), _cards(spark), OUT_COL, len(CARDS))


def semi_pri(spark, sf_dir):
    return semi.semi_join(_closed(spark, sf_dir), _cards(spark), PRI_COL, len(CARDS))


def three_leg_extract(spark, sf_dir):
    return two_round.round0_extract(_closed(spark, sf_dir), _cards(spark), len(CARDS))


def three_leg_extract_union(spark, sf_dir):
    return two_round.round0_extract(_closed(spark, sf_dir), _cards(spark), len(CARDS),
                                    method="union")


def two_leg_expand(spark, sf_dir):
    t = two_round.run(_closed(spark, sf_dir), _cards(spark), len(CARDS))
    return t.round1_rows


# ---- aggregations and sets ---------------------------------------------------

def pair_amount_round0(spark, sf_dir):
    return two_round.run(_closed(spark, sf_dir), _cards(spark), len(CARDS), amount_type="bigint").round0_pairs


def pair_amount_round1(spark, sf_dir):
    return two_round.run(_closed(spark, sf_dir), _cards(spark), len(CARDS), amount_type="bigint").round1_pairs


def _in_cents(rows: DataFrame) -> DataFrame:
    """The same rows with amounts as decimal text, in units of a hundred."""
    units = F.col("trans_at").cast("decimal(28,0)") / F.lit(100).cast("decimal(3,0)")
    return rows.withColumn("trans_at", units.cast("decimal(28,2)").cast("string"))


def pair_amount_decimal(spark, sf_dir):
    """Round-0 pair amounts over amounts with decimals, summed exactly, as text."""
    pairs = two_round.run(_in_cents(_closed(spark, sf_dir)), _cards(spark), len(CARDS)).round0_pairs
    return pairs.withColumn("amount", summary.plain_amount("amount"))


def pair_amount_unreadable(spark, sf_dir):
    """How many decimal amounts of the extract don't fit whole numbers."""
    ext = two_round.run(_in_cents(_closed(spark, sf_dir)), _cards(spark), len(CARDS), amount_type="bigint")
    return ext.round0_unreadable


def transfer_cards_bag(spark, sf_dir):
    ext = two_round.round0_extract(_closed(spark, sf_dir), _cards(spark), len(CARDS))
    return sets.endpoint_bag(ext.filter(P.is_transfer()), [IN_COL, OUT_COL])


def transfer_cards(spark, sf_dir):
    return two_round.run(_closed(spark, sf_dir), _cards(spark), len(CARDS)).round0_cards


def suspect_cards(spark, sf_dir):
    return two_round.run(_closed(spark, sf_dir), _cards(spark), len(CARDS)).round1_cards


def suspect_card_count(spark, sf_dir):
    return two_round.run(_closed(spark, sf_dir), _cards(spark), len(CARDS)).suspect_count


def edge_list(spark, sf_dir):
    """A3 with F2 + F5 (closed window)."""
    df = _closed(spark, sf_dir).filter(P.nonblank(OUT_COL, IN_COL))
    return summary.edge_list(df, OUT_COL, IN_COL)


def edge_list_half_open(spark, sf_dir):
    df = _half_open(spark, sf_dir).filter(P.nonblank(OUT_COL, IN_COL))
    return summary.edge_list(df, OUT_COL, IN_COL)


def edge_list_successful(spark, sf_dir):
    df = _half_open(spark, sf_dir).filter(P.nonblank(OUT_COL, IN_COL) & P.successful())
    return summary.edge_list(df, OUT_COL, IN_COL)


def endpoint_set(spark, sf_dir):
    """U3 over the whole history's trimmed transfer ends (null kept once)."""
    rows = _traced(transaction_view(spark, sf_dir), OUT_COL, IN_COL)
    return sets.endpoint_set(rows, [OUT_COL, IN_COL])


def endpoint_count(spark, sf_dir):
    """A6 over the whole history: distinct non-null accounts at either end."""
    rows = _traced(transaction_view(spark, sf_dir), OUT_COL, IN_COL)
    return summary.distinct_count(sets.endpoint_bag(rows, [OUT_COL, IN_COL]))


# ---- functions and sinks -----------------------------------------------------

def _customer_cards(spark, sf_dir):
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return cust.select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias(CARD))


def card_digest_message(spark, sf_dir):
    return _customer_cards(spark, sf_dir).select(CARD, card_message(CARD).alias("message"))


def card_digest_q(spark, sf_dir):
    return _customer_cards(spark, sf_dir).select(CARD, card_digest(CARD, DIGEST_KEY).alias("digest"))


def row_text_q(spark, sf_dir):
    """K2: touching rows rendered as saved text lines."""
    rows = touching_cards(spark, sf_dir)
    return rows.select(row_text(rows).alias("line"))


def preview_ordered(spark, sf_dir):
    """K8 made comparable: the first 50 consumption rows of the window in a
    total order."""
    rows = _traced(_closed(spark, sf_dir).filter(P.is_consumption()), OUT_COL, IN_COL)
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in rows.columns]).limit(PREVIEW_ROWS)


# ---- the iterative operator --------------------------------------------------

def trace_fixpoint(spark, sf_dir):
    return closure.preset_fixpoint(_view(spark, sf_dir, BEGIN, END), _cards(spark),
                                   BEGIN, END).cards()


def trace_fixpoint_sizes(spark, sf_dir):
    return closure.preset_fixpoint(_view(spark, sf_dir, BEGIN, END), _cards(spark),
                                   BEGIN, END).sizes_df()


def trace_2_rounds(spark, sf_dir):
    return closure.preset_two_rounds(_view(spark, sf_dir, BEGIN, END), _cards(spark),
                                     BEGIN, END).cards()


def trace_closed_fixpoint(spark, sf_dir):
    """Closed window, blank ends dropped, to the fixed point."""
    r = closure.preset_edges(_view(spark, sf_dir), _cards(spark), BEGIN, END, max_rounds=None)
    return r.result.cards()


def trace_edges_4(spark, sf_dir):
    return closure.preset_edges(_view(spark, sf_dir), _cards(spark), BEGIN, END).edges


def trace_consume_5(spark, sf_dir):
    return closure.preset_all_rows(_view(spark, sf_dir), _cards(spark), BEGIN, END).consumption


def trace_transfer_5(spark, sf_dir):
    return closure.preset_all_rows(_view(spark, sf_dir), _cards(spark), BEGIN, END).transfers


def frontier_sizes(spark, sf_dir):
    return closure.preset_all_rows(_view(spark, sf_dir), _cards(spark), BEGIN, END).result.sizes_df()


def trace_rounds_consume(spark, sf_dir):
    return closure.preset_every_round(_view(spark, sf_dir), _cards(spark), BEGIN, END).consumption


def trace_rounds_transfer(spark, sf_dir):
    return closure.preset_every_round(_view(spark, sf_dir), _cards(spark), BEGIN, END).transfers


def frontier_first_round(spark, sf_dir):
    """Each card reached by the closed 5-round trace with the round it entered."""
    return closure.preset_all_rows(_view(spark, sf_dir), _cards(spark), BEGIN, END).result.frontier


def trace_history_fixpoint(spark, sf_dir):
    """The whole history, blank ends dropped, to the fixed point."""
    r = closure.preset_edges(transaction_view(spark, sf_dir), _cards(spark), None, None,
                             max_rounds=None)
    return r.result.cards()


def trace_history_sizes(spark, sf_dir):
    r = closure.preset_edges(transaction_view(spark, sf_dir), _cards(spark), None, None,
                             max_rounds=None)
    return r.result.sizes_df()


def trace_history_transfers(spark, sf_dir):
    """The whole history, blank ends kept, 5 rounds: the last round's touching rows."""
    return closure.preset_all_rows(transaction_view(spark, sf_dir), _cards(spark),
                                   None, None).transfers


def pair_amount_round0_set(spark, sf_dir):
    """Round-0 pair amounts with each matched row counted once."""
    return two_round.run(_closed(spark, sf_dir), _cards(spark), len(CARDS),
                         semantics="set", amount_type="bigint").round0_pairs


def _segment_cards(spark, sf_dir) -> DataFrame:
    """Every account of one market segment: a card list that grows with the
    tables and whose size is not known in advance (no broadcast hint; AQE
    decides from measured sizes, and the touching test takes its skew-safe
    semi/anti legs)."""
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return (cust.filter(F.col("c_mktsegment") == SEGMENT)
            .select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias(CARD)))


def touching_segment_cards(spark, sf_dir):
    rows = _traced(_closed(spark, sf_dir), OUT_COL, IN_COL)
    return semi.touching(rows, _segment_cards(spark, sf_dir), [IN_COL, OUT_COL])


def extract_segment_cards(spark, sf_dir):
    return two_round.round0_extract(_closed(spark, sf_dir), _segment_cards(spark, sf_dir))


def trace_segment_fixpoint(spark, sf_dir):
    """The whole segment's cards, blank ends dropped, to the fixed point."""
    r = closure.preset_edges(_view(spark, sf_dir), _segment_cards(spark, sf_dir), BEGIN, END, max_rounds=None)
    return r.result.cards()


def trace_segment_rounds_transfer(spark, sf_dir):
    """Every round's touching rows from the whole segment's cards."""
    return closure.preset_every_round(_view(spark, sf_dir), _segment_cards(spark, sf_dir), BEGIN, END).transfers


def _equal_count_seeds(spark, sf_dir) -> DataFrame:
    """As many cards as the first round reaches from one edge's two ends: the count
    stop ends the trace after round 1 although the sets differ."""
    edges = summary.edge_list(_closed(spark, sf_dir).filter(P.nonblank(OUT_COL, IN_COL)), OUT_COL, IN_COL)
    bag = sets.endpoint_bag(edges, [OUT_COL, IN_COL])
    once = bag.groupBy(CARD).count().filter("count = 1")
    lonely = (edges.join(once.withColumnRenamed(CARD, "__o"), F.col(OUT_COL) == F.col("__o"), "left_semi")
              .join(once.withColumnRenamed(CARD, "__i"), F.col(IN_COL) == F.col("__i"), "left_semi"))
    first = lonely.agg(F.min(OUT_COL).alias(CARD))
    return first.unionAll(first.select(F.lit("no such card").alias(CARD)))


def trace_early_stop(spark, sf_dir):
    """A trace that the count stop ends in round 1."""
    return closure.preset_edges(_view(spark, sf_dir), _equal_count_seeds(spark, sf_dir), BEGIN, END,
                                max_rounds=None).result.cards()


def closure_by_contraction(spark, sf_dir):
    """As ``trace_closed_fixpoint``, by contracting the graph."""
    return contraction.preset_reach(_view(spark, sf_dir), _cards(spark), BEGIN, END)


def history_by_contraction(spark, sf_dir):
    """As ``trace_history_fixpoint``, by contracting the graph."""
    return contraction.preset_reach(transaction_view(spark, sf_dir), _cards(spark), None, None)


def trace_lists_fixpoint(spark, sf_dir):
    """As ``trace_fixpoint``, over numbered cards and neighbour lists."""
    return closure.preset_fixpoint(_view(spark, sf_dir), _cards(spark), BEGIN, END, layout="lists").cards()


def trace_lists_rounds_transfer(spark, sf_dir):
    """As ``trace_rounds_transfer``, over numbered cards and neighbour lists."""
    return closure.preset_every_round(_view(spark, sf_dir), _cards(spark), BEGIN, END, layout="lists").transfers


def trace_resumed_sizes(spark, sf_dir):
    """As ``trace_history_sizes``: a run kept on record, ended after three rounds and taken
    up again."""
    path = scratch_path(spark, "run")
    for rounds in (3, None):
        r = closure.preset_edges(transaction_view(spark, sf_dir), _cards(spark), None, None, max_rounds=rounds, run_path=path)
    return r.result.sizes_df()


# ---- stored tables and files ---------------------------------------------------

def _table_name(kind: str) -> str:
    return f"ct_{kind}_{uuid.uuid4().hex}"


def _kept(spark, name: str) -> DataFrame:
    """The rows of a catalog table, copied to a folder; the table is dropped."""
    path = scratch_path(spark, "kept")
    table = spark.table(name)
    table.write.parquet(path)
    sinks.drop_table(spark, name)
    return spark.read.schema(table.schema).parquet(path)


def insert_overwrite(spark, sf_dir):
    """K1: consumption rows of the cards replace, by position, what a delimited
    table held; its columns and format stay."""
    name = _table_name("k1")
    columns = ["card", "kind", "amount", "day"]
    spark.sql(f"CREATE TABLE {name} ({', '.join(c + ' STRING' for c in columns)}) USING csv OPTIONS (sep '\t')")
    rows = _closed(spark, sf_dir)
    sinks.save_table(rows.filter(P.is_transfer()).select(PRI_COL, "trans_id", "trans_at", "pdate"), name)
    sinks.save_table(rows.filter(P.successful()).select(PRI_COL, "trans_id", "trans_at", "pdate"), name)
    return _kept(spark, name)


REPLACED_DAY = "19970214"


def insert_overwrite_partition(spark, sf_dir):
    """K1, one day: of a table of transfers by day, one day's partition is rewritten with
    the day's successful rows of all kinds; the other days stay."""
    name = _table_name("k1p")
    columns = [PRI_COL, "trans_id", "trans_at", "pdate"]
    spark.sql(f"CREATE TABLE {name} ({', '.join(c + ' STRING' for c in columns)}) USING parquet PARTITIONED BY (pdate)")
    rows = _closed(spark, sf_dir)
    sinks.save_table(rows.filter(P.is_transfer()).select(*columns), name)
    sinks.replace_partitions(rows.filter(P.successful() & (F.col("pdate") == REPLACED_DAY)).select(*columns), name)
    return _kept(spark, name)


def _history_tree(spark, sf_dir) -> str:
    path = scratch_path(spark, "history")
    _closed(spark, sf_dir).repartition("pdate").write.partitionBy("pdate").parquet(path)
    return path


def registered_history(spark, sf_dir):
    """S1, K4: a window of an external table over a tree of day folders; the table is
    dropped, its files stay and are read once more."""
    name, path = _table_name("s1"), _history_tree(spark, sf_dir)
    names = _closed(spark, sf_dir).columns
    table = register_history(spark, name, path, names).filter(P.date_closed(WEEK[0], WEEK[1])).select(*names)
    kept = scratch_path(spark, "window")
    table.write.parquet(kept)
    sinks.drop_table(spark, name)
    return spark.read.schema(table.schema).parquet(kept)


WEEK = ("19970203", "19970209")


def three_leg_extract_indexed(spark, sf_dir):
    """J1 to J4 by the card index: the extract of the listed cards from a tree of day
    folders, of which only the files that the index names are opened."""
    path = _history_tree(spark, sf_dir)
    view = _closed(spark, sf_dir)
    index = CardIndex(spark, path, scratch_path(spark, "index"), view.schema)
    index.update()
    return index.extract(_cards(spark), len(CARDS)).select(*view.columns)


def row_text_readback(spark, sf_dir):
    """K2 read back: the touching rows saved as text and parsed, with the parser's status."""
    path = scratch_path(spark, "row-text")
    rows = touching_cards(spark, sf_dir)
    sinks.write_row_text(rows, path)
    account, digits = "[A-Za-z0-9 ]", "[0-9]"
    kinds = dict(zip(rows.columns, [account, "[A-Z0-9]", digits, digits, digits, account, "[A-Z]", digits, account, account]))
    return sinks.read_row_text(spark, path, {c: f"{k}|null" for c, k in kinds.items()})


def row_text_ambiguous(spark, sf_dir):
    """How many lines of each status the parser finds where two values next to each other
    may hold commas: accounts ending in 1 get one."""
    rows = touching_cards(spark, sf_dir)
    comma = lambda c: F.when(F.col(c).endswith("1"), F.concat(F.col(c), F.lit(","))).otherwise(F.col(c)).alias(c)
    path = scratch_path(spark, "row-text")
    sinks.write_row_text(rows.select("trans_at", comma(OUT_COL), comma(IN_COL)), path)
    parsed = sinks.read_row_text(spark, path, {"trans_at": "[0-9]", OUT_COL: "[A-Za-z0-9 ,]", IN_COL: "[A-Za-z0-9 ,]"})
    return parsed.groupBy("status").agg(F.count("*").alias("n"))


def closure_by_days(spark, sf_dir):
    """I5, I6: the first rounds of the closed window's closure, its transfers taken in month
    by month."""
    days = day_closure.DayClosure(spark, scratch_path(spark, "days"), _cards(spark))
    rows = _closed(spark, sf_dir).filter(P.nonblank(IN_COL, OUT_COL))
    edges = scratch_path(spark, "edges")
    rows.select(F.trim(IN_COL).alias(IN_COL), F.trim(OUT_COL).alias(OUT_COL), F.substring("pdate", 1, 6).alias("month")).write.partitionBy("month").parquet(edges)
    kept = spark.read.schema(f"{IN_COL} string, {OUT_COL} string, month string").parquet(edges)
    for month in (f"{BEGIN[:4]}{m:02d}" for m in range(int(BEGIN[4:6]), int(END[4:6]) + 1)):
        days.add(month, kept.filter(F.col("month") == month), IN_COL, OUT_COL)
    return days.frontier()


def pair_amount_by_days(spark, sf_dir):
    """A1 as a stream: the round-0 transfers arrive in files, are summed by day and batch,
    one batch is replayed, and the sums are added up."""
    source, state, progress = (scratch_path(spark, n) for n in ("arriving", "day-sums", "progress"))
    ext = two_round.round0_extract(_closed(spark, sf_dir), _cards(spark), len(CARDS)).select(IN_COL, OUT_COL, "trans_id", "trans_at", "pdate")
    ext.repartition(3, "pdate").write.parquet(source)
    sums = day_sums.DaySums(spark, state)
    day_sums.sum_stream(spark, source, ext.schema, sums, progress, keep=P.is_transfer(), max_files=1).awaitTermination()
    return sums.totals().withColumn("amount", F.col("amount").cast("bigint"))


def pair_amount_five_decimals(spark, sf_dir):
    """Round-0 pair amounts over amounts with five decimals, summed exactly, as text."""
    small = F.col("trans_at").cast("decimal(28,0)") / F.lit(100_000).cast("decimal(6,0)")
    rows = _closed(spark, sf_dir).withColumn("trans_at", small.cast("decimal(28,5)").cast("string"))
    pairs = two_round.run(rows, _cards(spark), len(CARDS)).round0_pairs
    return pairs.withColumn("amount", summary.plain_amount("amount"))


def trace_from_arguments(spark, sf_dir):
    """S4, S7: the parametric trace from its six text arguments, over a registered table."""
    name = _table_name("args")
    _view(spark, sf_dir).createOrReplaceTempView(name)
    args = SearchArgs.parse([BEGIN, END, name, OUT_COL, IN_COL, ",".join(CARDS) + ","])
    out = scratch_path(spark, "arguments")
    parametric_trace(spark, args, out)
    spark.catalog.dropTempView(name)
    return spark.read.schema(f"{CARD} string").parquet(f"{out}/cards")


def delimited_roundtrip(spark, sf_dir):
    """K5, K7: the round-0 pair amounts through an unquoted tab-delimited file."""
    path = scratch_path(spark, "tabs")
    pairs = pair_amount_round0(spark, sf_dir)
    sinks.write_delimited(pairs, path)
    back = sinks.read_delimited(spark, path, pairs.columns)
    return back.withColumn("amount", F.col("amount").cast("bigint"))


WIDE = 256


def create_if_absent(spark, sf_dir):
    """K4: a table of 256 string columns, created once, filled with the touching rows;
    the columns that they don't have stay null. Reads back four columns and the width."""
    name = _table_name("k4")
    rows = _closed(spark, sf_dir).filter(P.is_transfer())
    names = rows.columns + [f"extra_{i}" for i in range(len(rows.columns), WIDE)]
    sinks.ensure_table(spark, name, history_schema(names))
    if sinks.ensure_table(spark, name, history_schema(names[:1])):
        raise AssertionError("the table was created twice")
    full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names])
    sinks.save_table(full, name)
    table = _kept(spark, name)
    return table.select(PRI_COL, OUT_COL, IN_COL, f"extra_{WIDE - 1}", F.lit(len(table.columns)).alias("n_columns"))


def drop_and_recreate(spark, sf_dir):
    """K6: a dropped table is gone; a new one of the name holds only its own rows."""
    name = _table_name("k6")
    sinks.save_table(_customer_cards(spark, sf_dir), name)
    sinks.drop_table(spark, name)
    sinks.drop_table(spark, name)
    sinks.ensure_table(spark, name, history_schema([CARD]))
    sinks.save_table(_segment_cards(spark, sf_dir), name, overwrite=False)
    return _kept(spark, name)


def text_seeds(spark, sf_dir):
    """S2: a card list through a text file, one card a line."""
    path = scratch_path(spark, "seeds")
    _segment_cards(spark, sf_dir).write.text(path)
    return cards_from_text(spark, path)


def appended_cards(spark, sf_dir):
    """S3: a card list appended to a stored one."""
    path = scratch_path(spark, "listed")
    append_cards(_segment_cards(spark, sf_dir), path)
    append_cards(_customer_cards(spark, sf_dir), path)
    return spark.read.parquet(path)


def rows_round1_readback(spark, sf_dir):
    """S6: the round-1 rows written once and read back, as the two-rounds job does."""
    t = two_round.run(_closed(spark, sf_dir), _cards(spark), len(CARDS), rows_path=scratch_path(spark, "rows1"))
    return t.round1_rows


def trace_segment_2_rounds(spark, sf_dir):
    return closure.preset_two_rounds(_view(spark, sf_dir), _segment_cards(spark, sf_dir),
                                     BEGIN, END).cards()


QUERIES: dict[str, Query] = {
    "scan_project": scan_project,
    "scan_transfers": scan_transfers,
    "date_half_open": date_half_open,
    "date_closed": date_closed,
    "date_multi_range": date_multi_range,
    "nonblank_ends": nonblank_ends,
    "success_only": success_only,
    "success_nonblank": success_nonblank,
    "transfers_only": transfers_only,
    "nonblank_untrimmed": nonblank_untrimmed,
    "consumption_of_cards": consumption_of_cards,
    "all_of_cards": all_of_cards,
    "touching_cards": touching_cards,
    "edges_touching": edges_touching,
    "semi_in": semi_in,
    "semi_out": semi_out,
    "semi_pri": semi_pri,
    "three_leg_extract": three_leg_extract,
    "three_leg_extract_union": three_leg_extract_union,
    "two_leg_expand": two_leg_expand,
    "pair_amount_round0": pair_amount_round0,
    "pair_amount_round1": pair_amount_round1,
    "transfer_cards_bag": transfer_cards_bag,
    "transfer_cards": transfer_cards,
    "suspect_cards": suspect_cards,
    "suspect_card_count": suspect_card_count,
    "edge_list": edge_list,
    "edge_list_half_open": edge_list_half_open,
    "edge_list_successful": edge_list_successful,
    "endpoint_set": endpoint_set,
    "endpoint_count": endpoint_count,
    "card_digest_message": card_digest_message,
    "card_digest": card_digest_q,
    "row_text": row_text_q,
    "preview_ordered": preview_ordered,
    "trace_fixpoint": trace_fixpoint,
    "trace_fixpoint_sizes": trace_fixpoint_sizes,
    "trace_2_rounds": trace_2_rounds,
    "trace_closed_fixpoint": trace_closed_fixpoint,
    "trace_edges_4": trace_edges_4,
    "trace_consume_5": trace_consume_5,
    "trace_transfer_5": trace_transfer_5,
    "frontier_sizes": frontier_sizes,
    "frontier_first_round": frontier_first_round,
    "trace_rounds_consume": trace_rounds_consume,
    "trace_rounds_transfer": trace_rounds_transfer,
    "trace_history_fixpoint": trace_history_fixpoint,
    "trace_history_sizes": trace_history_sizes,
    "trace_history_transfers": trace_history_transfers,
    "pair_amount_round0_set": pair_amount_round0_set,
    "touching_segment_cards": touching_segment_cards,
    "extract_segment_cards": extract_segment_cards,
    "trace_segment_2_rounds": trace_segment_2_rounds,
    "trace_segment_fixpoint": trace_segment_fixpoint,
    "trace_segment_rounds_transfer": trace_segment_rounds_transfer,
    "trace_early_stop": trace_early_stop,
    "pair_amount_decimal": pair_amount_decimal,
    "pair_amount_unreadable": pair_amount_unreadable,
    "insert_overwrite": insert_overwrite,
    "delimited_roundtrip": delimited_roundtrip,
    "create_if_absent": create_if_absent,
    "drop_and_recreate": drop_and_recreate,
    "text_seeds": text_seeds,
    "appended_cards": appended_cards,
    "rows_round1_readback": rows_round1_readback,
}


def trace_closed_fixpoint_full(spark, sf_dir):
    """As ``trace_closed_fixpoint`` with the reference's full-frontier probe."""
    r = closure.preset_edges(_view(spark, sf_dir), _cards(spark), BEGIN, END, max_rounds=None,
                             method="full")
    return r.result.cards()


for _q in (trace_closed_fixpoint_full, closure_by_contraction, history_by_contraction, trace_lists_fixpoint, trace_lists_rounds_transfer, trace_resumed_sizes,
           insert_overwrite_partition, registered_history, three_leg_extract_indexed, row_text_readback, row_text_ambiguous, closure_by_days, pair_amount_by_days,
           pair_amount_five_decimals, trace_from_arguments):
    QUERIES[_q.__name__] = _q
