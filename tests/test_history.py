"""A pdate-partitioned history read through ``read_history``: the window is
partition pruning, and results equal the view-based queries."""

import tempfile

from cardtrail.constants import IN_COL, OUT_COL
from cardtrail.plans import closure, two_round
from cardtrail.queries import BEGIN, CARDS, END
from cardtrail.sources.cards import cards_from_list
from cardtrail.sources.history import history_schema, read_history
from cardtrail.sources.testdata import transaction_view

from .conftest import SF001


def test_partitioned_history_prunes_and_matches(spark):
    tmp = tempfile.mkdtemp(prefix="ct-hist-")
    view = transaction_view(spark, SF001)
    # One quarter of the history is enough to show pruning against its neighbours.
    view.filter("pdate >= '19961201' AND pdate <= '19970430'").write.partitionBy("pdate") \
        .parquet(f"{tmp}/history")
    hist = read_history(spark, f"{tmp}/history", BEGIN, END)
    assert hist.schema["pdate"].dataType.simpleString() == "string"
    typed = read_history(spark, f"{tmp}/history", BEGIN, END, schema=view.schema)
    assert typed.count() == hist.count()
    plan = hist._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pdate" in plan and "19970101" in plan
    cards = cards_from_list(spark, CARDS)
    got = two_round.run(hist, cards, len(CARDS)).round0_pairs
    want = two_round.run(view.filter(f"pdate >= '{BEGIN}' AND pdate <= '{END}'"), cards,
                         len(CARDS)).round0_pairs
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    a = closure.preset_edges(read_history(spark, f"{tmp}/history"), cards, BEGIN, END)
    b = closure.preset_edges(view, cards, BEGIN, END)
    assert a.result.sizes == b.result.sizes == [10, 25, 55, 119, 200]
    assert a.edges.count() == b.edges.count() == 203


def test_history_schema_is_all_strings():
    sch = history_schema(["pri_key", IN_COL, OUT_COL, "pdate"])
    assert [f.name for f in sch.fields] == ["pri_key", IN_COL, OUT_COL, "pdate"]
    assert {f.dataType.simpleString() for f in sch.fields} == {"string"}
