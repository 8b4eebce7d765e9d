"""DuckDB SQL oracles, one per registered query, written from the definitions
(not from the Spark plans): semi joins as ``IN (subquery)``, bags as
``UNION ALL``, the closure as a recursive CTE.

Closure oracles: ``adj2`` is the adjacency with a self loop on every
non-null endpoint, so ``S(k+1) = {b : (a, b) in adj2, a in S(k)}``. A
recursive CTE with ``UNION`` over ``(card, depth)`` makes depth ``k`` hold all
of ``S(k)``; without the depth it reaches the fixed point. First rounds for
unbounded traces come from a breadth-first search keyed by card.
"""

from __future__ import annotations

from .functions.digest import pads_hex
from .queries import BEGIN, CARDS, DIGEST_KEY, END, PREVIEW_ROWS, REPLACED_DAY, SECOND_RANGE, SEGMENT, WEEK
from .sources.testdata import VIEW_SQL

IN, OUT, PRI = "tfr_in_acct_no", "tfr_out_acct_no", "pri_acct_no_conv"
TRACED = ("pri_acct_no_conv, trans_id, trans_at, pdate, loc_trans_tm, acpt_ins_id_cd, "
          "trans_md, cross_dist_in")
ALL_COLS = ("pri_key, trans_id, pri_acct_no_conv, tfr_out_acct_no, tfr_in_acct_no, trans_at, "
            "loc_trans_tm, acpt_ins_id_cd, trans_md, cross_dist_in, resp_cd1, cu_trans_st, "
            "sti_takeout_in, pdate")

TX = f"tx AS ({VIEW_SQL})"
CARDS_CTE = ("cards AS (SELECT * FROM (VALUES "
             + ", ".join(f"('{c}')" for c in CARDS) + ") t(card))")
SEGMENT_CTE = ("cards AS (SELECT 'A' || CAST(c_custkey AS VARCHAR) AS card FROM customer "
               f"WHERE c_mktsegment = '{SEGMENT}')")
CLOSED = f"pdate >= '{BEGIN}' AND pdate <= '{END}'"
HALF = f"pdate >= '{BEGIN}' AND pdate < '{END}'"
NONBLANK = f"trim({IN}) <> '' AND trim({OUT}) <> ''"
SUCCESS = "sti_takeout_in = '1' AND cu_trans_st = '10000' AND resp_cd1 = '00'"
CONSUMPTION = "trans_id <> 'S25' AND trans_id <> 'S33'"


def _with(*ctes: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


def _traced(where: str, src: str = OUT, dest: str = IN) -> str:
    return (f"SELECT {TRACED}, trim({src}) AS {src}, trim({dest}) AS {dest} "
            f"FROM tx WHERE {where}")


def _three_leg(where: str) -> str:
    legs = [f"SELECT {ALL_COLS} FROM tx WHERE {where} AND {c} IN (SELECT card FROM cards)"
            for c in (IN, OUT, PRI)]
    return "\nUNION ALL\n".join(legs)


# ---- the two rounds ------------------------------------------------------------

EXT = f"ext AS ({_three_leg(CLOSED)})"
C0 = (f"c0 AS (SELECT DISTINCT card FROM (SELECT {IN} AS card FROM ext WHERE trans_id = 'S33' "
      f"UNION ALL SELECT {OUT} AS card FROM ext WHERE trans_id = 'S33') t)")
R1 = (f"r1 AS (SELECT {IN}, {OUT}, trans_at FROM tx WHERE {CLOSED} AND trans_id = 'S33' "
      f"AND {IN} IN (SELECT card FROM c0) "
      f"UNION ALL SELECT {IN}, {OUT}, trans_at FROM tx WHERE {CLOSED} AND trans_id = 'S33' "
      f"AND {OUT} IN (SELECT card FROM c0))")
C1 = (f"c1 AS (SELECT DISTINCT card FROM (SELECT {IN} AS card FROM r1 "
      f"UNION ALL SELECT {OUT} AS card FROM r1) t)")
TWO = (TX, CARDS_CTE, EXT, C0, R1, C1)


def _pairs(src_table: str, where: str = "TRUE") -> str:
    return (f"SELECT {IN}, {OUT}, CAST(SUM(TRY_CAST(trans_at AS BIGINT)) AS BIGINT) AS amount "
            f"FROM {src_table} WHERE {where} GROUP BY {IN}, {OUT}")


# ---- closure building blocks ---------------------------------------------------

def _graph(where: str, src: str, dest: str, nonblank: bool) -> list[str]:
    cond = where + (f" AND trim({src}) <> '' AND trim({dest}) <> ''" if nonblank else "")
    return [
        f"edges AS (SELECT DISTINCT trim({src}) AS s, trim({dest}) AS d FROM tx WHERE {cond})",
        "adj AS (SELECT s AS a, d AS b FROM edges WHERE s IS NOT NULL "
        "UNION ALL SELECT d AS a, s AS b FROM edges WHERE d IS NOT NULL)",
        "adj2 AS (SELECT a, b FROM adj UNION ALL SELECT DISTINCT a, a FROM adj)",
        "s1 AS (SELECT DISTINCT b AS card FROM adj2 WHERE a IN (SELECT card FROM cards))",
    ]


def _depth(k: int) -> str:
    """r(card, d): all of S(d) for d = 1..k."""
    return ("r(card, d) AS (SELECT card, 1 FROM s1 UNION "
            f"SELECT adj2.b, r.d + 1 FROM r JOIN adj2 ON adj2.a = r.card WHERE r.d < {k})")


FIX = ("f(card) AS (SELECT card FROM s1 UNION "
       "SELECT adj2.b FROM f JOIN adj2 ON adj2.a = f.card)")


# S(R-1), the set that drove the last executed round R (``stop.last``): the
# seeds when R = 1, else depth R-1 of ``r``.
LAST = ("(SELECT card FROM r WHERE d = (SELECT last FROM stop) - 1 "
        "UNION ALL SELECT card FROM cards WHERE (SELECT last FROM stop) = 1)")


def _bounded_sizes(k: int) -> str:
    """Sizes of rounds 0..R, where R stops at k or at the first equal count."""
    return (
        "sz AS (SELECT 0 AS round, (SELECT count(*) FROM cards) AS n_cards "
        "UNION ALL SELECT d AS round, count(*) AS n_cards FROM r GROUP BY d), "
        "lagged AS (SELECT round, n_cards, lag(n_cards) OVER (ORDER BY round) AS prev FROM sz), "
        f"stop AS (SELECT coalesce(min(round), {k}) AS last FROM lagged WHERE n_cards = prev)")


def _bfs_first_rounds() -> list[str]:
    """fr(card, round): first round of each reached card, for an unbounded trace."""
    return [
        "bfs(card, d) USING KEY (card) AS (SELECT DISTINCT card, 0 FROM cards UNION "
        "SELECT adj.b, bfs.d + 1 FROM bfs JOIN adj ON adj.a = bfs.card "
        "WHERE adj.b IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM recurring.bfs q WHERE q.card = adj.b))",
        "fr AS (SELECT card, greatest(d, 1) AS round FROM bfs "
        "WHERE card IN (SELECT a FROM adj) "
        "UNION ALL SELECT NULL AS card, min(bfs.d) + 1 AS round FROM bfs JOIN adj "
        "ON adj.a = bfs.card WHERE adj.b IS NULL HAVING count(*) > 0)",
    ]


def _fix_sizes(graph: list[str] | None = None) -> str:
    graph = graph or _graph(HALF + f" AND {SUCCESS}", OUT, IN, True)
    return _with(
        TX, CARDS_CTE, *graph, *_bfs_first_rounds(),
        "rounds AS (SELECT CAST(range AS INTEGER) AS round FROM "
        "range(1, (SELECT max(round) FROM fr) + 2))",
        "sz AS (SELECT 0 AS round, (SELECT count(*) FROM cards) AS n_cards UNION ALL "
        "SELECT rounds.round, (SELECT count(*) FROM fr WHERE fr.round <= rounds.round) "
        "FROM rounds)",
        "lagged AS (SELECT round, n_cards, lag(n_cards) OVER (ORDER BY round) AS prev FROM sz)",
        "stop AS (SELECT min(round) AS last FROM lagged WHERE n_cards = prev)",
        body="SELECT CAST(round AS INTEGER) AS round, CAST(n_cards AS BIGINT) AS n_cards "
             "FROM sz WHERE round <= (SELECT last FROM stop)",
        recursive=True)


def _every_round(kind: str, cards: str = CARDS_CTE) -> str:
    """Rows of each round 1..4 of the closed all-rows trace, with ``round``."""
    rows = f"rows AS ({_traced(CLOSED)})"
    member = ("m AS (SELECT card, 1 AS round FROM cards UNION "
              "SELECT card, d + 1 AS round FROM r WHERE d <= 3)")
    ctes = [TX, cards, *_graph(CLOSED, OUT, IN, False), _depth(4), _bounded_sizes(4), rows,
            member]
    cols = f"{TRACED}, {OUT}, {IN}"
    if kind == "pri":
        body = (f"SELECT {', '.join('rows.' + c.strip() for c in cols.split(','))}, "
                "CAST(m.round AS INTEGER) AS round FROM rows JOIN m ON rows.pri_acct_no_conv = m.card "
                "WHERE m.round <= (SELECT last FROM stop)")
        return _with(*ctes, body=body, recursive=True)
    ctes.append("ids AS (SELECT row_number() OVER () AS rid, * FROM rows)")
    ctes.append("hits AS (SELECT DISTINCT rid, round FROM ("
                f"SELECT rid, m.round FROM ids JOIN m ON ids.{OUT} = m.card UNION ALL "
                f"SELECT rid, m.round FROM ids JOIN m ON ids.{IN} = m.card) t "
                "WHERE round <= (SELECT last FROM stop))")
    body = (f"SELECT {', '.join('ids.' + c.strip() for c in cols.split(','))}, "
            "CAST(hits.round AS INTEGER) AS round FROM ids JOIN hits ON ids.rid = hits.rid")
    return _with(*ctes, body=body, recursive=True)


def _digest_sql() -> str:
    ipad, opad = pads_hex(DIGEST_KEY)
    msg = "reverse(CAST(length(card) AS VARCHAR) || card)"
    return (f"SELECT card, md5(unhex('{opad}') || unhex(md5(unhex('{ipad}') || encode({msg})))) "
            "AS digest FROM (SELECT 'A' || CAST(c_custkey AS VARCHAR) AS card FROM customer) t")


def _row_text() -> str:
    cols = [c.strip() for c in TRACED.split(",")] + [OUT, IN]
    parts = " || ',' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in cols)
    return _with(TX, CARDS_CTE, f"rows AS ({_traced(CLOSED)})",
                 body=f"SELECT '[' || {parts} || ']' AS line FROM rows "
                      f"WHERE {IN} IN (SELECT card FROM cards) OR {OUT} IN (SELECT card FROM cards)")


def _preview() -> str:
    cols = [c.strip() for c in TRACED.split(",")] + [OUT, IN]
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in cols)
    return _with(TX, body=f"SELECT * FROM ({_traced(CLOSED + ' AND ' + CONSUMPTION)}) t "
                          f"ORDER BY {order} LIMIT {PREVIEW_ROWS}")


#: Queries that compute in another way what another one computes.
SAME_AS = {
    "closure_by_contraction": "trace_closed_fixpoint", "history_by_contraction": "trace_history_fixpoint",
    "trace_lists_fixpoint": "trace_fixpoint", "trace_lists_rounds_transfer": "trace_rounds_transfer", "trace_resumed_sizes": "trace_history_sizes",
    "pair_amount_by_days": "pair_amount_round0", "trace_from_arguments": "trace_fixpoint",
    "three_leg_extract_indexed": "three_leg_extract",
}


def oracle_sql() -> dict[str, str]:
    found = _own_sql()
    return found | {name: found[other] for name, other in SAME_AS.items()}


def _own_sql() -> dict[str, str]:
    g_half_ok = _graph(HALF + f" AND {SUCCESS}", OUT, IN, True)
    g_half = _graph(HALF, IN, OUT, True)
    g_closed_nb = _graph(CLOSED, IN, OUT, True)
    g_closed_all = _graph(CLOSED, OUT, IN, False)
    b0, e0 = SECOND_RANGE
    return {
        "scan_project": _with(TX, body=_traced("TRUE")),
        "scan_transfers": _with(TX, body=(
            f"SELECT trans_at, loc_trans_tm, trim({IN}) AS {IN}, trim({OUT}) AS {OUT} "
            f"FROM tx WHERE {CLOSED} AND {NONBLANK}")),
        "date_half_open": _with(TX, body=f"SELECT * FROM tx WHERE {HALF}"),
        "date_closed": _with(TX, body=f"SELECT * FROM tx WHERE {CLOSED}"),
        "date_multi_range": _with(TX, body=(
            f"SELECT * FROM tx WHERE ({CLOSED}) OR (pdate >= '{b0}' AND pdate <= '{e0}')")),
        "nonblank_ends": _with(TX, body=f"SELECT * FROM tx WHERE {CLOSED} AND {NONBLANK}"),
        "success_only": _with(TX, body=(
            f"SELECT * FROM tx WHERE {CLOSED} AND {SUCCESS}")),
        "success_nonblank": _with(TX, body=(
            f"SELECT * FROM tx WHERE {CLOSED} AND {NONBLANK} AND {SUCCESS}")),
        "transfers_only": _with(TX, body=f"SELECT * FROM tx WHERE {CLOSED} AND trans_id = 'S33'"),
        "nonblank_untrimmed": _with(TX, body=(
            f"SELECT * FROM ({_traced(CLOSED)}) t WHERE {OUT} IS NOT NULL AND {OUT} <> '' "
            f"AND {IN} IS NOT NULL AND {IN} <> ''")),
        "consumption_of_cards": _with(TX, CARDS_CTE, body=(
            f"SELECT * FROM tx WHERE {CLOSED} AND {CONSUMPTION} "
            f"AND {PRI} IN (SELECT card FROM cards)")),
        "all_of_cards": _with(TX, CARDS_CTE, body=(
            f"SELECT * FROM tx WHERE {CLOSED} AND {PRI} IN (SELECT card FROM cards)")),
        "touching_cards": _with(TX, CARDS_CTE, body=(
            f"SELECT * FROM ({_traced(CLOSED)}) t WHERE {IN} IN (SELECT card FROM cards) "
            f"OR {OUT} IN (SELECT card FROM cards)")),
        "edges_touching": _with(TX, CARDS_CTE, body=(
            f"SELECT * FROM (SELECT DISTINCT trim({IN}) AS {IN}, trim({OUT}) AS {OUT} FROM tx "
            f"WHERE {CLOSED} AND {NONBLANK}) t WHERE {IN} IN (SELECT card FROM cards) "
            f"OR {OUT} IN (SELECT card FROM cards)")),
        "semi_in": _with(TX, CARDS_CTE, body=(
            f"SELECT * FROM tx WHERE {CLOSED} AND {IN} IN (SELECT card FROM cards)")),
        "semi_out": _with(TX, CARDS_CTE, body=(
            f"SELECT * FROM tx WHERE {CLOSED} AND {OUT} IN (SELECT card FROM cards)")),
        "semi_pri": _with(TX, CARDS_CTE, body=(
            f"SELECT * FROM tx WHERE {CLOSED} AND {PRI} IN (SELECT card FROM cards)")),
        "three_leg_extract": _with(TX, CARDS_CTE, body=_three_leg(CLOSED)),
        "three_leg_extract_union": _with(TX, CARDS_CTE, body=_three_leg(CLOSED)),
        "two_leg_expand": _with(*TWO, body="SELECT * FROM r1"),
        "pair_amount_round0": _with(*TWO, body=_pairs("ext", "trans_id = 'S33'")),
        "pair_amount_round1": _with(*TWO, body=_pairs("r1")),
        "transfer_cards_bag": _with(TX, CARDS_CTE, EXT, body=(
            f"SELECT {IN} AS card FROM ext WHERE trans_id = 'S33' "
            f"UNION ALL SELECT {OUT} AS card FROM ext WHERE trans_id = 'S33'")),
        "transfer_cards": _with(*TWO, body="SELECT card FROM c0"),
        "suspect_cards": _with(*TWO, body="SELECT card FROM c1"),
        "suspect_card_count": _with(*TWO, body="SELECT count(DISTINCT card) AS n_cards FROM c1"),
        "edge_list": _with(TX, body=(
            f"SELECT DISTINCT trim({OUT}) AS {OUT}, trim({IN}) AS {IN} FROM tx "
            f"WHERE {CLOSED} AND {NONBLANK}")),
        "edge_list_half_open": _with(TX, body=(
            f"SELECT DISTINCT trim({OUT}) AS {OUT}, trim({IN}) AS {IN} FROM tx "
            f"WHERE {HALF} AND {NONBLANK}")),
        "edge_list_successful": _with(TX, body=(
            f"SELECT DISTINCT trim({OUT}) AS {OUT}, trim({IN}) AS {IN} FROM tx "
            f"WHERE {HALF} AND {NONBLANK} AND {SUCCESS}")),
        "endpoint_set": _with(TX, body=(
            f"SELECT DISTINCT card FROM (SELECT trim({OUT}) AS card FROM tx "
            f"UNION ALL SELECT trim({IN}) AS card FROM tx) t")),
        "endpoint_count": _with(TX, body=(
            f"SELECT count(DISTINCT card) AS n_cards FROM (SELECT trim({OUT}) AS card FROM tx "
            f"UNION ALL SELECT trim({IN}) AS card FROM tx) t")),
        "card_digest_message": (
            "SELECT card, reverse(CAST(length(card) AS VARCHAR) || card) AS message "
            "FROM (SELECT 'A' || CAST(c_custkey AS VARCHAR) AS card FROM customer) t"),
        "card_digest": _digest_sql(),
        "row_text": _row_text(),
        "preview_ordered": _preview(),
        "trace_fixpoint": _with(TX, CARDS_CTE, *g_half_ok, FIX, body="SELECT card FROM f",
                                recursive=True),
        "trace_fixpoint_sizes": _fix_sizes(),
        "trace_2_rounds": _with(TX, CARDS_CTE, *g_half, _depth(2), _bounded_sizes(2),
                                body="SELECT card FROM r WHERE d = (SELECT last FROM stop)",
                                recursive=True),
        "trace_closed_fixpoint": _with(TX, CARDS_CTE, *g_closed_nb, FIX,
                                       body="SELECT card FROM f", recursive=True),
        "trace_edges_4": _with(TX, CARDS_CTE, *g_closed_nb, _depth(4), _bounded_sizes(4), body=(
            f"SELECT s AS {IN}, d AS {OUT} FROM edges WHERE s IN {LAST} OR d IN {LAST}"),
            recursive=True),
        "trace_consume_5": _with(TX, CARDS_CTE, *g_closed_all, _depth(5), _bounded_sizes(5), body=(
            f"SELECT * FROM ({_traced(CLOSED + ' AND ' + CONSUMPTION)}) t "
            f"WHERE {PRI} IN {LAST}"), recursive=True),
        "trace_transfer_5": _with(TX, CARDS_CTE, *g_closed_all, _depth(5), _bounded_sizes(5), body=(
            f"SELECT * FROM ({_traced(CLOSED)}) t WHERE {OUT} IN {LAST} OR {IN} IN {LAST}"),
            recursive=True),
        "frontier_sizes": _with(TX, CARDS_CTE, *g_closed_all, _depth(5), _bounded_sizes(5),
                                body="SELECT CAST(round AS INTEGER) AS round, "
                                     "CAST(n_cards AS BIGINT) AS n_cards FROM sz "
                                     "WHERE round <= (SELECT last FROM stop)",
                                recursive=True),
        "frontier_first_round": _with(TX, CARDS_CTE, *g_closed_all, _depth(5), _bounded_sizes(5),
                                      body="SELECT card, CAST(min(d) AS INTEGER) AS round FROM r "
                                           "WHERE d <= (SELECT last FROM stop) GROUP BY card",
                                      recursive=True),
        "trace_history_fixpoint": _with(TX, CARDS_CTE, *_graph("TRUE", IN, OUT, True), FIX,
                                        body="SELECT card FROM f", recursive=True),
        "trace_history_sizes": _fix_sizes(_graph("TRUE", IN, OUT, True)),
        "trace_history_transfers": _with(TX, CARDS_CTE, *_graph("TRUE", OUT, IN, False), _depth(5),
                                         _bounded_sizes(5),
                                         body=(f"SELECT * FROM ({_traced('TRUE')}) t "
                                               f"WHERE {OUT} IN {LAST} OR {IN} IN {LAST}"),
                                         recursive=True),
        "pair_amount_round0_set": _with(TX, CARDS_CTE, body=(
            f"SELECT {IN}, {OUT}, CAST(SUM(TRY_CAST(trans_at AS BIGINT)) AS BIGINT) AS amount "
            f"FROM tx WHERE {CLOSED} AND trans_id = 'S33' AND ({IN} IN (SELECT card FROM cards) "
            f"OR {OUT} IN (SELECT card FROM cards) OR {PRI} IN (SELECT card FROM cards)) "
            f"GROUP BY {IN}, {OUT}")),
        "touching_segment_cards": _with(TX, SEGMENT_CTE, body=(
            f"SELECT * FROM ({_traced(CLOSED)}) t WHERE {IN} IN (SELECT card FROM cards) "
            f"OR {OUT} IN (SELECT card FROM cards)")),
        "extract_segment_cards": _with(TX, SEGMENT_CTE, body=_three_leg(CLOSED)),
        "trace_segment_2_rounds": _with(TX, SEGMENT_CTE, *g_half, _depth(2), _bounded_sizes(2),
                                        body="SELECT card FROM r WHERE d = (SELECT last FROM stop)",
                                        recursive=True),
        "trace_segment_fixpoint": _with(TX, SEGMENT_CTE, *g_closed_nb, FIX, body="SELECT card FROM f",
                                        recursive=True),
        "trace_segment_rounds_transfer": _every_round("touch", SEGMENT_CTE),
        "trace_closed_fixpoint_full": _with(TX, CARDS_CTE, *g_closed_nb, FIX,
                                            body="SELECT card FROM f", recursive=True),
        "trace_early_stop": _with(TX, (
            f"e AS (SELECT DISTINCT trim({OUT}) AS s, trim({IN}) AS d FROM tx WHERE {CLOSED} AND {NONBLANK})"),
            "ends AS (SELECT card FROM (SELECT s AS card FROM e UNION ALL SELECT d FROM e) t "
            "GROUP BY card HAVING count(*) = 1)",
            "seed AS (SELECT min(s) AS s FROM e WHERE s IN (SELECT card FROM ends) AND d IN (SELECT card FROM ends))",
            body="SELECT s AS card FROM e WHERE s = (SELECT s FROM seed) "
                 "UNION ALL SELECT d AS card FROM e WHERE s = (SELECT s FROM seed)"),
        "pair_amount_decimal": _with(*TWO, body=(
            f"SELECT {IN}, {OUT}, CAST(c // 100 AS VARCHAR) || CASE WHEN c % 100 = 0 THEN '' "
            "ELSE '.' || rtrim(lpad(CAST(c % 100 AS VARCHAR), 2, '0'), '0') END AS amount "
            f"FROM (SELECT {IN}, {OUT}, CAST(SUM(CAST(trans_at AS BIGINT)) AS BIGINT) AS c "
            f"FROM ext WHERE trans_id = 'S33' GROUP BY {IN}, {OUT}) t")),
        "pair_amount_unreadable": _with(*TWO, body=(
            "SELECT count(*) FILTER (WHERE CAST(trans_at AS BIGINT) % 100 <> 0) AS n_unreadable FROM ext "
            "WHERE trans_id = 'S33'")),
        "pair_amount_five_decimals": _with(*TWO, body=(
            f"SELECT {IN}, {OUT}, rtrim(rtrim(CAST(CAST(c AS DECIMAL(38,0)) * CAST(0.00001 AS DECIMAL(6,5)) AS VARCHAR), '0'), '.') AS amount "
            f"FROM (SELECT {IN}, {OUT}, SUM(CAST(trans_at AS BIGINT)) AS c FROM ext WHERE trans_id = 'S33' GROUP BY {IN}, {OUT}) t")),
        "insert_overwrite_partition": _with(TX, body=(
            f"SELECT {PRI}, trans_id, trans_at, pdate FROM tx WHERE {CLOSED} AND "
            f"CASE WHEN pdate = '{REPLACED_DAY}' THEN {SUCCESS} ELSE trans_id = 'S33' END")),
        "registered_history": _with(TX, body=f"SELECT {ALL_COLS} FROM tx WHERE pdate >= '{WEEK[0]}' AND pdate <= '{WEEK[1]}'"),
        "row_text_readback": _with(TX, CARDS_CTE, body=(
            f"SELECT *, 'ok' AS status FROM ({_traced(CLOSED)}) t WHERE {IN} IN (SELECT card FROM cards) "
            f"OR {OUT} IN (SELECT card FROM cards)")),
        "row_text_ambiguous": _with(TX, CARDS_CTE, body=(
            f"SELECT CASE WHEN {OUT} LIKE '%1' OR {IN} LIKE '%1' THEN 'ambiguous' ELSE 'ok' END AS status, count(*) AS n FROM ({_traced(CLOSED)}) t "
            f"WHERE {IN} IN (SELECT card FROM cards) OR {OUT} IN (SELECT card FROM cards) GROUP BY 1")),
        "closure_by_days": _with(TX, CARDS_CTE, *g_closed_nb, *_bfs_first_rounds(),
                                 body="SELECT card, CAST(round AS INTEGER) AS round FROM fr", recursive=True),
        "insert_overwrite": _with(TX, body=(
            f"SELECT {PRI} AS card, trans_id AS kind, trans_at AS amount, pdate AS day FROM tx "
            f"WHERE {CLOSED} AND {SUCCESS}")),
        "delimited_roundtrip": _with(*TWO, body=_pairs("ext", "trans_id = 'S33'")),
        "create_if_absent": _with(TX, body=(
            f"SELECT {PRI}, {OUT}, {IN}, CAST(NULL AS VARCHAR) AS extra_255, 256 AS n_columns FROM tx "
            f"WHERE {CLOSED} AND trans_id = 'S33'")),
        "drop_and_recreate": f"WITH {SEGMENT_CTE} SELECT card FROM cards",
        "text_seeds": f"WITH {SEGMENT_CTE} SELECT card FROM cards",
        "appended_cards": (f"WITH {SEGMENT_CTE} SELECT card FROM cards UNION ALL "
                           "SELECT 'A' || CAST(c_custkey AS VARCHAR) AS card FROM customer"),
        "rows_round1_readback": _with(*TWO, body="SELECT * FROM r1"),
        "trace_rounds_consume": _every_round("pri"),
        "trace_rounds_transfer": _every_round("touch"),
    }
