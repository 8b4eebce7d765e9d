"""Column names and codes of the transaction history.

Fixed values: these must equal the source system's codes for right results.
"""

# Column names of the history table that the operators use.
PRI_COL = "pri_acct_no_conv"
IN_COL = "tfr_in_acct_no"
OUT_COL = "tfr_out_acct_no"
KIND_COL = "trans_id"
AMOUNT_COL = "trans_at"
DATE_COL = "pdate"

# Transaction kinds. S33 is a transfer; S25 and S33 are not consumption.
TRANSFER_KIND = "S33"
NON_CONSUMPTION_KINDS = ("S25", "S33")

# A successful transaction has these three flags.
SUCCESS_FLAGS = (
    ("sti_takeout_in", "1"),
    ("cu_trans_st", "10000"),
    ("resp_cd1", "00"),
)

# The traced-row projection, in this order; src and dest follow it.
TRACED_COLUMNS = (
    "pri_acct_no_conv",
    "trans_id",
    "trans_at",
    "pdate",
    "loc_trans_tm",
    "acpt_ins_id_cd",
    "trans_md",
    "cross_dist_in",
)

# Name of the one column of a card list.
CARD = "card"
