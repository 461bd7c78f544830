"""Feature and status catalog: plain metadata on the driver, not operators.

The lists below are FIXED VALUES that must equal the analysed loan table's
column names and status texts for results to be right; they are stated
plainly, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: column groups by availability
# ---------------------------------------------------------------------------
IDENTIFIERS = ["id", "member_id", "url"]

APPLICATION = [
    "loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade",
    "emp_title", "emp_length", "home_ownership", "annual_inc",
    "verification_status", "desc", "purpose", "title", "zip_code",
    "addr_state", "dti", "delinq_2yrs", "earliest_cr_line",
    "inq_last_6mths", "mths_since_last_delinq", "mths_since_last_record",
    "open_acc", "pub_rec", "total_acc", "initial_list_status",
    "collections_12_mths_ex_med", "mths_since_last_major_derog",
    "policy_code", "application_type", "annual_inc_joint", "dti_joint",
    "verification_status_joint", "acc_now_delinq", "tot_coll_amt",
    "tot_cur_bal", "open_acc_6m", "open_il_6m", "open_il_12m",
    "open_il_24m", "mths_since_rcnt_il", "total_bal_il", "il_util",
    "open_rv_12m", "open_rv_24m", "max_bal_bc", "all_util",
    "total_rev_hi_lim", "inq_fi", "total_cu_tl", "inq_last_12m",
]

OPEN_LOAN = [
    "funded_amnt", "funded_amnt_inv", "issue_d", "pymnt_plan",
    "revol_bal", "revol_util", "out_prncp", "out_prncp_inv", "total_pymnt",
    "total_pymnt_inv", "total_rec_prncp", "total_rec_int",
    "total_rec_late_fee", "last_pymnt_d", "last_pymnt_amnt", "next_pymnt_d",
    "last_credit_pull_d",
]

CLOSED_LOAN = ["recoveries", "collection_recovery_fee"]

RESPONSE = ["loan_status"]

# ---------------------------------------------------------------------------
# FIXED VALUES: column groups by treatment
# ---------------------------------------------------------------------------
DROP = ["id", "member_id", "url", "emp_title", "desc", "title", "zip_code"]
DATE = ["earliest_cr_line", "last_credit_pull_d", "issue_d", "last_pymnt_d",
        "next_pymnt_d"]
DUMMY = ["addr_state", "purpose", "emp_length", "grade", "home_ownership",
         "verification_status_joint", "verification_status", "pymnt_plan",
         "application_type", "initial_list_status", "term"]
CALCULATE = ["sub_grade"]

# ---------------------------------------------------------------------------
# FIXED VALUES: loan status taxonomy (10 values)
# ---------------------------------------------------------------------------
DEFAULT_STATUSES = [
    "Charged Off", "Default",
    "Does not meet the credit policy. Status:Charged Off",
    "Late (31-120 days)",
]
REPAID_STATUSES = [
    "Fully Paid", "Does not meet the credit policy. Status:Fully Paid",
]
CURRENT_STATUSES = [
    "Current", "In Grace Period", "Late (16-30 days)", "Issued",
]

# Missing-value conventions of the analysed table.
SENTINEL_TEXT = "n/a"      # whole-cell text meaning "missing"
MISSING_FILL = -99.0       # fill for missing features (true minimum is -4)


@dataclass(frozen=True)
class StatusTaxonomy:
    """Three-way status classes; ``default`` is the positive label."""

    default: tuple
    repaid: tuple
    current: tuple = ()

    @property
    def closed(self) -> tuple:
        return tuple(self.default) + tuple(self.repaid)

    @property
    def all(self) -> tuple:
        return self.closed + tuple(self.current)


LOAN_STATUSES = StatusTaxonomy(tuple(DEFAULT_STATUSES), tuple(REPAID_STATUSES),
                               tuple(CURRENT_STATUSES))


@dataclass(frozen=True)
class FeatureCatalog:
    """Which column gets which treatment. Groups are intersected with the
    columns actually present, in sorted order, so any column subset works."""

    drop: tuple = tuple(DROP)
    date: tuple = tuple(DATE)
    dummy: tuple = tuple(DUMMY)
    calculate: tuple = tuple(CALCULATE)
    response: tuple = tuple(RESPONSE)
    exclude: tuple = field(default_factory=tuple)  # e.g. given score columns

    def present(self, group: str, columns) -> list:
        return sorted(set(getattr(self, group)) & set(columns))

    def numeric(self, columns) -> list:
        """Every column not in another group ("the rest"), sorted."""
        taken = set(self.drop) | set(self.date) | set(self.dummy) | set(
            self.calculate) | set(self.response) | set(self.exclude)
        return sorted(c for c in columns if c not in taken)


LOAN_FEATURES = FeatureCatalog()

ALL_COLUMNS = IDENTIFIERS + APPLICATION + OPEN_LOAN + CLOSED_LOAN + RESPONSE


def loan_schema() -> T.StructType:
    """Explicit schema for the raw loan CSV: never infer (mixed-type columns)."""
    strings = set(DUMMY) | set(DATE) | set(CALCULATE) | set(RESPONSE) | {
        "url", "emp_title", "desc", "title", "zip_code"}
    fields = []
    for c in ALL_COLUMNS:
        if c in ("id", "member_id"):
            t = T.LongType()
        elif c in strings:
            t = T.StringType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)
