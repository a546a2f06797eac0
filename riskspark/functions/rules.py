"""Named derived features: a rule is a name and an expression; it applies where all its columns are."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the child tables, in SQL. 1e-3 keeps a zero denominator defined; flags are 0 or 1.
CHILD_RULES: dict[str, str] = {
    "fstqpd30_highrisk_flag": "int(posfstqpd30lastmonth_3976962P > 0.2e0)",
    "fpd30_flag": "int(posfpd30lastmonth_3976960P > 0.3e0)",
    "dpd_ratio": "pmts_dpdvalue_108P / (sumoutstandtotal_3546847A + 1e-3)",
    "dpd_always_gt60_24m_flag": "int(mindbddpdlast24m_3658935P > 60)",
    "dpd_worsening_flag": "int(maxdpdlast3m_392P > maxdpdlast6m_474P)",
    "dpd_early_flag": "int(maxdpdinstlnum_3546846P <= 3)",
    "dpd_improvement_flag": "int(maxdpdlast6m_474P < maxdpdfrom6mto36m_3546853P)",
    "dpd_neg_flag": "int(maxdbddpdtollast6m_4187119P < 0)",
    "actualdpd_gt60_flag": "int(actualdpd_943P > 60)",
    "dpd_tolerance_ratio": "actualdpdtolerance_344P / (actualdpd_943P + 1e-3)",
    "dpd_3m_24m_delta": "avgdbddpdlast3m_4187120P - avgdbddpdlast24m_3658932P",
    "dpd_relief_ratio": "maxdpdlast6m_474P / (maxdpdfrom6mto36m_3546853P + 1e-3)",
    "dpd_worst_gt60_flag": "int(maxdpdlast24m_143P > 60 OR maxdpdlast12m_727P > 60)",
    "dti_ratio": "currdebt_22A / (maininc_215A + 1e-3)",
    "disposable_income_ratio": "(maininc_215A - installmentamount_644A) / (maininc_215A + 1e-3)",
    "debt_burden_ratio": "(currdebt_22A + debtoutstand_525A) / (maininc_215A + 1e-3)",
    "credit_utilization_ratio": "currdebt_22A / (credacc_credlmt_575A + 1e-3)",
    "repayment_progress_ratio": "(disbursedcredamount_1113A - currdebt_22A) / (disbursedcredamount_1113A + 1e-3)",
    "cc_burden_ratio": "credacc_actualbalance_314A / (credacc_credlmt_575A + 1e-3)",
    "dti_high_flag": "int(currdebt_22A / (maininc_215A + 1e-3) > 0.60e0)",
    "overdue_active_ratio": "totaldebtoverduevalue_178A / (totaloutstanddebtvalue_39A + 1e-3)",
    "overdue_closed_ratio": "totaldebtoverduevalue_718A / (totaloutstanddebtvalue_668A + 1e-3)",
    "payment_ability_ratio": "totinstallast1m_4525188A / (sumoutstandtotal_3546847A + 1e-3)",
    "overpaid_flag": "int(totalsettled_863A > totaldebt_9A)",
    "has_revolving_account_flag": "int(revolvingaccount_394A = 1)",
    "residual_active_ratio": "residualamount_856A / (price_1097A + 1e-3)",
    "residual_closed_flag": "int(residualamount_488A > 0)",
    "overdue_active_flag": "int(pmts_overdue_1140A > 0)",
    "overdue_closed_flag": "int(pmts_overdue_1152A > 0)",
    "payment_level_overdue_flag": "int(pmts_pmtsoverdue_635A > 0)",
}
#: Rules of the assembled table. A missing input is an error there.
CASE_RULES: dict[str, str] = {
    "highutil_and_dpd60_ratio": "tinyint(coalesce(last_cc_burden_ratio > 0.8e0 AND last_actualdpd_gt60_flag = 1, false))",
    "dpd_worsen_delta_P": "last_actualdpd_943P - mean_actualdpd_943P",
    "cc_burden_relief_ratio": "1e0 - last_cc_burden_ratio / (max_cc_burden_ratio + 1e-3)",
    "dti_ex_ratio": "last_annuity_853A / (last_mainoccupationinc_437A + 1e-3)",
    "arrears_progress_P": "(1e0 - repayment_progress_ratio) * last_actualdpd_943P",
    "residual_amt_flag": "max_residualamount_856A * max_residual_closed_flag",
    "credlmt_delta_A": "last_credlmt_230A - mean_credlmt_230A",
    "payment_ability_ratio_miss": "tinyint(payment_ability_ratio = 0)",
    "dti_ratio_miss": "tinyint(dti_ratio = 0)",
}
_WORDS = {"int", "tinyint", "coalesce", "and", "or", "false", "e"}

Rule = str | Column | Callable[[], Column]


def required(rule: str) -> list[str]:
    """The columns that a rule's SQL names."""
    found = re.findall(r"\b[A-Za-z_][A-Za-z0-9_]*\b", re.sub(r"\b\d+(\.\d+)?(e-?\d+)?\b", " ", rule))
    return list(dict.fromkeys(x for x in found if x.lower() not in _WORDS))


def combo_columns(df: DataFrame, rules: dict[str, Rule] | None = None, needs: dict[str, list[str]] | None = None) -> list[Column]:
    """The rules that apply to df: not there yet, and all their columns are. They do not see each other's output.

    A rule is SQL text, a Column, or a function that makes one; the last two name their columns in `needs`.
    """
    have, out = set(df.columns), []
    for name, rule in (CHILD_RULES if rules is None else rules).items():
        wants = (needs or {}).get(name) or (required(rule) if isinstance(rule, str) else [])
        if name in have or not have.issuperset(wants):
            continue
        made = F.expr(rule) if isinstance(rule, str) else rule() if callable(rule) else rule
        if not isinstance(made, Column):
            raise TypeError(f"rule {name} gives {type(made).__name__}, not a Column")
        out.append(made.alias(name))
    return out


def add_combos(df: DataFrame, rules: dict[str, Rule] | None = None, needs: dict[str, list[str]] | None = None) -> DataFrame:
    return df.select("*", *combo_columns(df, rules, needs))


def add_case_combos(df: DataFrame) -> DataFrame:
    """The assembled table's rules, all of them; raises if an input is missing."""
    missing = sorted({c for r in CASE_RULES.values() for c in required(r)} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select("*", *[F.expr(r).alias(n) for n, r in CASE_RULES.items()])
