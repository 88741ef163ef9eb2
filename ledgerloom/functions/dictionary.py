"""The canonical fields of loan and collateral tapes, and what follows from them (labels, schema, masking policy)."""

from __future__ import annotations

from pyspark.sql import types as T

#: Canonical fields by logical type.
BY_TYPE: dict[str, str] = {
    "identifier": "facility_id loan_id borrower_id collateral_record_id receivable_id account_debtor_id inventory_item_id",
    "string": "source_system borrower_name currency_code facility_type product_type loan_status risk_rating industry_code borrower_country_code borrower_region collateral_type account_debtor_name eligibility_status ineligibility_reason inventory_category",
    "date": "as_of_date origination_date maturity_date default_date invoice_date invoice_due_date",
    "integer": "days_past_due receivable_age_days",
    "decimal": "spread_bps inventory_quantity",
    "boolean": "nonaccrual_flag default_flag cross_aging_flag",
    "percentage": "interest_rate benchmark_rate advance_rate accounts_receivable_advance_rate inventory_advance_rate equipment_advance_rate dilution_rate",
    "currency": "original_balance commitment_amount outstanding_balance undrawn_amount charge_off_amount recovery_amount collateral_gross_amount eligible_collateral_amount ineligible_collateral_amount borrowing_base_contribution accounts_receivable_gross accounts_receivable_eligible inventory_gross inventory_eligible equipment_appraised_value cash_collateral_amount concentration_reserve dilution_reserve availability_block other_reserves total_reserves borrowing_base_amount excess_availability receivable_amount inventory_nolv",
}
#: Fields that each analysis needs.
REQUIRED: dict[str, str] = {
    "base": "as_of_date facility_id loan_id borrower_id currency_code commitment_amount outstanding_balance",
    "stratification": "as_of_date facility_id borrower_id outstanding_balance",
    "vintage": "as_of_date loan_id loan_status origination_date original_balance outstanding_balance default_flag",
    "borrowing_base": "as_of_date facility_id currency_code outstanding_balance accounts_receivable_eligible accounts_receivable_advance_rate inventory_eligible inventory_advance_rate total_reserves borrowing_base_amount",
}
#: Fields whose text is personal.
RESTRICTED = "loan_id borrower_id borrower_name receivable_id account_debtor_id account_debtor_name".split()
#: Labels that are not the id in words.
LABELS = {
    "spread_bps": "Spread", "collateral_gross_amount": "Gross Collateral Amount", "accounts_receivable_gross": "Gross Accounts Receivable", "accounts_receivable_eligible": "Eligible Accounts Receivable",
    "inventory_gross": "Gross Inventory", "inventory_eligible": "Eligible Inventory", "receivable_age_days": "Receivable Age (Days)",
}
#: Other names of the commonest fields. A tenant's own names are a parameter of the functions that match names.
ALIASES: dict[str, str] = {
    "as_of_date": "reporting_date snapshot_date cutoff_date",
    "source_system": "system_of_record source",
    "facility_id": "facility_number facility_no deal_id",
    "loan_id": "loan_number loan_no contract_id",
    "borrower_id": "customer_id obligor_id",
    "borrower_name": "customer_name legal_name",
    "currency_code": "currency ccy",
    "loan_status": "account_status status",
    "origination_date": "booking_date open_date",
    "maturity_date": "expiration_date due_date",
    "original_balance": "original_principal orig_balance",
    "commitment_amount": "credit_limit commitment",
    "outstanding_balance": "current_balance principal_balance loan_balance",
    "interest_rate": "coupon_rate current_rate",
    "risk_rating": "credit_grade risk_grade rating",
    "days_past_due": "dpd days_delinquent",
    "default_flag": "is_default",
    "charge_off_amount": "write_off_amount chargeoff",
    "recovery_amount": "recoveries",
}
FIELDS: list[tuple[str, str]] = [(f, kind) for kind, names in BY_TYPE.items() for f in names.split()]
TYPES = {"date": T.DateType(), "string": T.StringType(), "identifier": T.StringType(), "boolean": T.BooleanType(), "currency": T.DecimalType(20, 2), "integer": T.LongType(), "percentage": T.DecimalType(12, 8), "decimal": T.DecimalType(20, 8)}


def label(field: str) -> str:
    return LABELS.get(field) or field.replace("_", " ").title()


def schema(fields: list[str] | None = None) -> T.StructType:
    return T.StructType([T.StructField(n, TYPES[k]) for n, k in FIELDS if fields is None or n in fields])


def masking() -> dict[str, str]:
    """Policies for ``mask``: identifiers become tokens, restricted text goes, the rest stays; a field that isn't here is redacted."""
    return {n: "tokenize" if k == "identifier" else "redact" if n in RESTRICTED else "none" for n, k in FIELDS}
