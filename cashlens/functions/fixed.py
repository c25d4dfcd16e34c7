"""Patterns, phrases, categories, policy numbers.

These are data, listed in their natural order because order decides which rule wins.
"""

# --- Categories -------------------------------------------------------------
POS_REVENUE = "True Revenue - POS / Processor"
INTERNAL_TRANSFER = "Non-Revenue - Own-Account / Internal Transfer"
LOAN_PROCEEDS = "Non-Revenue - MCA / Loan Proceeds"
REVERSAL = "Non-Revenue - Refund / Reversal / NSF"
GOVERNMENT = "Non-Revenue - Gov / Tax / Insurance Proceeds"
UNIDENTIFIED = "Review Required - Unidentified / Unusual Deposit"

LABEL_CATEGORIES = [
    "True Revenue - POS / Processor",
    "True Revenue - Verified Cash",
    "True Revenue - Customer Payment / Cheque",
    "True Revenue - B2B E-Transfer",
    "Non-Revenue - Own-Account / Internal Transfer",
    "Non-Revenue - MCA / Loan Proceeds",
    "Non-Revenue - Refund / Reversal / NSF",
    "Non-Revenue - Gov / Tax / Insurance Proceeds",
    "Non-Revenue - Shareholder / Investment",
    "Non-Revenue - Wash / Round-Trip Transfer",
    "Review Required - Unidentified / Unusual Deposit",
]

# --- Description rules (matched on upper-cased text) --------------------------
INTERNAL_TRANSFER_PATTERNS = [
    r"\bTF\s*\d{3,4}\s*#\s*\d{3,4}[\-#]\d{3,4}\b",
    r"\bONLINE\s+TRANSFER\b",
    r"\bINTERNAL\s+TRANSFER\b",
    r"\bBR\.?\s*\d{3,4}\b",
    r"\bBALANCE\s+ADJUSTMENT\b",
    r"\b\d{4}-\d{4}-\d{3,4}\s*1005\b",
]
GOVERNMENT_PATTERNS = [
    r"\bPROV[/\.]?\s*LOCAL\s+GVT\s+PAYMENT\b",
    r"\bPROVINCE\s+OF\b",
    r"\bCRA\b|\bCANADA\s+REVENUE\b|\bPAD\s+CCRA\b",
    r"\bGST\b|\bHST\b",
    r"\bEI\s+BENEFIT\b|\bSERVICE\s+CANADA\b",
]
NSF_PATTERNS = [
    r"\bNSF\b",
    r"RETURNED\s+ITEM",
    r"\bITEM\s+RETURNED\b",
    r"\bUNPAID\b",
    r"DISHONOURED",
    r"FRAIS\s+EFFET\s+RET",
    r"\bREVERSE\b",
    r"\bRECLAIM\b",
]
# Matched in any letter case.
POS_PATTERN = (
    r"STRIPE|SQUARE|SQ \*|MONERIS|CLOVER|FIRST DATA|FISERV|FDMS|ELAVON|"
    r"GLOBAL PAY|CHASE MERCH|PAYMENTECH|HELCIM|TD MERCH|MONETICO|"
    r"DESJARDINS PAIEMENT|LIGHTSPEED|SHOPIFY|ADYEN|BAMBORA|WORLDLINE|"
    r"TOAST|NUVEI|PIVOTAL|PAYFACTO|ZETTLE|PAYPAL|KLARNA|AMAZON|"
    r"UBER|DOORDASH|SKIPTHEDISHES|SKIP THE DISHES|MSP/DIV|MSP/ DIV|"
    r"\b(?:VI|MC|EF|AMX)\d{4}\b"
)
GENERIC_LOAN_PATTERN = r"\bLOAN PAYMENT\b|\bLOAN CREDIT\b"
GENERIC_LENDER = "Generic Loan/MCA"
NSF_FEE_EXEMPT_PATTERN = r"OVERDRAWN|HANDLING CHGS"
NSF_MIN_AMOUNT = 30
TRANSFER_REF_PATTERN = r"TF\d{3,4}#?\d{3,4}[\-#]\d{3,4}"
WASH_MIN_ROUND_TRIPS = 6
WASH_MIN_CATEGORY_ROWS = 3

# --- Statement layout -------------------------------------------------------
LINE_PITCH = 3.5
HEADER_SEARCH_LINES = 20
BALANCE_HEADINGS = ["balance", "balance($)", "balance(s)"]
HEADING_GATE = ["withdrawn", "debited", "debit", "deposited", "credited", "credit"]
DEBIT_HEADINGS = ["withdrawn", "debited", "debit", "outflow", "payments"]
CREDIT_HEADINGS = ["deposited", "credited", "credit", "inflow", "deposits"]
DEFAULT_DESC_LIMIT = 200.0
DEFAULT_DEBIT_BAND = (200.0, 370.0)
DEFAULT_CREDIT_BAND = (370.0, 460.0)
DEFAULT_BALANCE_X = 460.0
NUMERIC_LAYOUT_BANK = "BANQUE NATIONALE"
NUMERIC_LAYOUT_BANDS = {"desc": (90.0, 270.0), "debit": (270.0, 375.0), "credit": (375.0, 465.0)}
NOISE_PHRASES = [
    "ACCOUNT/TRANSACTION TYPE",
    "FEES PAID",
    "NEXT STATEMENT",
    "MONTHLY AVER",
    "DEP CONTENT",
    "CHQS ENCLOSED",
]
SUMMARY_PHRASES = [
    "CLOSING",
    "OPENING",
    "ITEMS PROCESSED",
    "BALANCE FORWARD",
    "TOTALS",
    "SOLDE PRECEDENT",
    "FACTURATION",
    "NEW BALANCE",
    "TOTAL FUNDS",
    "TRANSACTIONS",
]
EMPTY_DESCRIPTION = "Deposit"
BANK_FEE_PAYER = "Bank Fee"

# --- Dates and money -----------------------------------------------------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY_MONTH_YEAR = r"^(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{2,4})\b"
DAY_MONTH = r"^(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"
MONTH_DAY = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\b"
NUMERIC_MONTH_DAY = r"^[\s|]*(0[1-9]|1[0-2])[\s|]+(0[1-9]|[12]\d|3[01])\b"
STATEMENT_YEAR = r"\b(201[5-9]|202[0-9])\b"
DEFAULT_YEAR = "2026"
CURRENCY = r"\d+\.\d{2}"
MONEY_WITH_CENTS = r"-?\(?\d[\d,]*\.\d{2}\)?"
MONEY_WHOLE = r"-?\(?\d[\d,]{2,}\)?"

# --- Totals printed by the bank (any letter case; first family found wins) --------
ANCHOR_FAMILIES = [
    ("amounts_credited", r"Total\s+amounts\s+credited\s*\(\$\)[^\d\n]*\+?\s*([\d,]+\.\d{2})"),
    ("closing_totals", r"Closing\s+totals[\s\S]*?[\d,]+\.\d{2}\s+([\d,]+\.\d{2})"),
    (
        "deposits_and_credits",
        r"Total\s+deposits\s*&\s*credits\s*\(\d+\)[^\d]*\+?\s*([\d,]+\.\d{2})",
    ),
    (
        "explicit_total",
        r"(?:Total\s+(?:deposits|credits|amounts\s+deposited)|Amounts\s+deposited)"
        r"[^\d\n]*([\d,]+\.\d{2})",
    ),
]
OPENING_BALANCE = (
    r"(?:Opening\s+balance|BALANCE\s+FORWARD)\s*(?:on[^\d\n]*)?[:\s]*\$?\s*([\-\d,]+\.\d{2})"
)
CLOSING_BALANCE = r"Closing\s+balance\s*(?:on[^\d\n]*)?[:\s]*=?\s*\$?\s*([\-\d,]+\.\d{2})"
CURRENT_BALANCE = r"Current\s+Balance:?\s*(?:CA)?\$?\s*([\-\d,]+\.\d{2})"
RECONCILE_TOLERANCE = 2

# --- Recurring lender payments ------------------------------------------------------
# (longest median gap in days, frequency); longer gaps and single payments are monthly.
FREQUENCY_BY_GAP = [(2, "Daily"), (5, "2-3x Weekly"), (8, "Weekly"), (15, "Bi-Weekly")]
MONTHLY = "Monthly"
PAYMENTS_PER_MONTH = {"Daily": 21.0, "2-3x Weekly": 9.0, "Weekly": 4.33, "Bi-Weekly": 2.16}
LOAN_DEBITS_PER_POSITION = 4
BUSINESS_DAYS = 21
NO_DEBT_COVERAGE = 99.9

# --- Underwriting policy --------------------------------------------------------------
CREDIT_DEFAULTS = {
    "owner_name": "Unknown",
    "fico_score": 650,
    "total_high_credit": 0.0,
    "revolving_credit_utilization_pct": 0.0,
    "active_collections_count": 0,
    "total_collections_amount": 0.0,
    "bankruptcies_found": False,
    "number_of_mortgages": 0,
    "mortgage_ltv_details": "N/A",
}
INPUT_DEFAULTS = {
    "months_in_business": 24,
    "avg_daily_balance": 0.0,
    "negative_days": 0,
    "borrowing_velocity": "0 in 90 Days",
    "bank_verification": "Bank Connect",
    "industry_rank": 1,
    "fraud_suspected": False,
    "active_default": False,
}
MIN_AVG_REVENUE = 10000
STOP_FRAUD = "Suspected altered statements / fraud"
STOP_DEFAULT = "Active lender default or collections"
STOP_WASH = "Evidence of structural wash transactions to cover debt"
STOP_REVENUE = "Avg True Revenue is under $10,000 policy minimum"

# Ladders: (bound, points), first bound met wins, 0 otherwise.
AT_LEAST_LADDERS = {
    "revenue": [(150000, 6), (75000, 5), (40000, 4), (20000, 3), (10000, 2)],
    "deposit_count": [(40, 5), (20, 4), (10, 3), (5, 2)],
    "daily_balance": [(10, 5), (7, 4), (4, 3), (2, 2), (1, 1)],
    "months_in_business": [(84, 6), (48, 5), (24, 4), (12, 3), (6, 1)],
    "credit_score": [(750, 6), (700, 5), (650, 4), (600, 3), (550, 2), (500, 1)],
}
AT_MOST_LADDERS = {
    "volatility": [(10, 5), (20, 4), (30, 3), (40, 2), (50, 1)],
    "positions": [(0, 6), (1, 5), (2, 3), (3, 1)],
    "burden": [(8, 10), (12, 8), (16, 6), (20, 4), (25, 2)],
    "payment_performance": [(0, 4), (1, 3), (2, 2), (4, 1)],
    "negative_days": [(0, 6), (3, 5), (6, 3), (10, 2), (15, 1)],
    "concentration": [(20, 2), (35, 1)],
}
TREND_TOP = (15, 6)  # strictly above
TREND_LADDER = [(5, 5), (-5, 4), (-10, 2), (-20, 1)]
CHOICE_POINTS = {
    "funding_velocity": ({"0 in 90 Days": 5, "1 in 90 Days": 3}, 1),
    "public_records": ({"Clean": 4, "Minor": 3, "Moderate": 1}, 0),
    "verification": ({"Bank Connect": 3, "Original PDF": 2, "Minor inconsistency": 1}, 0),
}
# Points that are computed but only added in the "full" score mode.
UNCOUNTED_COMPONENTS = ["revenue", "trend", "deposit_count", "volatility"]
# (lowest score, grade, risk tier, advance share, highest burden share)
GRADES = [
    (90, "A+", "Prime MCA", 1.00, 0.18),
    (82, "A", "Strong", 0.85, 0.17),
    (74, "B", "Acceptable", 0.70, 0.15),
    (66, "C", "Elevated", 0.55, 0.13),
    (58, "D", "High", 0.35, 0.10),
]
LOWEST_GRADE = ("E", "High / Unacceptable", 0.00, 0.00)
