"""Vocabularies, limits, factors and wording that results must equal.

Nothing here is logic; every other module takes its constants from this one.
"""

# --- Fixed values: import collections -------------------------------------

COLLECTIONS = ["sales", "purchases", "products", "expenses", "recurring_obligations"]

REVIEW_MANUALLY = "review_manually"

# import type -> normalised header -> canonical field
HEADER_ALIASES = {
    "sales": {
        "date": "date",
        "sku": "sku",
        "product_name": "name",
        "category": "category",
        "qty": "quantity",
        "revenue_inr": "amount_inr",
        "margin_pct": "margin_pct",
    },
    "purchases": {
        "date": "date",
        "supplier": "supplier_name",
        "sku": "sku",
        "quantity": "quantity",
        "amount_inr": "amount_inr",
    },
    "products": {
        "sku": "sku",
        "name": "name",
        "category": "category",
        "unit_price_inr": "unit_price_inr",
        "quantity_on_hand": "quantity_on_hand",
        "expires_on": "expires_on",
    },
    "expenses": {
        "date": "occurred_on",
        "label": "label",
        "category": "category",
        "amount_inr": "amount_inr",
    },
    "recurring_obligations": {
        "label": "label",
        "category": "category",
        "amount_inr": "amount_inr",
        "due_date": "due_date",
        "recurrence": "recurrence",
        "status": "status",
    },
}

REQUIRED_FIELDS = {
    "sales": ["amount_inr", "date", "sku"],
    "purchases": ["amount_inr", "date", "sku", "supplier_name"],
    "products": ["category", "name", "quantity_on_hand", "sku"],
    "expenses": ["amount_inr", "category", "label", "occurred_on"],
    "recurring_obligations": ["amount_inr", "category", "due_date", "label", "recurrence"],
}

MANUAL_WARNING = "Some columns need manual review: "
MISSING_WARNING = "Missing canonical mappings: "

DEFAULT_SKU = "UNKNOWN"
DEFAULT_SUPPLIER = "Unknown supplier"
DEFAULT_EXPENSE_LABEL = "Expense entry"
DEFAULT_OBLIGATION_LABEL = "Imported obligation"
DEFAULT_CATEGORY = "Operations"
DEFAULT_PRODUCT_CATEGORY = "General"

# collections that refresh further views once an import is confirmed
DASHBOARD_COLLECTIONS = COLLECTIONS
ACTION_QUEUE_COLLECTIONS = ["sales", "purchases", "expenses"]

# --- Fixed values: enumerations --------------------------------------------

OBLIGATION_STATUSES = ["due", "scheduled", "paid"]  # in display order
RECURRENCES = ["monthly", "quarterly", "annual"]
ACTION_STATUSES = ["open", "watching", "snoozed", "resolved"]  # in display order
PROVIDER_MODES = ["local-open", "byo-cloud", "hybrid"]
ROLES = ["accountant", "manager", "owner"]  # lowest rank first
MONTH_LABELS = [
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
]

# --- Fixed values: windows and limits --------------------------------------

DUE_SOON_DAYS = 10
EXPIRY_WINDOW_DAYS = 45
MOVING_AVERAGE_DAYS = 5
SAMPLE_ROWS = 3
LEADING_BILLS = 3
MARGIN_TARGET = 24
MARGIN_PRESSURE = 22
SUPPLIER_CRITICAL_DAYS = 3
BILL_CRITICAL_DAYS = 2

# --- Fixed values: dashboard, alerts, brief --------------------------------

STAT_LABELS = [
    "Monthly revenue",
    "Gross margin",
    "Bills due in 10 days",
    "Near-expiry inventory",
]
REVENUE_DELTA = "Computed from imported and quick-added sales rows"
MARGIN_DELTA = "Average of tracked sale-level margin entries"
NO_BILLS_DUE = "No recurring bills due soon"
EXPIRY_DELTA = "%d lots inside 45-day watch window"

EXPIRY_ALERT_TITLE = "%s needs expiry attention"
EXPIRY_ALERT_DETAIL = "SKU %s expires on %s with %d units on hand."
CASH_ALERT_ID = "cash-watch"
CASH_ALERT_TITLE = "Recurring obligations are now DB-backed and live"
CASH_ALERT_DETAIL = (
    "Use quick-add entries to keep daily sales, purchases, and expenses decision-ready."
)

NOTHING_DUE_TODAY = "No recurring payments due today."
NO_ANOMALIES = "No major anomalies detected in the current snapshot."
NO_SUGGESTIONS = (
    "Add today's sales, purchases, and expenses to tighten tomorrow's recommendations."
)

# --- Fixed values: action queue --------------------------------------------

SUPPLIER_ACTION_TITLE = "Stage supplier follow-up for %s"
SUPPLIER_ACTION_DETAIL = (
    "%s is due on %s. Prepare a message before the next payment cycle tightens cash."
)
BILL_ACTION_TITLE = "Protect cash for %s"
BILL_ACTION_DETAIL = "%s is %s and should stay visible in the owner plan."
IMPORT_ACTION_TITLE = "Review the latest %s import"
IMPORT_ACTION_DETAIL = (
    "%d rows from %s were added on %s. Use this ledger in the next investigation."
)
WATCH_STOCK = {
    "id": "watch-stock",
    "title": "No urgent actions. Keep tracking slow-moving stock.",
    "detail": (
        "Your current obligations look stable. "
        "Use quick-add entries to keep decisions up to date."
    ),
    "severity": "info",
    "action_type": "watchlist",
    "target_entity": "Current workspace",
    "status": "watching",
}
MANUAL_ACTION = {
    "title": "Manual action entry",
    "detail": "Action was manually added during status update.",
    "severity": "info",
    "action_type": "manual_review",
    "target_entity": "Manual action",
}
FALLBACK_ACTION = {
    "action_type": "review_import",
    "target_entity": "Current workspace",
    "status": "watching",
}
DRAFT_RATIONALES = {
    "bill_review": "Recurring operating costs need a clear owner check before they land together.",
    "review_import": "Freshly imported records are only useful once the owner validates what changed.",
    "snoozed": "This action is snoozed and should be revalidated before execution.",
    "default": "Short-term cash preservation is better than carrying more slow inventory.",
}
DRAFT_TEXTS = {
    "bill_review": (
        "Review %s today, confirm the due amount, and decide whether it should be paid now, "
        "deferred, or offset by delaying a discretionary purchase."
    ),
    "review_import": (
        "Open the %s ledger, verify the most recent rows, and use the updated history in the "
        "next margin or cash-flow investigation."
    ),
    "snoozed": (
        "Before acting on %s, re-check whether the original trigger still applies and unsnooze "
        "if it is still operationally relevant."
    ),
    "default": (
        "Hello, we would like to stagger the next settlement and trim the dermatology reorder "
        "size for this cycle while we move the current inventory first."
    ),
}

# --- Fixed values: forecast -------------------------------------------------

DEFAULT_HORIZON_DAYS = 30
MIN_HORIZON_DAYS = 7
MAX_HORIZON_DAYS = 180
SHORT_HORIZON_DAYS = 45
METRICS = ["sales", "purchases", "recurring", "cash"]

# metric -> low factor, high factor up to 45 days, high factor beyond
FORECAST_FACTORS = {
    "sales": (0.94, 1.06, 1.03),
    "purchases": (0.88, 1.08, 1.08),
    "recurring": (0.95, 1.10, 1.10),
    "cash": (0.80, 1.15, 1.15),
}
FORECAST_BASELINES = {
    "sales": "Recent daily sales moving average: ",
    "purchases": "Recent daily purchase moving average: ",
    "recurring": "Current unpaid recurring obligations: ",
    "cash": "Current daily cash delta baseline: ",
}
FORECAST_WARNINGS = {
    "sales": [
        "Sales projection assumes similar OTC demand velocity.",
        "Projection drops if near-expiry stock is not rotated faster.",
    ],
    "purchases": [
        "Higher supplier dues may require staggered procurement.",
        "Underperforming lines should not be reordered at baseline pace.",
    ],
    "recurring": [
        "Utility and rent changes can widen this band quickly.",
        "Treat supplier obligations as high-priority cash events.",
    ],
    "cash": [
        "Cash projection assumes recurring dues are managed on time.",
        "Delayed supplier payment can protect cash short term but raise reorder risk.",
    ],
}
FORECAST_ASSUMPTIONS = [
    "Moving-average baseline over recent transactional history.",
    "Light seasonality uplift for short-horizon pharmacy demand.",
    "No abrupt structural shift in supplier availability.",
]

# --- Fixed values: scenarios ------------------------------------------------

# scenario -> summary, two deltas (metric, baseline, projected, impact), recommendations.
# "%.1f" takes the percentage; a baseline of "@sales" / "@cash" is that forecast's baseline.
SCENARIOS = {
    "supplier_price_increase": {
        "summary": "Supplier price increase scenario at +%.1f%%.",
        "deltas": [
            (
                "Purchase cost",
                "@sales",
                "+%.1f%% relative cost pressure",
                "Gross margin compression risk increases.",
            ),
            (
                "Cash runway",
                "@cash",
                "Lower buffer due to procurement inflation.",
                "Prioritize high-turn SKUs only.",
            ),
        ],
        "recommendations": [
            "Shift reorder budget toward high-turn and higher-margin SKUs.",
            "Negotiate staggered payment terms on supplier dues.",
        ],
    },
    "underperforming_product_line": {
        "summary": "Underperforming line scenario with slower sell-through.",
        "deltas": [
            (
                "Inventory carry",
                "Current carry aligned to recent demand",
                "Carry risk grows by roughly %.1f%%",
                "Dead stock and expiry risk rises.",
            ),
            (
                "Margin realization",
                "Current margin trajectory",
                "Potential markdown-driven margin erosion.",
                "Profit conversion declines.",
            ),
        ],
        "recommendations": [
            "Reduce reorder frequency for underperforming categories.",
            "Run targeted movement campaigns for aging lots.",
        ],
    },
    "delayed_reorder": {
        "summary": "Delayed reorder scenario balancing cash protection and stockout risk.",
        "deltas": [
            (
                "Short-term cash",
                "@cash",
                "Improves by ~%.1f%% temporarily",
                "Cash buffer improves in near term.",
            ),
            (
                "Stockout probability",
                "Current service level",
                "Higher risk for fast-moving SKUs.",
                "Potential missed revenue days.",
            ),
        ],
        "recommendations": [
            "Delay reorder only for low-turn SKUs.",
            "Protect minimum stock thresholds for high-turn essentials.",
        ],
    },
    "rent_electricity_increase": {
        "summary": "Rent/electricity increase scenario with fixed-cost pressure.",
        "deltas": [
            (
                "Recurring overhead",
                "Current recurring obligation baseline",
                "+%.1f%% fixed-cost burden",
                "Lower net cash conversion.",
            ),
            (
                "Break-even threshold",
                "Current daily break-even level",
                "Higher required daily revenue.",
                "More pressure on margin discipline.",
            ),
        ],
        "recommendations": [
            "Review non-essential operating spend for offset opportunities.",
            "Increase focus on better-margin product categories.",
        ],
    },
}

# --- Fixed values: questions ------------------------------------------------

BLOCKED_SUBSTRINGS = [
    "drop ", "delete ", "truncate ", "alter ", "grant ", "revoke ", ";", "--",
]
REFUSAL_SUMMARY = (
    "This request looks like a direct SQL control statement. "
    "Only safe, read-only business analytics prompts are supported."
)
REFUSAL_CONFIDENCE = 0.98
REFUSAL_EVIDENCE = (
    "Guardrail policy",
    "Only safe, read-only business analytics prompts are supported.",
    "query_guardrails",
)
REFUSAL_RISKS = ["Unsafe query attempt blocked."]
REFUSAL_RECOMMENDATIONS = [
    "Ask business questions such as 'why did profit drop?' or 'top selling SKUs this month'."
]
REFUSAL_PROVIDER = "policy-guard"

RECOMMEND_WORDS = ["forecast", "predict"]
INVESTIGATE_WORDS = ["why", "drop", "investigate"]

LOCAL_PROVIDER = "ollama-local"
CLOUD_INVESTIGATE_PROVIDER = "openai"
CLOUD_OTHER_PROVIDER = "openrouter"
COST_BASE = {"summarize": 0.0008, "investigate": 0.0032, "recommend": 0.0021}
COST_MIN_CHARS = 40
COST_CHARS_PER_UNIT = 2200

CONFIDENCE_BASE = 0.82
CONFIDENCE_CITATIONS = 0.04
CONFIDENCE_INSIGHT = 0.03
CONFIDENCE_CAP = 0.96

TOP_PRODUCTS_INSIGHT = "Top selling SKUs by revenue are %s."
NO_SALES_INSIGHT = "No sales rows are available yet for a top-product summary."
TOP_EXPENSES_INSIGHT = "Highest expense categories right now are %s."
NO_EXPENSES_INSIGHT = "No expense rows are available yet for category analysis."

UTILITY_EVIDENCE = (
    "Utility pressure",
    "Average utility burden is ₹%s this cycle.",
    "expense_entries.utilities",
)
SUPPLIER_EVIDENCE = (
    "Supplier cash pressure",
    "₹%s is the largest upcoming supplier obligation.",
    "recurring_obligations.supplier",
)
EXPIRY_EVIDENCE = (
    "Near-expiry risk",
    "%d product lots are inside the next 45-day near-expiry window.",
    "products.expiry_window_45d",
)
INSIGHT_EVIDENCE = ("Guarded SQL summary", "safe_sql_assistant")
CITATION_LABEL = "Document: "

SUMMARY_STEADY = (
    "Profit pressure is mainly from rising operating costs and near-term supplier cash "
    "obligations while tracked revenue is %s."
)
SUMMARY_ELEVATED = (
    "Profit pressure is elevated because margin is slipping below 22% while recurring "
    "supplier and utility costs remain high."
)
INVESTIGATION_RISKS = [
    "Recurring supplier and utility costs can compress short-term cash.",
    "Near-expiry inventory can force discounting and reduce realized margin.",
]
INVESTIGATION_RECOMMENDATIONS = [
    "Prioritize near-expiry SKUs in the next local promotion cycle.",
    "Delay low-priority reorders until after high-value supplier dues are cleared.",
    "Review expense categories weekly using the guarded SQL assistant prompts.",
]

# --- Fixed values: documents ------------------------------------------------

CHUNK_CHARS = 280
EMBEDDING_DIM = 24
SUMMARY_CHARS = 280
TABULAR_SUMMARY = "Tabular document with columns: "
OTHER_SUMMARY = (
    "Document stored successfully. "
    "Rich extraction and OCR are deferred to the next milestone."
)

# --- Fixed values: masking --------------------------------------------------

EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
PHONE_PATTERN = r"\p{Nd}{7,}"
EMAIL_KEYS = ["email"]
PHONE_KEYS = ["phone", "mobile"]
ADDRESS_KEYS = ["address"]
NAME_KEYS = ["name", "supplier", "supplier_name", "owner", "title"]
MASKED_PHONE = "+91-XXXX-XXXX"
MASKED_EMAIL_DOMAIN = "@example.com"
