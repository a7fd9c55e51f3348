"""Word lists, thresholds and names that decide results.

Everything here is data, not logic. Callers that need other values pass their own.
"""

# --- fixed values: calendar -------------------------------------------------
SEASON_LENGTH = {"monthly": 12, "weekly": 52, "daily": 7}
PERIOD_UNIT = {"monthly": "month", "weekly": "week", "daily": "day"}

# --- fixed values: numeric guards -------------------------------------------
ZERO = 1e-9
NUMERIC_SHARE = 0.8
AUTO_ZERO_SHARE = 0.20
MAD_TO_SIGMA = 1.4826
OUTLIER_SIGMAS = 6.0
OUTLIER_MIN_ROWS = 8
MIN_PERIODS = 6
SHORT_PERIODS = 12
MAX_HORIZON = 24
ADJUSTMENT_RANGE = (-90.0, 300.0)
INTERVAL_QUANTILE = 0.80

# --- fixed values: features --------------------------------------------------
ROLLING_WINDOWS = [2, 3, 6, 12]
STD_WINDOWS = [3, 6]
EWM_SPANS = [3, 6, 12]

# --- fixed values: models, in tie-break order ---------------------------------
MODELS = [
    "Seasonal naive",
    "AutoETS",
    "AutoARIMA",
    "Theta",
    "Croston",
    "TSB intermittent",
    "Ridge + drivers",
    "Histogram gradient boosting",
    "LightGBM + drivers",
    "Random forest",
    "Extra trees",
]
FALLBACK_MODEL = "Seasonal naive"
METHOD_FAMILIES = {
    "seasonal": ["Seasonal naive", "AutoETS", "Theta", "AutoARIMA"],
    "trend": ["AutoETS", "Theta", "AutoARIMA"],
    "intermittent": ["Croston", "TSB intermittent", "Seasonal naive"],
    "driver": [
        "Ridge + drivers",
        "Histogram gradient boosting",
        "LightGBM + drivers",
        "Random forest",
        "Extra trees",
    ],
}
ARIMA_ORDERS = [(0, 1, 1), (1, 1, 0), (1, 1, 1), (2, 1, 0), (0, 1, 2), (1, 0, 1)]
CROSTON_ALPHA = 0.12
TSB_ALPHA, TSB_BETA = 0.18, 0.12

# --- fixed values: ingest ----------------------------------------------------
SHEET_NAME_WEIGHTS = {
    "actual + forecast": 80,
    "demand": 45,
    "history": 45,
    "sales": 35,
    "forecast": 25,
    "budget": 15,
}
HEADER_KEYWORDS = [
    "date", "month", "week", "period", "time", "demand", "sales", "volume",
    "quantity", "customer", "article", "item", "sku", "category", "price",
]
PROBE_ROWS = 25
DATE_NAME_TOKENS = ["date", "month", "week", "period", "time"]
MATRIX_KEYS = ["Article Number", "Customer Name", "Customer Summary"]
MATRIX_METADATA = {
    "sku": "Article Number",
    "customer": "Customer Name",
    "customer_group": "Customer Summary",
    "category": "Category",
    "brand_family": "Brand Family",
    "technology": "Technology",
    "article_description": "Article Description",
    "selling_price": "Price 2026",
}
ROLE_TOKENS = {
    "date": ["date", "month", "period", "week"],
    "target": ["demand_tonnes", "demand", "sales", "shipment", "consumption", "target"],
    "item": ["series_id", "item_id", "sku", "product", "material"],
    "sku": ["sku", "stock_keeping_unit"],
    "category": ["category", "family", "product_group"],
    "customer": ["customer", "market", "channel"],
}
EVENT_TOKENS = ["event", "holiday", "promotion"]
EXTERNAL_TOKENS = [
    "market", "competitor", "inflation", "fx", "eur", "usd", "energy", "pulp",
    "weather", "economic", "gdp", "industry", "industrial", "environment", "logistics", "freight",
]
METADATA_COLUMNS = [
    "date", "series_id", "sku", "product_name", "category", "customer", "site", "province",
    "warehouse", "production_line", "supplier", "demand_tonnes", "revenue_eur", "record_type",
    "source_sheet", "inventory_on_hand_tonnes", "safety_stock_tonnes", "monthly_capacity_tonnes",
    "unit_cost_irr", "service_level_target",
]
PREFERRED_SIGNALS = [
    "customer_orders_index", "open_orders_tonnes", "backlog_tonnes", "working_days",
    "usd_irr_synthetic", "iran_cpi_yoy_synthetic", "industrial_production_index_synthetic",
    "global_pulp_price_usd_synthetic", "energy_curtailment_hours_synthetic",
    "import_lead_time_days_synthetic", "supplier_fill_rate_synthetic", "event_code",
]
OPERATIONAL_FIELDS = [
    "site", "province", "warehouse", "production_line", "supplier",
    "inventory_on_hand_tonnes", "safety_stock_tonnes", "lead_time_days",
    "monthly_capacity_tonnes", "unit_cost_irr", "service_level_target",
]
BLANK_WORDS = ["nan", "none", "<na>"]

# --- fixed values: operations -------------------------------------------------
SHEET_ALIASES = {
    "bom": ["bom", "bill of materials", "bill_of_materials"],
    "materials": ["materials", "material master", "material_master"],
    "open_pos": ["open pos", "open_po", "purchase orders", "open purchase orders"],
    "capacity": ["capacity", "capacity calendar", "production calendar"],
    "relationships": ["relationships", "product relationships", "substitutions"],
    "promotions": ["promotions", "promotion calendar", "events"],
}
REQUIRED_TABLES = ["bom", "materials", "capacity"]
REQUIRED_COLUMNS = {
    "bom": ["sku", "material_id", "quantity_per_tonne"],
    "materials": ["material_id", "material_name", "inventory_on_hand", "safety_stock", "lead_time_days", "moq"],
    "capacity": ["production_line", "period", "available_tonnes"],
    "open_pos": ["material_id", "due_date", "quantity"],
}
NUMERIC_COLUMNS = {
    "bom": ["quantity_per_tonne"],
    "materials": ["inventory_on_hand", "safety_stock", "lead_time_days", "moq"],
    "capacity": ["available_tonnes"],
    "open_pos": ["quantity"],
}
CLOSED_PO_STATUSES = ["cancelled", "closed", "received"]
UNMAPPED_LINE = "Unmapped"

# --- fixed values: plan ledger -------------------------------------------------
PLAN_TRANSITIONS = {
    "draft": ["review", "archived"],
    "review": ["draft", "approved", "archived"],
    "approved": ["review", "published", "archived"],
    "published": ["archived"],
    "archived": [],
}
LOCKED_STATES = ["approved", "published", "archived"]
EVIDENCE_STATES = ["approved", "published"]
DRIFT_WAPE_POINTS = 3.0
DRIFT_QUALITY_POINTS = -5.0
DRIFT_BIAS_PCT = 10.0

# --- fixed values: action wording and owners ------------------------------------
OWNER_MATERIAL = "Procurement"
OWNER_CAPACITY = "Production planning"
REVIEW_SEQUENCE = "Review sequence and planned downtime"
RELATIONSHIP_EVIDENCE = ("master-data relationship", "not inferred")
ANALOG_TYPE = "new_product_analog"
PLAN_STATES = ["draft", "review", "approved", "published", "archived"]
