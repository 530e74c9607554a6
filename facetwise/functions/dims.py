"""Fixed reference values.

FIXED VALUES — these must equal the values the reference service uses for its
results (size master ranges, code maps, display orders, default thresholds).
They are stated plainly, in natural order, and only ever used as data.
"""
from __future__ import annotations

# --- FIXED VALUES: size master (label, low carat, high carat), closed ranges ---
SIZE_MASTER = [
    ("0.90-0.99", 0.90, 0.99),
    ("1.00-1.10", 1.00, 1.10),
    ("1.11-1.15", 1.11, 1.15),
    ("1.16-1.24", 1.16, 1.24),
    ("1.25-1.30", 1.25, 1.30),
    ("1.31-1.45", 1.31, 1.45),
    ("1.46-1.49", 1.46, 1.49),
    ("1.50-1.60", 1.50, 1.60),
    ("1.61-1.74", 1.61, 1.74),
    ("1.75-1.85", 1.75, 1.85),
    ("1.86-1.95", 1.86, 1.95),
    ("1.96-1.99", 1.96, 1.99),
    ("2.00-2.10", 2.00, 2.10),
    ("2.11-2.24", 2.11, 2.24),
    ("2.25-2.34", 2.25, 2.34),
    ("2.35-2.45", 2.35, 2.45),
    ("2.46-2.49", 2.46, 2.49),
    ("2.50-2.59", 2.50, 2.59),
    ("2.60-2.74", 2.60, 2.74),
    ("2.75-2.95", 2.75, 2.95),
    ("2.96-2.99", 2.96, 2.99),
    ("3.00-3.10", 3.00, 3.10),
    ("3.11-3.24", 3.11, 3.24),
    ("3.25-3.49", 3.25, 3.49),
    ("3.50-3.60", 3.50, 3.60),
    ("3.61-3.74", 3.61, 3.74),
    ("3.75-3.95", 3.75, 3.95),
    ("3.96-3.99", 3.96, 3.99),
    ("4.00-4.10", 4.00, 4.10),
    ("4.11-4.24", 4.11, 4.24),
    ("4.25-4.49", 4.25, 4.49),
    ("4.50-4.60", 4.50, 4.60),
    ("4.61-4.74", 4.61, 4.74),
    ("4.75-4.99", 4.75, 4.99),
    ("5.00-5.10", 5.00, 5.10),
    ("5.11-5.24", 5.11, 5.24),
    ("5.25-5.49", 5.25, 5.49),
    ("5.50-5.74", 5.50, 5.74),
    ("5.75-5.99", 5.75, 5.99),
    ("6.00-6.24", 6.00, 6.24),
    ("6.25-6.49", 6.25, 6.49),
    ("6.50-6.74", 6.50, 6.74),
    ("6.75-6.99", 6.75, 6.99),
    ("7.00-7.24", 7.00, 7.24),
    ("7.25-7.49", 7.25, 7.49),
    ("7.50-7.74", 7.50, 7.74),
    ("7.75-7.99", 7.75, 7.99),
    ("8.00-8.24", 8.00, 8.24),
    ("8.25-8.49", 8.25, 8.49),
    ("8.50-8.74", 8.50, 8.74),
    ("8.75-8.99", 8.75, 8.99),
    ("9.00-9.24", 9.00, 9.24),
    ("9.25-9.49", 9.25, 9.49),
    ("9.50-9.74", 9.50, 9.74),
    ("9.75-9.99", 9.75, 9.99),
    ("10.00-10.20", 10.00, 10.20),
    ("10.21-10.99", 10.21, 10.99),
    ("11.00-11.20", 11.00, 11.20),
    ("11.21-11.99", 11.21, 11.99),
    ("12.00-12.99", 12.00, 12.99),
    ("13.00-13.99", 13.00, 13.99),
    ("14.00-14.99", 14.00, 14.99),
    ("15.00-20.99", 15.00, 20.99),
]

# --- FIXED VALUES: header aliases per canonical listing column (first present wins) ---
LISTING_ALIASES = {
    "market_id": ["unique stone id", "stone id", "id", "vdb_stone_id", "vdb stone id"],
    "inventory_id": ["packet #", "reportnumber", "report number", "srno", "diamax_stone_id", "stock #", "stock_id"],
    "shape": ["shape", "shapename", "stone shape"],
    "carat": ["carat weight", "weight", "wt", "carat", "cts", "ct"],
    "color": ["color", "colour", "stone color"],
    "clarity": ["clarity", "stone clarity"],
    "cut": ["cut", "cut grade"],
    "polish": ["polish"],
    "symmetry": ["symmetry"],
    "fluorescence": ["fluorescence", "flour", "flouro", "fluo"],
    "lab": ["lab", "laboratory"],
    "growth_type": ["growth type", "growth", "diamond type", "type"],
    "country": ["stone location", "location", "country", "origin"],
    "market_price": ["total", "ppc", "vdb_bottom_price", "vdb price", "market price"],
    "inventory_price": ["price a", "price b", "price c", "amt $", "amt", "ppc", "diamax_price", "cost", "price"],
}

# --- FIXED VALUES: sale-line header aliases (first present wins) ---
SALES_ALIASES = {
    "invoice": ["sale invoice no", "invoice no", "invoice number", "invoice", "bill no"],
    "stone": ["stone no", "stone id", "packet #", "packet no", "reportnumber", "report number", "certificate no"],
    "sale_date": ["completed sale date", "completed date", "sale invoicedate", "sale invoice date", "invoice date",
                  "transaction date", "sale date", "date"],
    "shape": ["shape", "shape name", "shapename", "stone shape"],
    "color": ["color", "colour", "color name", "colour name"],
    "clarity": ["clarity", "clarity name"],
    "carat": ["carat", "carat weight", "weight", "cts", "ct"],
    "amount": ["final amt", "invoice amt", "sale amt", "sale amount", "sales amount", "net amount", "total amount",
               "amount", "amt $"],
    "rate": ["finalrate", "final rate", "invoice rate", "sale rate", "price per carat", "rate", "ppc", "price/ct",
             "price per ct"],
}

# --- FIXED VALUES: words that mark a header line ---
HEADER_HINTS = ["unique stone id", "stone location", "packet #", "reportnumber", "report number", "invoice no", "sale rate", "sale amt", "shapename",
                "shape", "weight", "carat weight", "colour", "color", "clarity", "status", "ppc", "amt $"]

# --- FIXED VALUES: feed-role hint headers and filename words ---
ROLE_HEADER_HINTS = {
    "sales": ["invoice no", "sale rate", "sale amt"],
    "market": ["unique stone id", "stone location", "page_number", "max_page_number"],
    "inventory": ["packet #", "reportnumber", "report number", "amt $", "price a", "box no"],
}
ROLE_NAME_HINTS = {
    "sales": ["sales", "invoice"],
    "market": ["vdb", "evermine"],
    "inventory": ["diamax", "stock"],
}

# --- FIXED VALUES: grade code maps (upper-cased input -> canonical) ---
CUT_MAP = {
    "EX": "EXCELLENT", "EXCELLENT": "EXCELLENT", "EXCELL": "EXCELLENT",
    "VG": "VERY GOOD", "VERY GOOD": "VERY GOOD", "VERYGOOD": "VERY GOOD",
    "GD": "GOOD", "GOOD": "GOOD",
    "ID": "IDEAL", "IDEAL": "IDEAL",
    "F": "FAIR", "FAIR": "FAIR",
}

FLUORESCENCE_MAP = {
    "NON": "NONE", "NONE": "NONE", "NIL": "NONE", "N": "NONE",
    "FNT": "FAINT", "FAINT": "FAINT", "F": "FAINT", "VSL": "FAINT", "VSL/FAINT": "FAINT", "VERY SLIGHT": "FAINT",
    "SLIGHT": "FAINT", "SL": "FAINT", "SLIGHT/MEDIUM": "FAINT",
    "MED": "MEDIUM", "MEDIUM": "MEDIUM", "M": "MEDIUM",
    "STG": "STRONG", "STRONG": "STRONG", "VS": "STRONG", "VST": "STRONG", "VERY STRONG": "STRONG", "S": "STRONG",
}

COUNTRY_MAP = {
    "UNITED STATES": "USA", "USA": "USA", "US": "USA",
    "INDIA": "INDIA", "IND": "INDIA", "IN": "INDIA",
    "BELGIUM": "BELGIUM", "BEL": "BELGIUM",
    "ISRAEL": "ISRAEL", "ISR": "ISRAEL",
    "UNITED ARAB EMIRATES": "UAE", "UAE": "UAE",
    "HONG KONG": "HONG KONG", "HK": "HONG KONG",
}

SHAPE_MAP = {
    "RD": "ROUND", "RND": "ROUND", "ROUND": "ROUND",
    "OV": "OVAL", "OVL": "OVAL", "OVAL": "OVAL",
    "RA": "RADIANT", "RAD": "RADIANT", "RADIANT": "RADIANT",
    "PR": "PRINCESS", "PS": "PRINCESS", "PRINCESS": "PRINCESS",
    "PE": "PEAR", "PEAR": "PEAR",
    "MQ": "MARQUISE", "MARQ": "MARQUISE", "MARQUISE": "MARQUISE",
    "CU": "CUSHION", "CON": "CUSHION", "LCU": "CUSHION", "LCUV": "CUSHION", "CUSHION": "CUSHION",
    "AS": "ASSCHER", "ASSCHER": "ASSCHER",
    "EC": "EMERALD", "EM": "EMERALD", "EMERALD": "EMERALD",
    "HM": "HEART", "HEART": "HEART",
}

# Leading shape qualifiers removed before the code lookup.
SHAPE_PREFIXES = ["SQ", "LONG", "LG"]

# --- FIXED VALUES: display orders ---
PREFERRED_SHAPE_ORDER = ["ROUND", "OVAL", "EMERALD", "RADIANT", "PRINCESS", "PEAR", "MARQUISE", "HEART", "CUSHION",
                         "ASSCHER"]
MATRIX_COLORS = ["D", "E", "F", "G"]
MATRIX_CLARITIES = ["IF", "VVS1", "VVS2", "VS1", "VS2", "SI1", "SI2", "I1"]
PRICE_MATRIX_COLORS = ["D", "E", "F", "G", "H", "I", "J", "K"]
PRICE_MATRIX_CLARITIES = ["VVS1", "VVS2", "VS1", "VS2", "SI1", "SI2"]
GRID_CLARITIES = ["VVS1", "VVS2", "VS1", "VS2"]

# --- FIXED VALUES: label sets that histograms zero-fill ---
DEMAND_LABELS = ["Excellent Demand", "Good Demand", "Average Demand", "Slow Moving", "Dead Inventory"]
CONFIDENCE_LABELS = ["High Confidence", "Medium Confidence", "Low Confidence"]

# --- FIXED VALUES: recommendation thresholds (market difference %, defaults) ---
DEFAULT_RULES = {
    "premium_threshold": 15.0,
    "sell_now_threshold": 10.0,
    "good_opp_threshold": 5.0,
    "wait_threshold": 3.0,
}

# --- FIXED VALUES: alerts (relative own-price move; type -> title, message; {} is the recommendation) ---
ALERT_PRICE_MOVE = 0.01
ALERT_TEXTS = {
    "PRICE_CHANGE": ("Price Changed", "Price for stone changed."),
    "{}_ALERT": ("Recommendation changed to {}", "Stone recommendation is now {}."),
    "NEW_MATCH": ("New Match Found", "A new match was found."),
}

# --- FIXED VALUES: live status words ---
INVENTORY_LIVE_STATUS = "AVAILABLE"

# Ten attributes of the exact match, in key order.
MATCH_KEYS = ["shape", "carat", "color", "clarity", "cut", "polish", "symmetry", "fluorescence", "lab", "country"]
# Profile used by exact-profile comparables (carat replaced by its size range; no country).
PROFILE_KEYS = ["size_range", "shape", "color", "clarity", "cut", "polish", "symmetry", "fluorescence", "lab"]
COHORT_KEYS = ["size_range", "shape", "color", "clarity"]
