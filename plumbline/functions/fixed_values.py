"""Word lists, lookup tables, constants and patterns.

Everything here is a stated value that results depend on, not logic.
"""

# Measurement vintages (decimal years) of the two report layouts.
VINTAGE_ANNEXURE = 2024.42
VINTAGE_SNAPSHOT = 2025.42

# Pace features.
MIN_ELAPSED_SHARE = 0.10
MAX_ELAPSED_SHARE = 6.0
MAX_SPEND_PACE = 12.0
MIN_DURATION_YEARS = 0.5
DEFAULT_ELAPSED_SHARE = 0.5
DEFAULT_SPEND_PACE = 1.0

# Encoders, label caps, fallbacks.
SMOOTHING_M = 20.0
RECENCY_HALF_LIFE = 4.0
ROLLING_WINDOW_YEARS = 5
TOR_CAP_MONTHS = 240.0
OVERRUN_RATIO_FLAG = 0.05
CURRENT_YEAR = 2026
DEFAULT_DURATION_YEARS = 5.0
DEFAULT_LAT_LON = (21.1458, 79.0882)

# Price index.
PRICE_REFERENCE_YEAR = 2024
FX_SECTORS = ("POWER", "PETROLEUM", "COAL", "MINES", "ATOMIC ENERGY", "STEEL")
MACRO_COLUMNS = ("wpi_inflation_pct", "cpi_inflation_pct", "repo_rate_pct", "gdp_growth_pct")

# Risk tiers (score at or above -> name).
TIERS = ((0.7, "Critical"), (0.45, "High"), (0.25, "Medium"))
LOWEST_TIER = "Low"

# Survival.
PERIOD_CAP = 14
MAX_PERIODS = 400
DEFAULT_PLANNED_MONTHS = 60.0
MIN_MONTHS = 0.5
DEFAULT_DOC_YEAR = 2030.0

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

MISSING_NUMBER_MARKS = ("N.A.", "NA", "-", "--", "")
JUNK_REASONS = ("nan", "n/a", "none", "nil", "as above", "-", "--", "—", "not available")
TOTAL_ROW_NAMES = ("total", "grand total")

AGENCY_PATTERN = r"\]\s*([^,\]]+?)\s*,"
SUFFIX_PATTERN = r"\]\s*([^\]\[]+)$"
CODE_PATTERN = r"\]\s*[A-Z0-9]*,\s*([A-Z]{2})\b"

# Canonical state or territory -> (latitude, longitude).
STATE_CENTROIDS = {
    "ANDHRA PRADESH": (15.9129, 79.7400),
    "ARUNACHAL PRADESH": (28.2180, 94.7278),
    "ASSAM": (26.2006, 92.9376),
    "BIHAR": (25.0961, 85.3131),
    "CHHATTISGARH": (21.2787, 81.8661),
    "GOA": (15.2993, 74.1240),
    "GUJARAT": (22.2587, 71.1924),
    "HARYANA": (29.0588, 76.0856),
    "HIMACHAL PRADESH": (31.1048, 77.1734),
    "JAMMU AND KASHMIR": (33.7782, 76.5762),
    "JHARKHAND": (23.6102, 85.2799),
    "KARNATAKA": (15.3173, 75.7139),
    "KERALA": (10.8505, 76.2711),
    "MADHYA PRADESH": (22.9734, 78.6569),
    "MAHARASHTRA": (19.7515, 75.7139),
    "MANIPUR": (24.6637, 93.9063),
    "MEGHALAYA": (25.4670, 91.3662),
    "MIZORAM": (23.1645, 92.9376),
    "NAGALAND": (26.1584, 94.5624),
    "ODISHA": (20.9517, 85.0985),
    "PUNJAB": (31.1471, 75.3412),
    "RAJASTHAN": (27.0238, 74.2179),
    "SIKKIM": (27.5330, 88.5122),
    "TAMIL NADU": (11.1271, 78.6569),
    "TELANGANA": (18.1124, 79.0193),
    "TRIPURA": (23.9408, 91.9882),
    "UTTAR PRADESH": (26.8467, 80.9462),
    "UTTARAKHAND": (30.0668, 79.0193),
    "WEST BENGAL": (22.9868, 87.8550),
    "DELHI": (28.7041, 77.1025),
    "LADAKH": (34.1526, 77.5771),
    "MULTI STATE": (21.1458, 79.0882),
    "PUDUCHERRY": (11.9416, 79.8083),
    "CHANDIGARH": (30.7333, 76.7794),
    "DADRA AND NAGAR HAVELI": (20.1809, 73.0158),
    "DAMAN AND DIU": (20.3974, 72.8328),
    "LAKSHADWEEP": (10.5667, 72.6417),
    "ANDAMAN AND NICOBAR": (11.7401, 92.7297),
}
NOT_A_PLACE = "MULTI STATE"
UNKNOWN = "UNKNOWN"

# Two-letter code -> canonical state.
STATE_CODES = {
    "AP": "ANDHRA PRADESH", "AR": "ARUNACHAL PRADESH", "AS": "ASSAM", "BR": "BIHAR", "CG": "CHHATTISGARH",
    "GA": "GOA", "GJ": "GUJARAT", "HR": "HARYANA", "HP": "HIMACHAL PRADESH", "JK": "JAMMU AND KASHMIR",
    "JH": "JHARKHAND", "KA": "KARNATAKA", "KL": "KERALA", "MP": "MADHYA PRADESH", "MH": "MAHARASHTRA",
    "MN": "MANIPUR", "ML": "MEGHALAYA", "MZ": "MIZORAM", "NL": "NAGALAND", "OD": "ODISHA", "PB": "PUNJAB",
    "RJ": "RAJASTHAN", "SK": "SIKKIM", "TN": "TAMIL NADU", "TS": "TELANGANA", "TR": "TRIPURA",
    "UP": "UTTAR PRADESH", "UK": "UTTARAKHAND", "WB": "WEST BENGAL", "DL": "DELHI", "LA": "LADAKH",
    "PY": "PUDUCHERRY", "CH": "CHANDIGARH", "AN": "ANDAMAN AND NICOBAR", "LD": "LAKSHADWEEP",
}

# Label as cut off in the state table -> canonical label.
TRUNCATED_STATES = {
    "ARUNACHAL PRAD": "ARUNACHAL PRADESH",
    "HIMACHAL PRADE": "HIMACHAL PRADESH",
    "JAMMU AND KASH": "JAMMU AND KASHMIR",
    "TRIPUR": "TRIPURA",
    "ANDAMAN AND NI": "ANDAMAN AND NICOBAR",
}

KNOWN_SECTORS = (
    "ATOMIC ENERGY", "CIVIL AVIATION", "COAL", "DEPARTMENT OF HIGHER EDUCATION", "DPIIT", "FINANCE",
    "HEALTH AND FAMILY WELFARE", "HOME AFFAIRS", "MINES", "PETROLEUM", "POWER", "RAILWAYS", "RENEWABLE ENERGY",
    "ROAD TRANSPORT AND HIGHWAYS", "SHIPPING AND PORTS", "STEEL", "SOCIAL JUSTICE", "TELECOMMUNICATIONS",
    "URBAN DEVELOPMENT", "WATER RESOURCES", "NEW & RENEWABLE ENERGY", "RAILWAY", "MINISTRY OF RAILWAYS",
    "AGRICULTURE", "COAL AND LIGNITE",
)

# Organisation code in a project name -> operating area.
ORG_AREAS = {
    "BCCL": "DHANBAD",
    "CCL": "HAZARIBAGH",
    "ECL": "ASANSOL",
    "MCL": "ANGUL",
    "NCL": "SINGRAULI",
    "SECL": "BILASPUR",
    "WCL": "NAGPUR",
    "SCCL": "KOTHAGUDEM",
    "NMDC": "DANTEWADA",
}

# Fuzzy name match.
FINGERPRINT_PREFIX = 6
FINGERPRINT_MIN_TOKEN = 5
FINGERPRINT_MIN_SHARED = 3
FINGERPRINT_STOP = (
    "of", "and", "the", "for", "to", "in", "on", "at", "a", "an", "new", "from", "with", "km", "nh",
    "section", "project", "laning", "lance", "road",
)

# Keyword -> sector fragment for searches.
SEARCH_SYNONYMS = {
    "civil aviation": ("airport", "airports", "aviation", "flight", "terminal"),
    "railways": ("rail", "railway", "railways", "train", "bullet train", "metro"),
    "road": ("road", "highway", "highways", "nhai", "expressway"),
    "power": ("power", "electricity", "energy", "thermal", "hydro", "solar"),
    "coal": ("coal", "mining", "mine", "mines"),
    "petroleum": ("petroleum", "oil", "gas", "refinery", "pipeline"),
}
SECTOR_SYNONYMS = {
    "airport": "CIVIL AVIATION",
    "aviation": "CIVIL AVIATION",
    "train": "RAILWAYS",
    "rail": "RAILWAYS",
    "highway": "ROAD TRANSPORT AND HIGHWAYS",
    "road": "ROAD TRANSPORT AND HIGHWAYS",
    "oil": "PETROLEUM",
    "gas": "PETROLEUM",
}
QUERY_STOP = (
    "explain", "about", "project", "tell", "what", "which", "status", "overrun", "risk", "cost", "delay",
    "the", "this", "that", "portfolio", "sector", "work",
)

# Cause phrases for the explanation data set.
HIGH_RISK_CAUSES = (
    "Delay in land acquisition and forest/environment clearances",
    "Slow progress of work due to contractor performance issues",
    "Delay in award of balance work / finalisation of contractor",
    "Litigation in court / arbitration over the project package",
    "Financing constraints and slow fund release",
    "Delay in statutory clearances and right-of-way approvals",
    "Geological/terrain challenges affecting construction progress",
    "Delay in finalisation of detailed design and drawings",
    "Slow progress of work by the state PWD / implementing agency",
    "Revised scope and additional works approved during execution",
)
LOW_RISK_CAUSE = "Project on schedule with no material execution bottlenecks reported"

# Two-condition tiers: name, least delay in months, least overrun in percent.
DELAY_COST_TIERS = (("Critical", 24, 40.0), ("High Risk", 12, 20.0), ("Medium Risk", 4, 5.0), ("Low Risk", 0, 0.0))

# Penalty months.
PENALTY_LAND_BELOW_50 = 18
PENALTY_LAND_BELOW_80 = 8
PENALTY_ENV_PENDING = 12
PENALTY_ENV_IN_REVIEW = 4
PENALTY_LITIGATION = 24
PENALTY_TIER_3 = 10
PENALTY_TIER_2 = 3
PENALTY_NORTH_EAST = 6
INTERACTION_SCALE = 0.6

# Words that cannot be part of a place candidate, without hyphens (fixed values).
PLACE_STOP = tuple(
    """
    A AN AND OR OF THE IN AT FOR ON FROM WITH TO BY AS LT IPR
    C O N E P R I S D T M X L K U V G J H F B
    NEW INDIA INDIAN NATIONAL INTERNATIONAL PROJECT PROJECTS SYSTEM SYSTEMS WORKS WORK DEVELOPMENT CONSTRUCTION
    EXTENSION EXPANSION UPGRADATION UPGRADE MASTER PLAN OPERATING OPERATION OPERATIONS CAPACITY POWER PLANT PLANTS
    ENHANCEMENT IMPROVEMENT MODERNISATION REHABILITATION RESTORATION REVITALISATION COMPLEX COMPLEXES CAMPUS CAMPUSES
    PHASE PHASES PHASEI PHASE1 STAGE STAGEI FACILITY FACILITIES BUILDING BUILDINGS TERMINAL TERMINALS AIRPORT AERODROME PORT PATAN TOWNSHIP
    HOUSING HEADQUARTERS OFFICE OFFICES BLOCK SECTION SECTIONS UNIT UNITS TYPE NOS NUMBER NO UNDER COMPLETION BEDDED
    BED PROGRAMME PROGRAM CIVIL MAINTENANCE GENERATION TRANSMISSION DISTRIBUTION SUPPLY TOWN CITY AREA REGION STATE
    DISTRICT ROAD ROADS HIGHWAY ODISHA BIHAR ETC
    """.split()
)
