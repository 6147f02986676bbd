"""Fixed values shared by the operators.

Everything in this file is data that decides results (spellings, limits, code
lists).  There is no logic here.
"""

# Header spellings (lower case, trimmed) of each canonical column.
HEADER_SPELLINGS = {
    "site_name": ["site", "sites", "site_name"],
    "cp_id": ["cp id", "cp_id", "cpid", "charging_point_id", "display id"],
    "connector_type": ["connector type", "connector_type", "charging_type", "te_charge_type"],
    "connector": ["connector", "connector id", "connector_id", "connecto id"],
    "currency": ["currency", "curr"],
    "amount": ["amount", "amt"],
    "consumption_kwh": ["consum", "consum(kwh)", "consumed"],
    "duration": ["duration", "duration_time"],
    "start_time": ["start", "start time", "starttime", "start_time"],
    "end_time": ["end"],
}
REQUIRED_RAW_COLUMNS = ["cp_id", "connector", "start_time", "consumption_kwh", "duration"]
OPTIONAL_RAW_COLUMNS = ["site_name", "connector_type", "currency", "amount"]

# Limits of a valid session.
MAX_DURATION_MINUTES = 24 * 60
MIN_DURATION_MINUTES = 1
MAX_CONSUMPTION_KWH = 300

# Connector type spellings and identifiers that mean "missing".
CONNECTOR_TYPES = {
    "ac": "AC",
    "dc": "DC",
    "rapid": "Rapid",
    "rapid dc": "Rapid DC",
    "fast ac": "Fast AC",
    "slow ac": "Slow AC",
}
MISSING_IDS = ["nan", "none", "na", ""]

# Power type codes of the location feed.
POWER_TYPES = {"AC_1_PHASE": "AC", "AC_2_PHASE": "AC", "AC_3_PHASE": "AC", "DC": "DC"}

# Curated corrections by charge point.
POSTCODE_OVERRIDES = {
    "61203": "ML11 8RP",
    "61204": "ML11 8RP",
    "61205": "ML11 8RP",
    "61206": "ML11 8RP",
    "61691": "FK10 4LD",
}
COORDINATE_OVERRIDES = {"53143": (55.066793, -3.169327)}

# Sanity floors of a location snapshot and its file name.
MIN_LOCATIONS = 1000
MIN_CONNECTORS = 1000
SNAPSHOT_PREFIX = "Scotland_chargepoint_locations_"
SNAPSHOT_SUFFIX = ".json"

# File checks.
MIN_FILE_BYTES = 50000
XLSX_MAGIC_HEX = "504B0304"

# Month names, in the order in which a name search tries them.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3,
    "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
PREFERRED_KEYWORDS = ["CLEAN", "NEW"]
FIRST_MONTH = "2022-10-01"
LAST_MONTH = "2026-05-31"
COVERAGE_ALERT_PCT = 95.0

# Ranking.
MIN_SESSIONS = 100
PRESSURE_WEIGHTS = {"saturation_rate": 0.6, "utilisation": 0.4}

# Postcode areas of the network and their place names.
POSTCODE_AREAS = {
    "AB": "Aberdeen", "DD": "Dundee", "DG": "Dumfries", "EH": "Edinburgh",
    "FK": "Falkirk", "G": "Glasgow", "HS": "Outer Hebrides", "IV": "Inverness",
    "KA": "Kilmarnock", "KW": "Kirkwall", "KY": "Kirkcaldy", "ML": "Motherwell",
    "PA": "Paisley", "PH": "Perth", "TD": "Borders", "ZE": "Shetland",
}

# Session-length bands (upper limit in minutes, label), display order.
DURATION_BANDS = [(30, "<30m"), (60, "30-60m"), (120, "1-2h"), (240, "2-4h"), (480, "4-8h")]
LONGEST_BAND = "8h+"
BAND_ORDER = ["8h+", "4-8h", "2-4h", "1-2h", "30-60m", "<30m"]
WEEKDAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Postcode check.
POSTCODE_CHECK = "charge_points.postcode_triangulation"
VERDICT_TEXT = {
    "postcode_not_scottish": "not a Scottish postcode area",
    "area_mismatch": "postcode area disagrees with the coordinates",
    "postcode_missing": "no postcode on record",
}
NEAREST_RADIUS_M = 2000.0
