"""Fixed values the operators share. They must equal the published rules, so they are data, not code."""

# --- fixed values: record statuses and their accepted spellings -------------------------------
STATUSES = ["upcoming", "success", "failure", "in_flight", "aborted"]

STATUS_SYNONYMS = {
    "success": "success",
    "successful": "success",
    "failure": "failure",
    "failed": "failure",
    "upcoming": "upcoming",
    "scheduled": "upcoming",
    "in_flight": "in_flight",
    "in-flight": "in_flight",
    "aborted": "aborted",
    "cancelled": "aborted",
    "canceled": "aborted",
}

STATUS_CLASSES = {
    "success": ["success", "successful", "completed"],
    "failure": ["failure", "failed", "unsuccessful"],
    "upcoming": ["upcoming", "scheduled", "planned"],
    "aborted": ["aborted", "cancelled", "canceled", "scrubbed"],
    "in_flight": ["in_flight", "in-flight", "active", "flying"],
}

# --- fixed values: conflict weights and thresholds -------------------------------------------
FIELD_WEIGHTS = {
    "mission_name": 1.0,
    "launch_date": 0.9,
    "status": 0.8,
    "vehicle_type": 0.7,
    "payload_mass": 0.6,
    "orbit": 0.5,
    "details": 0.3,
    "mission_patch_url": 0.2,
    "webcast_url": 0.2,
}
KEY_FIELDS = ["mission_name", "launch_date", "status"]
BASE_CONFLICT_FIELDS = [
    "mission_name",
    "launch_date",
    "vehicle_type",
    "payload_mass",
    "orbit",
    "status",
    "details",
]
DETECT_DATE_TOLERANCE_S = 7200
DETECT_NUMERIC_TOLERANCE_PCT = 10.0
BASE_DATE_TOLERANCE_S = 3600
BASE_NUMERIC_TOLERANCE = 0.1
NAME_OVERLAP = 0.7

# --- fixed values: source trust --------------------------------------------------------------
SOURCE_PRIORITIES = {
    "spacex": 1,
    "spacex.com": 1,
    "nasa": 2,
    "nasa.gov": 2,
    "spacex_press_kit": 3,
    "wikipedia": 4,
    "wikipedia.org": 4,
}
PRIORITY_NAMES = {
    1: "SPACEX_OFFICIAL",
    2: "NASA_OFFICIAL",
    3: "SPACEX_PRESS_KIT",
    4: "WIKIPEDIA",
    5: "UNKNOWN",
}
UNKNOWN_PRIORITY = 5

# (source, display name, base URL, default quality)
SOURCE_CATALOG = [
    ("spacex", "SpaceX Official Website", "https://www.spacex.com/launches", 0.9),
    ("nasa", "NASA Official Website", "https://www.nasa.gov/search/?q=spacex+launch", 0.8),
    ("wikipedia", "Wikipedia", "https://en.wikipedia.org/wiki/List_of_Falcon_9_and_Falcon_Heavy_launches", 0.7),
    ("pdf", "PDF Document", None, 0.6),
]
WEB_SOURCES = ["spacex", "nasa", "wikipedia"]

# --- fixed values: completeness and information scores ---------------------------------------
COMPLETENESS_WEIGHTS = {
    "slug": 2.0,
    "mission_name": 2.0,
    "status": 2.0,
    "launch_date": 1.5,
    "vehicle_type": 1.0,
    "payload_mass": 1.0,
    "orbit": 1.0,
    "details": 0.5,
    "mission_patch_url": 0.5,
    "webcast_url": 0.5,
}
INFO_WEIGHTS = {
    "launch_date": 2,
    "vehicle_type": 1,
    "payload_mass": 1,
    "orbit": 1,
    "mission_patch_url": 1,
    "webcast_url": 1,
}
INFO_DETAILS_WEIGHT = 2
INFO_DETAILS_MIN_CHARS = 50
DATE_TOLERANCE_HOURS = 24

# --- fixed values: histogram buckets, in seconds ---------------------------------------------
HISTOGRAM_BUCKETS = {
    "scraping": [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0],
    "processing": [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0],
    "db": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0],
    "http": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0],
    "tasks": [1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 600.0, 1800.0, 3600.0],
}

# --- fixed values: admission limits (endpoint, requests, window seconds) ---------------------
ENDPOINT_LIMITS = [
    ("/api/launches", 200, 3600),
    ("/api/launches/upcoming", 300, 3600),
    ("/api/launches/historical", 150, 3600),
    ("/api/admin/refresh", 10, 3600),
    ("/api/admin/system/stats", 60, 3600),
    ("/api/admin/system/health", 120, 3600),
]
DEFAULT_LIMIT = (100, 3600)

# --- fixed values: extraction vocabulary -----------------------------------------------------
TABLE_INDICATORS = [
    "launch", "mission", "date", "rocket", "payload", "falcon", "dragon", "outcome", "result",
]
# Priority order matters: the first role whose word occurs in the header wins.
HEADER_ROLES = [
    ("date", ["date", "time"]),
    ("mission", ["mission", "name"]),
    ("vehicle", ["rocket", "vehicle", "launcher"]),
    ("payload", ["payload", "cargo"]),
    ("outcome", ["outcome", "result", "status"]),
    ("orbit", ["orbit", "destination"]),
    ("mass", ["mass", "weight"]),
]
CARD_KEYWORDS = [
    "falcon", "dragon", "starlink", "crew", "mission", "launch", "rocket", "payload", "orbit", "landing",
]
NEWS_MENTION_KEYWORDS = ["spacex", "space x", "falcon", "dragon", "crew dragon", "cargo dragon"]
NEWS_RECORD_KEYWORDS = ["spacex", "space x", "falcon", "dragon", "crew", "cargo"]
LIST_KEYWORDS = ["launch", "mission", "falcon", "dragon"]
GENERIC_TITLE_TERMS = ["nasa", "press release", "news", "update", "statement"]
IMAGE_KEYWORDS = ["patch", "mission", "logo"]
WEBCAST_KEYWORDS = ["watch", "webcast", "live", "stream"]
VIDEO_HOSTS = ["youtube.com", "youtu.be", "twitch.tv"]

# Ordered status vocabularies per kind of page; the first group with a hit decides.
STATUS_WORDS = {
    "card": [
        ("success", ["success", "successful", "completed"]),
        ("failure", ["failure", "failed", "unsuccessful"]),
        ("aborted", ["abort", "cancelled", "scrub"]),
        ("in_flight", ["in flight", "flying", "active"]),
        ("upcoming", ["upcoming", "scheduled", "planned"]),
    ],
    "news": [
        ("success", ["successful", "success", "completed", "landed"]),
        ("failure", ["failed", "failure", "unsuccessful", "lost"]),
        ("aborted", ["abort", "cancelled", "scrub", "delayed"]),
        ("upcoming", ["upcoming", "scheduled", "planned", "will launch"]),
    ],
    "table": [
        ("success", ["success", "successful", "nominal"]),
        ("failure", ["failure", "failed", "lost", "destroyed"]),
        ("aborted", ["abort", "cancelled", "scrub"]),
        ("success", ["partial", "degraded"]),
    ],
    "list": [
        ("success", ["success", "successful"]),
        ("failure", ["failure", "failed"]),
        ("aborted", ["abort", "cancelled"]),
    ],
}
VEHICLE_PATTERNS = {
    "card": [r"(Falcon\s+9)", r"(Falcon\s+Heavy)", r"(Starship)", r"(Dragon)"],
    "news": [r"(Falcon\s+9)", r"(Falcon\s+Heavy)", r"(Dragon)", r"(Crew\s+Dragon)", r"(Cargo\s+Dragon)"],
    "list": [r"(Falcon\s+9)", r"(Falcon\s+Heavy)", r"(Dragon)"],
}
VEHICLE_CANONICAL = [(r"falcon\s*9", "Falcon 9"), (r"falcon\s*heavy", "Falcon Heavy"), (r"dragon", "Dragon")]
MISSION_PATTERNS = {
    "card": [
        r"(Starlink[\s\-]*\d*[\s\-]*\w*)",
        r"(Crew[\s\-]*\d*[\s\-]*\w*)",
        r"(CRS[\s\-]*\d*)",
        r"(NROL[\s\-]*\d*)",
        r"(\w+[\s\-]*\d*[\s\-]*Mission)",
        r"(Falcon\s+(?:9|Heavy)[\s\-]*\w*)",
    ],
    "news": [
        r"(SpaceX\s+(?:Crew|CRS|Cargo)[\s\-]*\d*[\s\-]*\w*)",
        r"(Crew[\s\-]*\d*[\s\-]*Mission)",
        r"(CRS[\s\-]*\d*)",
        r"(Dragon[\s\-]*\w*[\s\-]*Mission)",
        r"(Commercial\s+Crew[\s\-]*\w*)",
    ],
    "mention": [
        r"(Starlink[\s\-]*\d*[\s\-]*\w*)",
        r"(Crew[\s\-]*\d*[\s\-]*\w*)",
        r"(CRS[\s\-]*\d*)",
        r"(Dragon[\s\-]*\w*[\s\-]*Mission)",
        r"(Falcon\s+(?:9|Heavy)[\s\-]*\w*)",
    ],
}
# Date patterns in the order each kind of text tries them.
ISO_DATE = r"(\d{4}-\d{2}-\d{2})"
MONTH_FIRST_DATE = r"(\w+\s+\d{1,2},?\s+\d{4})"
DAY_FIRST_DATE = r"(\d{1,2}\s+\w+\s+\d{4})"
SLASHED_DATE = r"(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4})"
SECTION_HEADERS = [
    r"MISSION\s+OVERVIEW",
    r"LAUNCH\s+DETAILS",
    r"VEHICLE\s+INFORMATION",
    r"PAYLOAD\s+INFORMATION",
    r"---\s*Page\s+\d+\s*---",
]
SECTION_MIN_CHARS = 100
# Labels tried in order for each press-kit field.
SECTION_LABELS = {
    "mission_name": [r"Mission", r"Mission\s+Name", r"Launch"],
    "launch_date": [r"Launch\s+Date", r"Date", r"Scheduled"],
    "vehicle": [r"Vehicle", r"Rocket", r"Launch\s+Vehicle"],
    "payload": [r"Payload", r"Cargo", r"Mission\s+Payload"],
    "orbit": [r"Orbit", r"Target\s+Orbit", r"Destination"],
    "mass": [r"Mass", r"Payload\s+Mass", r"Weight"],
}
OVERVIEW_LABELS = {"mission_name": [r"Launch", r"Mission"], "vehicle": [r"Vehicle"], "payload": [r"Payload"]}
TECHNICAL_LABELS = {
    "launch_date": [r"Launch\s+Date"],
    "mission_name": [r"Mission\s+Name"],
    "vehicle": [r"Vehicle"],
    "mass": [r"Payload\s+Mass"],
    "orbit": [r"Target\s+Orbit"],
}

# --- fixed values: logs and requests ---------------------------------------------------------
SENSITIVE_KEY_PARTS = ["password", "token", "secret", "key", "authorization"]
REDACTED = "[REDACTED]"
NOISE_EXCEPTIONS = ["HTTPException", "ValidationError"]
NOISE_WORDS = ["connection", "timeout"]
LOG_LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
