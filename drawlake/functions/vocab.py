"""Word lists and patterns that decide classifications. They are data: change them and results change."""

from __future__ import annotations

# Rooms, by whole token or neighbouring tokens of the name (entries with blanks also as substrings).
CORRIDOR = ("corridor", "corr", "hallway", "hall", "passage", "gallery", "circulation", "walkway")
VEHICLE = ("parking", "garage", "vehicle", "bay", "loading dock", "loading", "auto", "car")
MEP = (
    "mechanical", "mech", "electrical", "elec", "plumbing", "utility", "utl", "riser", "telecom", "data", "server", "idf", "mdf", "ahu", "vav", "fan",
    "boiler", "chiller", "generator", "switchgear", "transformer", "pump", "cooling", "hvac", "sprinkler", "fire", "air", "handler",
)
STORAGE = ("storage", "storeroom", "closet", "supply", "supplies", "janitor", "jan")
VARIABLE_USE = (
    "training", "multipurpose", "multi-purpose", "flex", "flexible", "adaptable", "convertible", "assembly", "conference", "seminar", "meeting", "classroom", "lecture",
    "collaboration", "collab", "collaborative", "breakout", "co-working", "coworking", "ideation", "workshop", "huddle",
)
RESTROOM = ("restroom", "bathroom", "toilet", "wc", "lavatory", "washroom", "rr", "wrr", "mrr", "unr", "pw", "pw1", "pw2")
WOMEN = ("women", "womens", "woman", "women's", "female", "girls", "girl", "ladies", "lady")
MEN = ("men", "mens", "man", "men's", "male", "boys", "boy", "gentlemen", "gents")
UNISEX = ("unisex", "gender neutral", "gender-neutral", "all gender", "family", "single", "single-user", "single user", "accessible", "companion care", "companion")
ELEVATOR = ("elevator", "elev", "lift", "escalator", "ele")
STAIR = ("stair", "stairs", "stairwell", "staircase", "stair tower")
PUBLIC = ("lobby", "entry", "entrance", "foyer", "vestibule", "narthex", "atrium", "reception", "front desk", "welcome", "concourse", "main entry", "public", "grand")
OCCUPIED = (
    "office", "conference", "lobby", "reception", "waiting", "classroom", "training", "meeting", "breakout", "collaboration", "workspace", "workroom", "collab",
    "collaborative", "seminar", "lecture", "huddle", "flex",
)
ASSEMBLY = (
    "worship", "sanctuary", "chapel", "auditorium", "fellowship", "cafeteria", "gymnasium", "gym", "ballroom", "banquet", "theater", "theatre", "amphitheater", "stage",
    "arena", "community", "multipurpose hall", "great hall", "grand hall",
)
OFFICE = ("office", "offices", "exec ", "executive", "director", "principal", "manager", "partner", "admin", "administration", "administrative", "admin office", "private office", "workroom", "workspace")
SUITE = ("suite", "suites", "ste ", "tenant", "tenant suite", "office suite", "tenant space")
STAFF_RESTROOM = ("staff", "employee", "private", "back of house", "service")
ACCESSIBLE = ("accessible", "ada", "handicap")

# Rooms as drawings label them: substrings, or whole words where said.
LABEL_RESTROOM = ("TOILET", "BATH", "SHOWER", "RESTROOM", "LAVATORY", "WASHROOM")
LABEL_RESTROOM_WORDS = ("WC", "MRR", "WRR", "MR", "WR", "RR")
LABEL_ELEVATOR = ("ELEV", "ELEVATOR", "LIFT")
LABEL_VESTIBULE = ("VEST", "VESTIBULE")
LABEL_CORRIDOR = ("HALL", "CORR", "CORRIDOR", "LOBBY", "FOYER")
LABEL_VEHICLE = ("APPARATUS", "VEHICLE BAY", "SALLY PORT", "GARAGE", "BAY")
LABEL_MEP = ("MECHANICAL", "MECH", "ELECTRICAL", "ELEC", "DATA", "IT ROOM", "SERVER", "FIRE SPRINKLER", "TELECOM", "TELEPHONE", "COMM", "MDF", "IDF", "SPRINKLER", "RISER", "JANITOR", "JAN", "UTIL", "UTILITY")
LABEL_VARIABLE_WORDS = (
    "TRAINING", "COMMUNITY", "EOC", "MULTIPURPOSE", "MULTI-PURPOSE", "CONFERENCE", "MEETING", "BREAKOUT", "CLASSROOM", "ASSEMBLY ROOM", "COLLABORATION", "COLLAB",
    "COLLABORATIVE", "CO-WORKING", "COWORKING", "IDEATION", "WORKSHOP", "HUDDLE", "FLEX", "FLEXIBLE", "GYM", "LAB", "ART",
)
LABEL_STORAGE = ("STORAGE", "CLOSET", "STOREROOM")
LABEL_PUBLIC = ("LOBBY", "RECEPTION", "WAITING", "ENTRY", "ENTRANCE", "VISITOR", "ATRIUM", "CONCOURSE", "FOYER")
LABEL_STAFF = ("STAFF", "EMPLOYEE", "CREW", "PERSONNEL")
KNOWN_SHORT = ("WC", "MR", "WR", "RR", "MRR", "WRR", "MDF", "IDF", "JAN", "BAY", "EOC", "GYM", "LAB", "ART")
RESIDENTIAL_UNIT = r"(?i)^(?:\d{1,4}[A-Z]?$|(?:UNIT|APT|STE)\s)"

# Sheet titles, by substring of the lowered title.
FLOOR_PLAN = ("floor plan", "level plan", "first floor", "second floor", "third floor", "fourth floor", "fifth floor", "ground floor", "mezzanine", "basement", "main level", "lower level", "upper level", "attic floor plan")
NOT_FLOOR_PLAN = (
    "ceiling", "reflected ceiling", "rcp", "roof", "attic plan", "framing", "structural", "foundation", "demolition", "electrical", "power", "mechanical", "plumbing", "sanitary",
    "water", "fire", "safety", "protection", "lighting", "site", "furniture", "finish", "f&e", "dimensional", "restroom", "public restroom", "general notes", "abbreviation",
    "cover sheet", "cover page", "sheet index", "title sheet", "egress", "photometric", "sprinkler",
)
SIGN_SCHEDULE = (
    "sign schedule", "signage schedule", "sign spec", "sign specification", "sign legend", "sign program", "sign list", "sign detail schedule", "sign type detail",
    "sign panel detail", "signage plan", "signage", "signage criteria", "sign criteria",
)
SCHEDULE_ALSO = ("plaque", "sign types")
LIFE_SAFETY = ("life safety", "egress", "code plan", "code compliance", "exiting", "occupant load")
KEY_PLAN = ("key plan", "overall key")
IGNORED_PLANS = (
    "reflected ceiling", "roof plan", "demolition plan", "site plan", "framing plan", "structural plan", "mechanical plan", "electrical plan", "plumbing plan",
    "fire protection plan", "lighting plan", "power plan", "sprinkler plan", "photometric plan", "furniture plan", "finish plan",
)
GENERAL_NOTES = ("general notes", "abbreviations", "symbols", "mounting heights", "typical details")
ACCESSIBILITY = ("accessibility", "ada", "maab", "cbc 11b", "barrier-free")
MILLWORK = ("millwork", "casework", "interior elevations", "interior details")
SPECIFICATIONS = ("specifications", "specs")
SHEET_ONLY_VETO = ("elevation", "section", "detail", "stair", "wall", "diagram", "perspective")
FLOOR_PLAN_SHEET = r"(?i)^A(?:[-.]?[123]\d{2}|[123]\.\d+)$"
GENERAL_NOTES_SHEET = r"(?i)^(?:A[-.]?00[01]|G[-.]?\d+)$"
MILLWORK_SHEET = r"(?i)^A[-.]?[78]\d{2}$"
LEVEL_PLAN = r"\b\w+ level plan\b"
FLOOR_PLAN_REFERENCE = r"\b(?:see|per|ref(?:erence)?|refer\s+to|as\s+shown\s+on|shown\s+on)\s+floor\s+plan\b"

# Levels: what a title says, and the name it stands for; the first that occurs counts.
LEVELS = (
    ("B1", ("lower level", "basement", "sub-grade", "below grade", "b1")),
    ("L1", ("first floor", "level 1", "main level", "ground floor", "grade level", "l1")),
    ("L2", ("second floor", "level 2", "upper level", "l2")),
    ("L3", ("third floor", "level 3", "l3")),
    ("L4", ("fourth floor", "level 4", "l4")),
    ("L5", ("fifth floor", "level 5", "l5")),
    ("L6", ("sixth floor", "level 6", "l6")),
    ("L7", ("seventh floor", "level 7", "l7")),
    ("MEZZ", ("mezzanine", "mezz")),
    ("ROOF", ("penthouse", "roof level")),
    ("ATTIC", ("attic",)),
)
CANONICAL_LEVELS = ("lower level", "main level", "upper level", "first floor", "second floor", "third floor", "fourth floor", "fifth floor", "ground floor", "basement", "mezzanine", "attic")

# Knowledge files.
KNOWLEDGE_FIELDS = ("jurisdiction", "doc_type", "section", "effective_date", "status")
KNOWLEDGE_STATUS = ("active", "superseded", "draft")
KNOWLEDGE_TYPES = ("federal_codes", "state_codes", "city_codes", "sign_glossary", "plan_guides", "customer_standards")
SENTENCE_ENDS = (". ", ".\n", "! ", "!\n", "? ", "?\n", "\n\n")

# Sign schedules.
SIGN_TYPE_CODE = r"^\d{1,2}[A-Za-z]{0,2}$"
SCHEDULE_ROOM_NUMBER = r"^(?:[A-Za-z]{0,2}-?\d{2,4}[A-Za-z]?|[A-Za-z]\d{2,3}[A-Za-z]?|\d{1,4}[A-Za-z]{1,2}|\d{1,4})$"
QUANTITY = r"^\d{1,3}$"
DIMENSION = "[\\d/][\\d\\s/]*[\"'′″]"
KEYNOTE_CODE = "^[A-Z]$"
DIAGRAM_LABEL = r"(?i)^SIGN\s+TYPE\s+(\d{1,2}[A-Za-z]{1,2})$"
HEADING_PREFIXES = ("UNIT", "SUITE", "ROOM", "APT", "STE", "RM")
HEADING_ROOM_WORDS = (
    "COLLAB", "COLLABORATION", "CONFERENCE", "CONF", "WOMEN", "WOMENS", "MEN", "MENS", "RESTROOM", "RESTROOMS", "BREAKOUT", "BREAKROOM", "LOUNGE", "LOBBY", "CORRIDOR", "HALLWAY", "RECEPTION", "OFFICE",
    "SANCTUARY", "CHAPEL", "FELLOWSHIP", "COMMONS", "VESTIBULE", "NARTHEX", "STORAGE", "UTILITY", "JANITOR", "MECHANICAL", "ELECTRICAL", "SERVER", "KITCHEN", "CAFE", "GYMNASIUM", "GYM", "CLASSROOM",
    "LIBRARY", "AUDITORIUM", "STAGE",
)

# Words that name a room by themselves, and short forms that count as labels (lowered).
ROOM_WORDS = (
    "wrr", "womens", "women's", "women", "girls", "mrr", "mens", "men's", "men", "boys", "corridor", "corr", "hallway", "hall", "lobby", "reception", "foyer", "entry", "entrance", "vestibule", "narthex",
    "mech", "mechanical", "elec", "electrical", "stair", "stairwell", "stairs", "elev", "elevator", "lift", "restroom", "toilet", "wc", "lavatory", "bathroom", "office", "conference", "collab",
    "collaboration", "meeting", "classroom", "training", "storage", "stor", "closet", "sanctuary", "chapel", "worship", "fellowship", "commons", "community", "multipurpose", "sacristy", "vestry", "clergy",
    "console", "server", "data", "telecom", "idf", "mdf", "janitor", "custodial", "housekeeping", "jan", "break", "lounge", "kitchen", "café", "cafe", "breakroom", "utl", "utility", "riser", "patio",
    "terrace", "courtyard", "atrium", "stage", "platform", "balcony", "auditorium", "amphitheater", "amphitheatre", "black box", "blackbox", "auditorium stage", "drama", "orchestra", "coat room",
    "coatroom", "cloakroom", "green room", "greenroom", "gymnasium", "gym", "aux gym", "auxiliary gym", "weight room", "weight", "fitness", "fitness room", "fitness center", "pool", "natatorium",
    "swimming pool", "locker room", "locker", "boys locker", "girls locker", "music room", "music", "band", "band room", "choir", "wr",
)
ROOM_ABBREVIATIONS = (
    "wrr", "mrr", "unr", "idf", "mdf", "spa", "wc", "rr", "dn", "up", "ahu", "vav", "sto", "utl", "jan", "phr", "med", "adm", "art", "gym", "lab", "lib",
)

# Short words on signs and plans, and what they stand for.
SIGN_WORDS = {
    "elev": "elevator", "stair": "stairwell", "str": "stairwell", "mech": "mechanical", "equip": "equipment", "stor": "storage", "util": "utility", "maint": "maintenance", "elec": "electrical",
    "telecom": "telecommunications", "comm": "communications", "corr": "corridor", "jan": "janitor", "vest": "vestibule", "conf": "conference", "collab": "collaboration", "recept": "reception",
    "laund": "laundry", "pkg": "parking", "gym": "gymnasium", "mgmt": "management", "ofc": "office", "wrr": "restroom", "mrr": "restroom", "rr": "restroom", "toilet": "restroom", "bath": "bathroom",
    "break": "breakroom", "copy": "copyroom", "server": "serverroom", "class": "classroom", "lib": "library", "cafe": "cafeteria", "cafet": "cafeteria", "lab": "laboratory", "admin": "administration",
    "aud": "auditorium", "prek": "prekindergarten", "media": "mediacenter", "nurse": "nurseoffice", "couns": "counselor", "art": "artroom", "music": "musicroom", "sci": "sciencelaboratory",
    "chem": "chemistrylaboratory", "comp": "computerlab", "tech": "technology",
}
SIGN_ROOM_TOKEN = r"\b(?:[A-Za-z]{1,2}\d{2,4}[A-Za-z]?|\d{2,4}[A-Za-z]{1,2})\b"
SIGN_ROOM_NUMBER = r"\b(?:[A-Z]{1,2}-\d{2,4}|[A-Z]?\d{3}[A-Z]?)\b"

# Labels on plans.
ROOM_NUMBER = r"^(?:[A-Za-z]{1,3}[-_]?\d{2,4}[A-Za-z]?|\d{2,4}[A-Za-z]?)$"
NOT_A_LABEL = r"""\d+'|\d+"|\d+\s*[-x]\s*\d|1\s*/\s*\d{1,3}\s*=|^\d+[\s.]*$"""
DOOR_WORDS = ("door", "doors", "entry", "entries", "egress", "exit", "exits")
OCCUPANT_SIGNALS = ("OCCUPANT LOAD", "OCCUPANCY LOAD", "OCC LOAD", "OCCUPANCY GROUP", "TABLE OF OCCUPANCY")
OCCUPANT_ROW = r"(?i)([A-Za-z]{0,3}[-_]?\d{2,4}[A-Za-z]?)\s+.*?(\d{1,4})\s*(?:OCC|OCCUPANT|LOAD)?(?:\s+([A-E][-\s]?\d?))?"

# Intake of a drawing set.
INDEX_PAGES = ("drawing index", "sheet index", "sheet list", "index of drawings", "list of drawings", "drawing list")
PROJECT_NAME = (r"(?i)project\s+name\s*[:\-]\s*([^\n\r]{3,80})", r"(?i)project\s*[:\-]\s*([^\n\r]{3,80})", r"(?i)building\s+name\s*[:\-]\s*([^\n\r]{3,80})")
JURISDICTION = (r"(?i)(?:authority\s+having\s+jurisdiction|ahj)\s*[:\-]\s*([^\n\r]{3,80})", r"(?i)jurisdiction\s*[:\-]\s*([^\n\r]{3,80})")
ISSUE_DATE = (
    r"(?i)issue\s*date\s*[:\-]?\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})", r"(?i)issued\s*[:\-]\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})", r"(?i)date\s+issued\s*[:\-]?\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})",
    r"(?i)issue\s*date\s*[:\-]?\s*([A-Za-z]+\.?\s+\d{1,2},?\s+\d{4})", r"(?i)issued\s*[:\-]\s*([A-Za-z]+\.?\s+\d{1,2},?\s+\d{4})",
)

# Outline sections of other disciplines.
OTHER_DISCIPLINES = (
    "civil", "electrical", "mechanical", "structural", "plumbing", "fire protection", "technology", "telecom", "telecommunications", "low voltage", "data/communications", "data / communications",
    "it drawings", "it plans", "hvac", "lighting", "power", "sprinkler",
)
HARD_DISCIPLINES = ("framing plan", "reflected ceiling plan", "demolition plan", "roof framing", "structural plan")

# Building types by words of the project's name; the first type with a word counts.
BUILDING_TYPES = (
    ("school", ("school", "elementary", "middle school", "high school", "college", "university", "academy", "institute", "campus", "learning center", "stem center", "educational")),
    ("hotel", ("hotel", "inn", "suites", "resort", "motel", "lodge", "hospitality", "marriott", "hilton", "hyatt", "sheraton", "westin")),
    ("apartment", ("apartment", "apartments", "flats", "residences", "residential", "multifamily", "multi-family", "condominiums", "condos", "lofts", "townhomes", "housing")),
    ("office", ("tower", "plaza", "center", "office", "headquarters", "hq", "corporate", "commercial", "business park", "tech park")),
    ("church", ("church", "chapel", "worship", "cathedral", "mosque", "synagogue", "temple", "parish", "congregation", "ministry", "faith", "baptist", "methodist", "lutheran", "presbyterian", "catholic")),
    ("lab", ("laboratory", "labs", "research", "sciences", "biotech", "pharmaceutical", "clinical", "medical research")),
    ("library", ("library", "libraries", "archives", "reading")),
    ("sports", ("arena", "stadium", "gymnasium", "athletic", "recreation center", "sports", "aquatic", "natatorium", "field house", "fitness center")),
)

# Steps of the processing log.
FAILURE_STEPS = ("sheet_manifest", "phase-2-classification", "text_extraction", "sign_schedule_extract")
FILE_STEP = r"^(.+?)_([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
