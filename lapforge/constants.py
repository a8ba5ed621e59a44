"""These must stay as they are for results to be comparable."""

# Text that stands for a missing tyre compound.
TEXT_NULLS = ["NAN", "NONE", "UNKNOWN", ""]

# Overtaking difficulty scale; unknown words count as medium.
DIFFICULTY = {
    "very_low": 0.2,
    "low": 0.4,
    "medium": 0.6,
    "high": 0.8,
    "very_high": 1.0,
    "nearly_impossible": 1.0,
}
DIFFICULTY_DEFAULT = 0.6

# Circuit-type ratings.
COMPLEXITY = {"technical": 0.9, "street_circuit": 0.8, "mixed": 0.6, "high_speed": 0.4}
SKILL = {"street_circuit": 0.9, "technical": 0.8, "mixed": 0.6, "high_speed": 0.5}
HIGH_DEMAND = ["singapore_gp", "monaco_gp", "hungarian_gp", "brazilian_gp"]
MEDIUM_DEMAND = ["spanish_gp", "austrian_gp", "abu_dhabi_gp"]
SETUP_FACTORS = ["aerodynamics", "suspension", "setup_optimization"]

# Driver groups used by the scoring rules.
RAIN_SPECIALISTS = ["HAM", "VER", "RUS", "NOR", "ALO", "PIA"]
HEAT_TOLERANT = ["VER", "LEC", "SAI", "ALO", "PER", "HAM"]
OVERTAKERS = ["VER", "HAM", "LEC", "NOR", "ALO", "PIA"]
TYPE_SPECIALISTS = {
    "street_circuit": ["HAM", "LEC", "VER", "RUS", "PIA"],
    "high_speed": ["VER", "LEC", "NOR", "SAI", "PIA"],
    "technical": ["HAM", "ALO", "VER", "LEC", "RUS"],
}
MIXED_SPECIALISTS = ["VER", "HAM", "PIA", "NOR", "LEC"]
HOME_DRIVERS = {
    "australian_gp": ["PIA"],
    "dutch_gp": ["VER"],
    "british_gp": ["HAM", "RUS"],
    "spanish_gp": ["ALO", "SAI"],
    "monaco_gp": ["LEC"],
    "italian_gp": ["LEC"],
    "canadian_gp": ["STR"],
    "japanese_gp": ["TSU"],
}

# Team strength in the scoring model; others get the default.
TEAM_STRENGTH = {
    "McLaren": 0.25,
    "Ferrari": 0.20,
    "Mercedes": 0.18,
    "Red Bull Racing": 0.12,
    "Red Bull": 0.12,
    "Williams": 0.08,
    "Racing Bulls": 0.06,
    "Haas": 0.05,
    "Aston Martin": 0.04,
    "Alpine": 0.03,
    "Kick Sauber": 0.02,
}
TEAM_STRENGTH_DEFAULT = 0.01

# Legacy circuit names.
CIRCUIT_ALIASES = {"hungarian": "Hungarian Grand Prix", "monza": "Italian Grand Prix"}

# Exact team spellings.
TEAM_NAMES = {
    "red bull racing": "Red Bull Racing",
    "red bull": "Red Bull Racing",
    "rbr": "Red Bull Racing",
    "ferrari": "Ferrari",
    "scuderia ferrari": "Ferrari",
    "mercedes": "Mercedes",
    "mercedes-amg": "Mercedes",
    "mclaren": "McLaren",
    "aston martin": "Aston Martin",
    "alpine": "Alpine",
    "williams": "Williams",
    "alphatauri": "AlphaTauri",
    "alfa romeo": "Alfa Romeo",
    "haas": "Haas F1 Team",
    "haas f1": "Haas F1 Team",
}

# Team words looked for inside free text, first hit wins.
TEAM_WORDS = {
    "red bull": "Red Bull Racing",
    "ferrari": "Ferrari",
    "mercedes": "Mercedes",
    "mclaren": "McLaren",
    "aston martin": "Aston Martin",
    "alpine": "Alpine",
    "williams": "Williams",
    "haas": "Haas F1 Team",
    "sauber": "Sauber",
    "alphatauri": "AlphaTauri",
    "vcarb": "VCARB",
}
TEAM_HINTS = ["red bull", "ferrari", "mercedes", "mclaren", "aston", "alpine"]

# Driver names with a code that the general rule would not give, or that are well known.
DRIVER_CODES = {
    "max verstappen": "VER",
    "lewis hamilton": "HAM",
    "charles leclerc": "LEC",
    "george russell": "RUS",
    "carlos sainz": "SAI",
    "lando norris": "NOR",
    "oscar piastri": "PIA",
    "fernando alonso": "ALO",
    "lance stroll": "STR",
    "sergio perez": "PER",
    "pierre gasly": "GAS",
    "esteban ocon": "OCO",
    "alexander albon": "ALB",
    "kevin magnussen": "MAG",
    "nico hulkenberg": "HUL",
    "valtteri bottas": "BOT",
    "zhou guanyu": "ZHO",
    "yuki tsunoda": "TSU",
    "daniel ricciardo": "RIC",
    "isack hadjar": "HAD",
    "hadjar": "HAD",
    "jack doohan": "DOO",
    "doohan": "DOO",
    "gabriel bortoleto": "BOR",
    "bortoleto": "BOR",
    "kimi antonelli": "ANT",
    "antonelli": "ANT",
    "ollie bearman": "BEA",
    "bearman": "BEA",
    "franco colapinto": "COL",
    "colapinto": "COL",
    "mick schumacher": "MSC",
    "schumacher": "MSC",
    "nyck de vries": "DEV",
    "de vries": "DEV",
}

# Words that identify a grand prix, in the order they are tried.
GP_WORDS = {
    "hungarian": "Hungarian Grand Prix",
    "dutch": "Dutch Grand Prix",
    "monaco": "Monaco Grand Prix",
    "silverstone": "British Grand Prix",
    "monza": "Italian Grand Prix",
    "spa": "Belgian Grand Prix",
    "zandvoort": "Dutch Grand Prix",
    "hungaroring": "Hungarian Grand Prix",
    "abu dhabi": "Abu Dhabi Grand Prix",
    "yas marina": "Abu Dhabi Grand Prix",
    "miami": "Miami Grand Prix",
    "austin": "United States Grand Prix",
    "cota": "United States Grand Prix",
    "suzuka": "Japanese Grand Prix",
    "melbourne": "Australian Grand Prix",
    "bahrain": "Bahrain Grand Prix",
    "jeddah": "Saudi Arabian Grand Prix",
    "imola": "Emilia Romagna Grand Prix",
    "barcelona": "Spanish Grand Prix",
    "montreal": "Canadian Grand Prix",
    "paul ricard": "French Grand Prix",
    "red bull ring": "Austrian Grand Prix",
    "singapore": "Singapore Grand Prix",
    "brazil": "Brazilian Grand Prix",
    "interlagos": "Brazilian Grand Prix",
    "vegas": "Las Vegas Grand Prix",
    "qatar": "Qatar Grand Prix",
}

# Strategy notes by condition.
NOTES_WET = [
    "Wet weather tire strategy crucial",
    "Grid position less important",
    "Driver skill and experience key factors",
]
NOTES_DAMP = ["Weather window strategy important", "Flexible pit stop plans needed"]
NOTES_HOT = [
    "Higher tire degradation expected",
    "Cooling and reliability crucial",
    "Physical driver endurance important",
]
NOTES_COLD = [
    "Tire warm-up challenges expected",
    "Setup adjustments needed for cold conditions",
]
ADVANTAGE_WET = [
    "Rain specialists have advantage",
    "Experience in changeable conditions valuable",
]
ADVANTAGE_HOT = [
    "Heat-tolerant drivers favored",
    "Teams with superior cooling systems advantaged",
]

# Words a read-only statement may not contain.
FORBIDDEN_SQL = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE",
    "CREATE", "MERGE", "GRANT", "REVOKE", "EXEC", "EXECUTE",
]

# Text patterns. Case is ignored unless noted; an en dash and a hyphen count alike.
DRIVER_STANDING_PATTERNS = [
    r"(\d+)\.?\s*([A-Za-z\s]+?)\s*\(([A-Z]{3})\)\s*[-–]\s*([A-Za-z\s]+?)\s*[-–]\s*(\d+)\s*points?",
    r"P(\d+):?\s*([A-Za-z\s]+?)\s*\(([A-Za-z\s]+?)\)\s*[-–]\s*(\d+)\s*(?:pts|points?)",
    r"(\d+)\.?\s*([A-Za-z\s]+?)\s*[-–]\s*([A-Za-z\s]+?)\s*[-–]\s*(\d+)(?:\s*points?)?",
    r"(?:^|\n)\s*(\d+)\.?\s*([A-Za-z\s]+?)(?:\s*\(([A-Z]{3})\))?\s*[-–:]?\s*([A-Za-z\s]*?)\s*[-–:]?\s*(\d+)\s*(?:pts|points?)",
]
TEAM_STANDING_PATTERNS = [
    r"(\d+)\.?\s*([A-Za-z\s]+?)\s*[-–]\s*(\d+)\s*points?",
    r"P(\d+):?\s*([A-Za-z\s]+?)\s*\((\d+)\s*points?\)",
    r"([A-Za-z\s]+?):\s*(\d+)\s*pts?",
]
POLE_PATTERNS = [
    r"pole position:?\s*([A-Za-z\s]+?)\s*\((\d+:\d+\.\d+)\)",
    r"([A-Za-z\s]+?)\s+took\s+pole.*?time\s+of\s+(\d+:\d+\.\d+)",
    r"([A-Za-z\s]+?)\s+secured\s+pole.*?(\d+:\d+\.\d+)",
    r"Pole Position:?\s*([A-Za-z\s]+?)(?:\s*\([^)]*\))?\s*[-–]\s*(\d+:\d+\.\d+)",
    r"Q3.*?1\.?\s*([A-Za-z\s]+?)\s*[-–]\s*(\d+:\d+\.\d+)",
]
POLE_SHORT_PATTERNS = [
    r"(\w+\s+\w+).*?pole position.*?(\d+:\d+\.\d+)",
    r"pole position.*?(\w+\s+\w+).*?(\d+:\d+\.\d+)",
    r"1\.\s*(\w+\s+\w+).*?(\d+:\d+\.\d+)",
]
# Headings are looked for in single lines; what follows on the line belongs to the list.
QUALIFYING_HEADINGS = [
    r"Q3.*?Top 10:",
    r"Qualifying.*?Results:",
    r"Q3.*?(?:results|times):",
    r"Grid.*?positions:",
    r"Starting.*?grid:",
]
LAP_TIME = r"(\d+:\d+\.\d+)"
# A place at the start of a line, and the first line of a list that has no heading.
PLACE_START = r"(?i)^\s*P\d+\b"
BARE_LIST_START = rf"(?i)^\s*1\.\s*[A-Za-z\s]+.*?(?:Ferrari|McLaren|Mercedes).*?{LAP_TIME}"
GRID_ROW_PATTERNS = [
    rf"(\d+)\.\s*([A-Za-z\s]+?)\s*\(([A-Za-z\s]+?)\)\s*[-–]\s*{LAP_TIME}",
    rf"(\d+)\.\s*([A-Za-z\s]+?)\s*[-–]\s*{LAP_TIME}",
    rf"P(\d+):?\s*([A-Za-z\s]+?)\s*[-–]\s*{LAP_TIME}",
    rf"(\d+)\.\s*([A-Za-z\s]+?)\s+{LAP_TIME}",
]
GRID_UNTIMED_PATTERNS = [
    r"(\d+)\.\s*([A-Za-z\s]+?)(?:\s*\([^)]*\))?\s*$",
]
PRACTICE_ROW_PATTERNS = [
    rf"(\d+)\.?\s*([A-Za-z\s]+?)(?:\s*\([^)]*\))?\s*[-–]\s*{LAP_TIME}",
    rf"P(\d+):?\s*([A-Za-z\s]+?)(?:\s*\([^)]*\))?\s*[-–]\s*{LAP_TIME}",
]
PRACTICE_UNTIMED_PATTERNS = [
    r"(\d+)\.?\s*([A-Za-z\s]+?)(?:\s*\([^)]*\))?\s*$",
]
WEATHER_PATTERNS = [
    r"weather.*?(?:conditions?|was|were):?\s*([^.\n]+)",
    r"conditions?.*?(?:were|was):?\s*([^.\n]+)",
    r"track.*?conditions?:?\s*([^.\n]+)",
    r"session.*?(?:held|run).*?(dry|wet|rain|sunny|cloudy|overcast)",
    r"temperature.*?(\d+).*?degrees?",
    r"(dry|wet|rain|sunny|cloudy|overcast|humid).*?conditions?",
]
INCIDENT_PATTERNS = [
    r"penalty.*?(?:for|to)\s+([A-Za-z\s]+)",
    r"([A-Za-z\s]+?).*?(?:received|given|penalized).*?penalty",
    r"incident.*?(?:involving|with)\s+([A-Za-z\s]+)",
    r"grid penalty.*?(?:for|to)\s+([A-Za-z\s]+)",
    r"warning.*?(?:for|to)\s+([A-Za-z\s]+)",
    r"investigation.*?(?:involving|with)\s+([A-Za-z\s]+)",
]
WINNER_PATTERNS = [
    r"race winner:?\s*([A-Za-z\s]+)",
    r"victory.*?(?:for|to)\s+([A-Za-z\s]+)",
    r"([A-Za-z\s]+?)\s+won.*?race",
    r"first place:?\s*([A-Za-z\s]+)",
    r"winner.*?([A-Za-z\s]+)",
]
IN_FORM_PATTERNS = [
    r"(\w{3})\s+(?:is|has been)\s+(?:performing|driving)\s+(?:well|excellently)",
    r"(\w{3})\s+(?:showing|demonstrating)\s+(?:strong|excellent)\s+form",
    r"(?:strong|good)\s+form.*?(\w{3})",
]
STRUGGLING_PATTERNS = [
    r"(\w{3})\s+(?:struggling|having\s+difficulty)",
    r"(\w{3})\s+(?:underperforming|disappointing)",
    r"poor.*?form.*?(\w{3})",
]
SPECIALIST_PATTERNS = [
    r"(\w{3})\s+(?:excels|performs well|strong).*?(?:at|on)\s+(?:this|the)\s+(?:circuit|track)",
    r"(?:good|strong).*?(?:at|on).*?(?:this|the).*?(?:circuit|track).*?(\w{3})",
    r"(\w{3}).*?(?:specialist|expert).*?(?:at|on)",
]
DRIVER_CHANGE_PATTERNS = [
    r"(\w+)\s+(?:replaces|replacing|joins|leaves)",
    r"driver\s+change.*?(\w+)",
    r"(\w+)\s+out.*?(?:injury|illness)",
]
TECH_UPDATE_PATTERNS = [
    r"(?:upgrade|update|development).*?(\w+)",
    r"(?:aerodynamic|engine|suspension).*?(?:improvement|change)",
    r"new.*?(?:floor|wing|sidepod)",
]
RACES_COMPLETED_PATTERNS = [
    r"(\d+)\s*races?\s*completed",
    r"after\s*(\d+)\s*rounds?",
    r"round\s*(\d+)",
]

# Words a text must contain for the patterns that start with free text. Checked first,
# because those patterns are slow on texts where they cannot match.
PATTERN_NEEDS = {
    INCIDENT_PATTERNS[1]: r"(?:received|given|penalized).*?penalty",
    WINNER_PATTERNS[2]: r"won.*?race",
    POLE_PATTERNS[1]: r"took\s+pole.*?time\s+of",
    POLE_PATTERNS[2]: r"secured\s+pole",
    POLE_SHORT_PATTERNS[0]: r"pole position",
    SPECIALIST_PATTERNS[2]: r"(?:specialist|expert)",
}


def practice_headings(number: int) -> list[str]:
    """Headings of one practice session."""
    n = number
    return [
        rf"(?:FP{n}|Free Practice {n}|Practice {n}).*?(?:Results|times?):",
        rf"(?:Session.*?FP{n}|{n}\..*?FP{n}):",
        rf"{n}\.\s*FP{n}.*?Results",
    ]


def fastest_patterns(number: int) -> list[str]:
    """Single lines on the fastest driver of one practice session."""
    n = number
    return [
        rf"FP{n}\b[^A-Za-z\n]*([A-Za-z ]+?)\s+fastest.*?{LAP_TIME}",
        rf"Practice\s+{n}\b[^A-Za-z\n]*([A-Za-z ]+?)\s+(?:tops|fastest).*?{LAP_TIME}",
        rf"Session\s+FP{n}:?\s*([A-Za-z\s]+?)\s+{LAP_TIME}",
    ]
