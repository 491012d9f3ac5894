"""Coverage box, thresholds, keyword lists, rules, feature lists.

Every value here is a default of some operator's parameter.
"""

# --- coverage ---------------------------------------------------------------
LAT_MIN, LAT_MAX = 25.0, 50.0
LON_MIN, LON_MAX = -125.0, -65.0
CENTER_LAT, CENTER_LON = 40.0, -100.0

EAST_COAST_LON = -80.0
WEST_COAST_LON = -120.0
NORTHERN_LAT = 40.0
SOUTHERN_LAT = 30.0

# --- grid variables: canonical name -> accepted names, in order of preference ---
VARIABLE_ALIASES = {
    "no2": ["NO2"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon"],
    "time": ["time"],
}

UNITS = "molecules/cm^2"

# --- air-quality classes: exclusive lower bound, code, text, hex colour -------
AIR_QUALITY_CLASSES = [
    (2e15, "HIGH_POLLUTION", "High Pollution", "#FF4444"),
    (1.5e15, "MODERATE_POLLUTION", "Moderate Pollution", "#FFAA00"),
    (1e15, "LOW_POLLUTION", "Low Pollution", "#44AA44"),
    (None, "CLEAN_AIR", "Clean Air", "#00AA00"),
]

# code, display name, display colour, emoji
AIR_QUALITY_DIMENSION = [
    ("CLEAN_AIR", "Clean Air", "green", "✅"),
    ("LOW_POLLUTION", "Low Pollution", "yellow", "🟢"),
    ("MODERATE_POLLUTION", "Moderate Pollution", "orange", "🟡"),
    ("HIGH_POLLUTION", "High Pollution", "red", "🔴"),
]
UNKNOWN_EMOJI = "🌫️"
UNKNOWN_COLOUR = "primary"

# exclusive lower bound of R2, level
PERFORMANCE_LEVELS = [
    (0.95, "EXCELLENT"),
    (0.90, "VERY GOOD"),
    (0.80, "GOOD"),
    (0.70, "FAIR"),
    (None, "NEEDS IMPROVEMENT"),
]
R2_GATE = 0.8

# --- field model --------------------------------------------------------------
# latitude, longitude, intensity
HOTSPOTS = [
    (40.7128, -74.0060, 2.5e15),
    (34.0522, -118.2437, 2.2e15),
    (41.8781, -87.6298, 2.0e15),
    (29.7604, -95.3698, 1.8e15),
    (33.4484, -112.0740, 1.6e15),
    (39.9526, -75.1652, 1.5e15),
    (32.7767, -96.7970, 1.4e15),
    (25.7617, -80.1918, 1.3e15),
]
HOTSPOT_DECAY_DEGREES = 2.0

# latitude from, to, longitude from, to (inclusive), weight; the first hit wins
URBAN_BOXES = [
    (40.0, 41.0, -75.0, -73.0, 2.0),
    (33.0, 35.0, -119.0, -117.0, 1.8),
    (41.0, 42.0, -88.0, -87.0, 1.6),
]

FIELD_FLOOR = 1e14
DAYS_PER_YEAR = 365

# --- request defaults -----------------------------------------------------------
DEFAULT_TEMPERATURE = 25.0
DEFAULT_WIND_SPEED = 10.0
DEFAULT_HUMIDITY = 60.0
DEFAULT_LOCATION_NAME = "Unknown"

MESSAGE_LOCATIONS_REQUIRED = "locations array is required"
MESSAGE_COORDINATES_REQUIRED = "latitude and longitude are required"
MESSAGE_LATITUDE_RANGE = "latitude must be between 25 and 50"
MESSAGE_LONGITUDE_RANGE = "longitude must be between -125 and -65"

# --- feature lists -----------------------------------------------------------------
PREPROCESSING_FEATURES = [
    "latitude", "longitude", "year", "month", "day", "hour",
    "day_of_year", "day_of_week", "is_weekend", "season",
    "distance_from_center", "is_east_coast", "is_west_coast",
    "is_northern", "is_southern", "temperature", "wind_speed",
    "humidity", "pressure",
]
MODEL_FEATURES = [
    "latitude", "longitude", "year", "month", "day", "day_of_year",
    "day_of_week", "is_weekend", "distance_from_center",
    "is_east_coast", "is_west_coast", "is_northern", "is_southern",
    "temperature", "wind_speed", "humidity", "pressure",
    "lat_lon_interaction", "temp_humidity_interaction",
]
SCORING_FEATURES = [
    "latitude", "longitude", "month", "day_of_year", "is_weekend",
    "temperature", "wind_speed", "humidity",
]

# --- manifest -----------------------------------------------------------------------
# texts that a CSV reader with type inference treats as missing
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

MANIFEST_NAME_KEYWORDS = ["collection", "edsc"]
ENTRY_KEYWORDS = ["tempo", "no2", "nitrogen dioxide"]
SUBJECT_KEYWORD = "TEMPO"

# column role -> keywords looked for in the lower-case column name
COLUMN_ROLE_KEYWORDS = {
    "file_path": ["file", "path", "filename", "granule", "download"],
    "url": ["url", "link", "download_url", "href"],
    "date": ["date", "time", "start", "end", "acquisition"],
    "product": ["product", "collection", "dataset", "shortname"],
    "subject": ["tempo", "no2", "nitrogen", "dioxide"],
}

# output column -> manifest header
MANIFEST_COLUMNS = {
    "data_provider": "Data Provider",
    "short_name": "Short Name",
    "version": "Version",
    "entry_title": "Entry Title",
    "processing_level": "Processing Level",
    "platform": "Platform",
    "start_time": "Start Time",
    "end_time": "End Time",
}

# category, keywords in the upper-case short name, keywords in the upper-case title
CATEGORY_RULES = [
    ("no2_products", ["NO2"], ["NO2"]),
    ("hcho_products", ["HCHO"], ["HCHO", "FORMALDEHYDE"]),
    ("o3_products", ["O3"], ["O3", "OZONE"]),
    ("cloud_products", ["CLD"], ["CLOUD"]),
]
OTHER_CATEGORY = "other_products"

GRANULE_GLOB = "*TEMPO*NO2*.nc"
GRANULE_NAME_TOKENS = ["TEMPO", "NO2"]
GRANULE_SUFFIX = ".nc"
FALLBACK_FILE_NAME = "tempo_file_%d.nc"

# download instructions
INSTRUCTIONS_URL_PATTERN = "https://tempo.si.edu/data/level3/%s/"
INSTRUCTIONS_HEADER = "TEMPO Data Download Instructions:\n" + "=" * 50
INSTRUCTIONS_RULE = "-" * 30
INSTRUCTIONS_GENERAL = """
General Download Instructions:
------------------------------
1. Visit: https://tempo.si.edu/
2. Navigate to the data section
3. Select your desired product (NO2, HCHO, O3, etc.)
4. Choose processing level (L2 or L3)
5. Download NetCDF (.nc) files
6. Place downloaded files in the 'data/' directory

For Level 3 NO2 data specifically:
- Look for files like: TEMPO_NO2_L3_v03.nc
- These are gridded, ready-to-use datasets
- Perfect for analysis and visualization"""

# --- scenarios ------------------------------------------------------------------------
# name, latitude, longitude, area type
CITY_SCENARIOS = [
    ("New York City", 40.7128, -74.0060, "Urban"),
    ("Los Angeles", 34.0522, -118.2437, "Urban"),
    ("Chicago", 41.8781, -87.6298, "Urban"),
    ("Houston", 29.7604, -95.3698, "Urban"),
    ("Miami", 25.7617, -80.1918, "Urban"),
    ("Denver", 39.7392, -104.9903, "Urban"),
    ("Rural Kansas", 39.0, -98.0, "Rural"),
    ("Rural Montana", 47.0, -110.0, "Rural"),
    ("Rural Texas", 31.0, -100.0, "Rural"),
]
# name, month, day of year, temperature
SEASON_SCENARIOS = [
    ("Winter", 1, 15, 20.0),
    ("Spring", 4, 100, 25.0),
    ("Summer", 7, 200, 25.0),
    ("Fall", 10, 280, 25.0),
]
# name, weekend flag
WEEKEND_SCENARIOS = [("Weekday", 0), ("Weekend", 1)]
SCENARIO_LAT, SCENARIO_LON = 40.7, -74.0
SCENARIO_MONTH, SCENARIO_DAY_OF_YEAR = 8, 220
SCENARIO_COVARIATES = ["month", "day_of_year", "is_weekend", "temperature", "wind_speed", "humidity"]

# --- forest profiles: trees, depth, minimum rows per leaf --------------------------------
FOREST_PROFILES = {
    "full": {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 2},
    "suite": {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 1},
    "server": {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 1},
    "quick": {"numTrees": 50, "maxDepth": 15, "minInstancesPerNode": 1},
}
SEED = 42
