"""Names and numbers that must equal those of existing data and mappings."""

# Column headers of the mapping file.
MAP_SOURCE_TABLE = "Tabela zrodlowa"
MAP_TARGET_TABLE = "Tabela docelowa"
MAP_SOURCE_COLUMN = "Kolumna w tab zrodlowej"
MAP_TARGET_COLUMN = "Kolumna w tab docelowej"
MAP_STEREOTYPE = "STEREOTYPE"
MAP_TYPE = "TYPE"
MAP_PRECISION = "PRECISION"
MAP_SCALE = "SCALE"
MAP_PRIMARY_KEY = "PRIMARY_KEY"
MAP_CONDITION = "WARUNKI"
MAP_ORIGIN = "ZRODLO"

# Technical columns of a history table.
EXTRACT_TIME = "_czas_z_ekstraktu"
LOAD_TIME = "_czas_aktualizacji"
VALID_FROM = "_aktualne_od"
VALID_TO = "_aktualne_do"

# Calendar lookup columns.
PERIOD_ID = "okres_w_dobie_id"
LOCAL_DAY = "doba_pl"
UTC_TIME = "czas_do_utc"
TIME_SOURCES = ("udt_do", "utctime", "utc_do")
GRAIN_COLUMNS = ("ziarno_cz", "ziarno")

# Grain code -> market period code.
GRAIN_TO_PERIOD = {"PT15M": "OREB", "PT5M": "OPCR", "PT60M": "ONMB"}

# Routing of an ingest batch.
LIGHT_BYTES = 500_000_000
LIGHT_FILES = 200
BATCH_FILES = 50
BATCH_TIMEOUT_SECONDS = 30
DEFAULT_TABLE = "db.my_table"
