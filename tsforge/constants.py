"""Fixed values of the market data model (names, codes, thresholds, lengths)."""

# Market entity name -> short code. Legacy zone names share a code.
ENTITY_CODES = {
    "France": "FR",
    "Germany": "DE",
    "Germany_Luxembourg": "DE",
    "Germany_Austria_Luxembourg": "DE",
    "Italy": "IT",
    "Italy_North": "IT",
    "Spain": "ES",
    "Great Britain": "GB",
    "Netherlands": "NL",
    "Belgium": "BE",
    "Switzerland": "CH",
    "Austria": "AT",
}

# Legacy zone name -> the one name used after loading.
CANONICAL_ENTITIES = {
    "Germany_Luxembourg": "Germany",
    "Germany_Austria_Luxembourg": "Germany",
    "Italy_North": "Italy",
}

# Dated zone codes as (entity, code, first day, day after the last one).
# A null bound is open.
ZONE_VALIDITY = [
    ("France", "10YFR-RTE------C", None, None),
    ("Spain", "10YES-REE------0", None, None),
    ("Italy", "10Y1001A1001A73I", None, None),
    ("Switzerland", "10YCH-SWISSGRIDZ", None, None),
    ("Belgium", "10YBE----------2", None, None),
    ("Germany", "10Y1001A1001A63L", None, "2018-10-01"),
    ("Germany", "10Y1001A1001A82H", "2018-10-01", None),
]

# The hub of directed flows and its neighbours.
FLOW_HUB = "France"
FLOW_NEIGHBOURS = ["Spain", "Italy", "Switzerland", "Belgium", "Germany", "Great Britain"]

# Kinds of data a load run fetches for every entity.
DATA_TYPES = ["prices", "load", "generation", "wind_solar_forecast", "crossborder_flows"]

# Generation types kept by the loader.
GENERATION_TYPES = [
    "Biomass",
    "Fossil Gas",
    "Fossil Hard coal",
    "Fossil Oil",
    "Hydro Run-of-river and poundage",
    "Hydro Water Reservoir",
    "Nuclear",
    "Solar",
    "Waste",
    "Wind Onshore",
    "Fossil Brown coal/Lignite",
    "Wind Offshore",
    "Other",
    "Geothermal",
    "Marine",
    "Other renewable",
    "Hydro Pumped Storage_Generation",
    "Hydro Pumped Storage_Consumption",
]

# Pumped storage splits by aggregation kind; other types keep one kind.
PUMPED_STORAGE = "Hydro Pumped Storage"
AGG_OUTPUT = "Actual Aggregated"
AGG_CONSUMPTION = "Actual Consumption"

# Forecast column renames, applied in this order.
FORECAST_RENAMES = [
    ("forecast_load", "Load_forecast"),
    ("Solar", "Solar_forecast"),
    ("Wind Onshore", "Wind_Onshore_forecast"),
    ("Wind Offshore", "Wind_Offshore_forecast"),
]

# Fuel prices used when no history is at hand (EUR, coal in USD).
DEFAULT_FUEL = {"TTF_EUR": 30.8, "EUA_EUR": 70.0, "ARA_USD": 99.5, "USD_EUR": 0.86}
FUEL_COLUMNS = ["EUA_EUR", "TTF_EUR", "ARA_EUR"]

CYCLICAL_COLUMNS = ["Day_sin", "Day_cos", "Week_sin", "Week_cos", "Year_sin", "Year_cos"]

MARKET_ZONE = "Europe/Paris"
CHUNK_DAYS = 90

HOUR = 3600
DAY = 24 * HOUR
WEEK = 7 * DAY

PRICE_LIMIT = 1000.0
MONTH_PRICE_LIMIT = 300.0
HISTORY_HOURS = 168
HORIZON_HOURS = 24
STRIDE_HOURS = 24
LAG_HOURS = range(24, 97)
VAL_FRACTION = 0.2
TEST_FRACTION = 0.2
VAL_YEAR = 2024
TEST_YEAR = 2025
FOLDS = 5
ROW_GAP = 97
"""Rows dropped at the start of the validation and test parts of a row split."""
GAP_HOURS = HISTORY_HOURS + HORIZON_HOURS
AR_LAGS = 168
