"""Typed table schemas: explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column names, types and keys of the fact tables.
_DDL = {
    "day_ahead_prices": "timestamp TIMESTAMP, country STRING, price DOUBLE, unit STRING",
    "load_data": "timestamp TIMESTAMP, country STRING, actual_load DOUBLE, forecast_load DOUBLE, unit STRING",
    "generation_data": "timestamp TIMESTAMP, country STRING, generation_type STRING, value DOUBLE, unit STRING",
    "wind_solar_forecast": "timestamp TIMESTAMP, country STRING, forecast_type STRING, value DOUBLE, unit STRING",
    "crossborder_flows": "timestamp TIMESTAMP, country_from STRING, country_to STRING, flow DOUBLE, unit STRING",
    "download_log": (
        "country STRING, data_type STRING, start_date TIMESTAMP, end_date TIMESTAMP, "
        "download_timestamp TIMESTAMP, status STRING"
    ),
    "fuel_prices": "Month STRING, EUA_EUR DOUBLE, TTF_EUR DOUBLE, ARA_EUR DOUBLE",
    "commodity": "Date STRING, Price DOUBLE",
}
KEYS = {
    "day_ahead_prices": ["timestamp", "country"],
    "load_data": ["timestamp", "country"],
    "generation_data": ["timestamp", "country", "generation_type"],
    "wind_solar_forecast": ["timestamp", "country", "forecast_type"],
    "crossborder_flows": ["timestamp", "country_from", "country_to"],
    "download_log": ["country", "data_type", "start_date", "end_date"],
    "fuel_prices": ["Month"],
    "commodity": ["Date"],
}
UNITS = {
    "day_ahead_prices": "EUR/MWh",
    "load_data": "MW",
    "generation_data": "MW",
    "wind_solar_forecast": "MW",
    "crossborder_flows": "MW",
}


def schema(table: str) -> StructType:
    try:
        return StructType.fromDDL(_DDL[table])
    except KeyError:
        raise ValueError(f"unknown table {table!r}; known: {sorted(_DDL)}") from None


def tables() -> list[str]:
    return list(_DDL)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Order and cast columns to the table's schema, apply the default unit and turn NaN
    into null. A missing column other than ``unit`` is an error."""
    columns = []
    for field in schema(table).fields:
        name, kind = field.name, field.dataType.simpleString()
        if name in df.columns:
            column = F.col(name).cast(field.dataType)
            if kind == "double":
                column = F.when(~F.isnan(column), column)
        elif name == "unit":
            column = F.lit(None).cast("string")
        else:
            raise ValueError(f"{table}: column {name!r} is missing")
        if name == "unit":
            column = F.coalesce(column, F.lit(UNITS[table]))
        columns.append(column.alias(name))
    return df.select(*columns)
