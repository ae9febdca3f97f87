"""Column names and table layouts shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the raw log, in file order.
LOG_COLUMNS = [
    "Date",
    "Time",
    "Global_active_power",
    "Global_reactive_power",
    "Voltage",
    "Global_intensity",
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
]
READING_COLUMNS = LOG_COLUMNS[2:]
TARGET = "Global_active_power"
SUBMETER_COLUMNS = ["Sub_metering_1", "Sub_metering_2", "Sub_metering_3"]

LOG_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in LOG_COLUMNS])

# Columns that would leak the target into its own forecast.
LEAKY_COLUMNS = [
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
    "Global_intensity",
    "Voltage",
    "Global_reactive_power",
]

# Physical limits, both ends included.
PHYSICAL_LIMITS = {
    "Global_active_power": (0.0, 15.0),
    "Voltage": (220.0, 260.0),
    "Global_intensity": (0.0, 60.0),
}

# Log name -> stored name.
STORAGE_NAMES = {
    "Global_active_power": "global_active_power",
    "Global_reactive_power": "global_reactive_power",
    "Voltage": "voltage",
    "Global_intensity": "global_intensity",
}
MEASUREMENT_COLUMNS = [
    "timestamp",
    "household_id",
    "global_active_power",
    "global_reactive_power",
    "voltage",
    "global_intensity",
]

# Sub-meter column -> stored meter type.
METER_TYPES = {
    "Sub_metering_1": "kitchen",
    "Sub_metering_2": "laundry",
    "Sub_metering_3": "climate",
}


# Layouts of the stored tables.
STORED_TABLES = {
    "households": (
        "id BIGINT, name STRING NOT NULL, location STRING, surface_area DECIMAL(6,2), "
        "occupants INT, created_at TIMESTAMP"
    ),
    "energy_measurements": (
        "id BIGINT, timestamp TIMESTAMP NOT NULL, household_id BIGINT NOT NULL, "
        "global_active_power DECIMAL(8,3), global_reactive_power DECIMAL(8,3), "
        "voltage DECIMAL(6,2), global_intensity DECIMAL(6,3), created_at TIMESTAMP"
    ),
    "sub_meters": (
        "id BIGINT, measurement_id BIGINT NOT NULL, meter_type STRING, energy_consumed DECIMAL(8,3)"
    ),
    "hourly_consumption": (
        "id BIGINT, date DATE, hour INT, household_id BIGINT, avg_power DECIMAL(8,3), max_power DECIMAL(8,3), "
        "min_power DECIMAL(8,3), total_energy DECIMAL(10,3), record_count INT"
    ),
    "daily_consumption": (
        "id BIGINT, date DATE, household_id BIGINT, total_energy DECIMAL(10,3), avg_power DECIMAL(8,3), "
        "max_power DECIMAL(8,3), min_power DECIMAL(8,3), peak_hour INT"
    ),
    "predictions": (
        "timestamp TIMESTAMP, household_id BIGINT, predicted_power DECIMAL(8,3), "
        "actual_power DECIMAL(8,3), model_name STRING, confidence DECIMAL(5,4), "
        "error_abs DECIMAL(8,3), error_pct DECIMAL(6,2), created_at TIMESTAMP"
    ),
}


def stored_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(STORED_TABLES[table])
