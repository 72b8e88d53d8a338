"""The column catalog of trip logs and the layouts of the derived tables."""

from __future__ import annotations

from pyspark.sql import types as T

TIME_COLUMNS = ["gpstime", "devicetime"]

# Sensor columns every reader knows (the names are the log format's own).
CORE_SENSORS = [
    "longitude", "latitude", "gpsspeedkmh", "horizontaldilutionofprecision", "altitude", "bearing", "gx", "gy",
    "gz", "gcalibrated", "accelerationsensortotalg", "accelerationsensorxaxisg", "accelerationsensoryaxisg",
    "accelerationsensorzaxisg", "actualenginetorque", "airfuelratiomeasured1", "androiddevicebatterylevel",
    "averagetripspeedwhilstmovingonlykmh", "averagetripspeedwhilststoppedormovingkmh",
    "barometricpressurefromvehiclepsi", "coingkmaveragegkm", "coingkminstantaneousgkm",
    "distancetoemptyestimatedkm", "distancetravelledwithmilcellitkm", "enginecoolanttemperaturec",
    "enginekwatthewheelskw", "engineload", "enginerpmrpm", "fuelcosttripcost", "fuelflowratehourlhr",
    "fuelflowrateminuteccmin", "fuelrailpressurepsi", "fuelremainingcalculatedfromvehicleprofile",
    "fuelusedtripl", "gpsaccuracym", "gpsaltitudem", "gpsbearing", "gpslatitude", "gpslongitude", "gpssatellites",
    "gpsspeedmeterssecond", "gpsvsobdspeeddifferencekmh", "horsepoweratthewheelshp", "intakeairtemperaturec",
    "intakemanifoldpressurepsi", "kilometersperlitreinstantkpl", "kilometersperlitrelongtermaveragekpl",
    "litresper100kilometerinstantl100km", "litresper100kilometerlongtermaveragel100km", "massairflowrategs",
    "milespergalloninstantmpg", "milespergallonlongtermaveragempg", "o2sensor1widerangecurrentma",
    "o2bank1sensor1widerangeequivalenceratio", "o2bank1sensor1widerangevoltagev", "speedgpskmh", "speedobdkmh",
    "torquenm", "tripaveragekplkpl", "tripaveragelitres100kml100km", "tripaveragempgmpg", "tripdistancekm",
    "tripdistancestoredinvehicleprofilekm", "triptimesincejourneystarts", "triptimewhilstmovings",
    "triptimewhilststationarys", "turboboostvacuumgaugepsi", "voltageobdadapterv",
    "volumetricefficiencycalculated", "ambientairtempc", "costpermilekminstantkm", "costpermilekmtripkm",
    "positivekineticenergypkekmhr", "throttlepositionmanifold", "voltagecontrolmodulev",
    "o2sensor1widerangeequivalenceratio", "o2sensor1widerangevoltagev",
]

# Further sensor columns of the stored log table (other units, older app versions).
EXTRA_SENSORS = [
    "airfuelratiocommanded1", "airfuelrationmeasure", "altitudem", "ambientairtempf",
    "barometricpressurefromvehiclekpa", "barometricpressurefromvpsi", "distancetravelledsincecodesclearedkm",
    "dpfpressurebar", "dpfpressurepsi", "dpftemperaturec", "driversdemandenginetorque",
    "enginecoolanttemperaturef", "fuelpressurekpa", "fuelpressurepsi", "fuelrailpressurekpa", "gravityxg",
    "gravityyg", "gravityzg", "intakeairtemperaturef", "intakemanifoldpressurekpa", "percentageofcitydriving",
    "percentageofhighwaydriving", "percentageofidledriving", "torquefnm", "torqueftlb",
    "turboboostvacuumgaugebar",
]

SENSORS = CORE_SENSORS + EXTRA_SENSORS
LOG_COLUMNS = TIME_COLUMNS + SENSORS

# Sensors of the per-trip min / max / average report.
SUMMARY_SENSORS = [
    "accelerationsensortotalg", "accelerationsensorxaxisg", "accelerationsensoryaxisg",
    "accelerationsensorzaxisg", "actualenginetorque", "altitudem", "androiddevicebatterylevel",
    "averagetripspeedwhilstmovingonlykmh", "averagetripspeedwhilststoppedormovingkmh", "bearing",
    "coingkmaveragegkm", "coingkminstantaneousgkm", "costpermilekminstantkm", "costpermilekmtripkm",
    "distancetoemptyestimatedkm", "distancetravelledwithmilcellitkm", "enginecoolanttemperaturef",
    "enginekwatthewheelskw", "engineload", "enginerpmrpm", "fuelcosttripcost", "fuelflowratehourlhr",
    "fuelflowrateminuteccmin", "fuelrailpressurekpa", "fuelremainingcalculatedfromvehicleprofile",
    "fuelusedtripl", "gpsaccuracym", "gpsaltitudem", "gpsbearing", "gpslatitude", "gpslongitude", "gpssatellites",
    "gpsspeedkmh", "gpsvsobdspeeddifferencekmh", "gravityxg", "gravityyg", "gravityzg",
    "horizontaldilutionofprecision", "horsepoweratthewheelshp", "intakeairtemperaturef",
    "intakemanifoldpressurekpa", "kilometersperlitreinstantkpl", "kilometersperlitrelongtermaveragekpl",
    "latitude", "litresper100kilometerinstantl100km", "litresper100kilometerlongtermaveragel100km", "longitude",
    "massairflowrategs", "milespergalloninstantmpg", "milespergallonlongtermaveragempg", "speedgpskmh",
    "speedobdkmh", "torqueftlb", "tripaveragekplkpl", "tripaveragelitres100kml100km", "tripaveragempgmpg",
    "tripdistancekm", "tripdistancestoredinvehicleprofilekm", "triptimesincejourneystarts",
    "triptimewhilstmovings", "triptimewhilststationarys", "turboboostvacuumgaugebar", "voltageobdadapterv",
    "volumetricefficiencycalculated",
]

# The wide one-row-per-trip report leaves one of them out.
WIDE_SENSORS = [c for c in SUMMARY_SENSORS if c != "kilometersperlitreinstantkpl"]

# Columns that profiles never look at (keys, times, flags).
PROFILE_EXCLUDED = [
    "id", "fileid", "devicetime", "gpstime", "time", "csvfile", "csvhash",
    "read_flag", "error_flag", "send_flag", "data_flag", "distance",
]

# Substrings that put a column into a statistics group. Groups overlap.
STAT_GROUPS = {
    "timestats": ["gpstime", "devicetime"],
    "speedstats": ["speed"],
    "gpsstats": ["gps"],
    "coststats": ["cost"],
    "tempstats": ["temp"],
}

SPEED_COLUMNS = ["gpsspeedkmh", "speedobdkmh", "speedgpskmh"]

_TYPES = {
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()),
}


def _schema(fields: str) -> T.StructType:
    pairs = (field.split() for field in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LOGS_SCHEMA = T.StructType(
    [
        T.StructField("fileid", T.LongType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
    + [T.StructField(c, T.TimestampType()) for c in TIME_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in SENSORS]
)

FILES_SCHEMA = _schema(
    "fileid long, startid long, endid long, csvfile string, csvhash string, "
    "import_date timestamp, trip_start timestamp, trip_end timestamp, trip_duration double, "
    "readtime double, sendtime double, startlon double, startlat double, endlon double, "
    "endlat double, sent_rows long"
)

PLACES_SCHEMA = _schema(
    "place_id long, lat double, lon double, count long, label string"
)

SPEEDS_SCHEMA = _schema(
    "fileid long, gpsspeedkmh double, speedobdkmh double, speedgpskmh double, gpstime timestamp"
)

FILESTATS_SCHEMA = _schema(
    "fileid long, column string, nulls long, null_ratio double"
)

COLUMNSTATS_SCHEMA = _schema(
    "column_name string, rows long, nulls long, null_ratio double, mostly_null boolean"
)

TRIPS_SCHEMA = _schema(
    "id long, fileid long, csvfile string, csvhash string, distance long, fuelcost long, "
    "fuelused long, distancewhilstconnectedtoobd long, tripdate timestamp, profile string, "
    "time long"
)

# files seen, with what they held when they were hashed
MANIFEST_SCHEMA = _schema("path string, size long, modified timestamp, csvhash string, header string")

# data file (below the store) and rows of each trip in it
LOGINDEX_SCHEMA = _schema("fileid long, path string, rows long")

# lines with a cell that is neither missing nor a number
QUARANTINE_SCHEMA = _schema("fileid long, block_start long, seq long, line string, bad_cells long")

LOADREPORT_SCHEMA = _schema(
    "version long, path string, rows long, dropped_rows long, header_rows long, reason string, reasons long, sent_rows long, "
    "bad_rows long, bad_cells long, unknown_columns strings, status string"
)

TABLES = {
    "manifest": MANIFEST_SCHEMA,
    "logindex": LOGINDEX_SCHEMA,
    "quarantine": QUARANTINE_SCHEMA,
    "loadreport": LOADREPORT_SCHEMA,
    "logs": LOGS_SCHEMA,
    "files": FILES_SCHEMA,
    "startpos": PLACES_SCHEMA,
    "endpos": PLACES_SCHEMA,
    "speeds": SPEEDS_SCHEMA,
    "filestats": FILESTATS_SCHEMA,
    "columnstats": COLUMNSTATS_SCHEMA,
    "trips": TRIPS_SCHEMA,
}
