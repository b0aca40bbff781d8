"""Schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

RIDES = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("zone", T.StringType()),
    T.StructField("demand", T.LongType()),
    T.StructField("weather", T.StringType()),
    T.StructField("temperature_c", T.DoubleType()),
    T.StructField("precipitation_mm", T.DoubleType()),
    T.StructField("wind_speed_kmh", T.DoubleType()),
    T.StructField("is_event", T.BooleanType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

# Payload of one message on the GPS topic; every field may be missing.
GPS_MESSAGE = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("zone", T.StringType()),
    T.StructField("demand", T.IntegerType()),
    T.StructField("weather", T.StringType()),
    T.StructField("temperature_c", T.DoubleType()),
    T.StructField("precipitation_mm", T.DoubleType()),
    T.StructField("wind_speed_kmh", T.DoubleType()),
    T.StructField("is_event", T.BooleanType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

ONLINE = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("feature_group", T.StringType()),
    T.StructField("features", T.MapType(T.StringType(), T.StringType())),
    T.StructField("updated_at", T.TimestampType()),
])
