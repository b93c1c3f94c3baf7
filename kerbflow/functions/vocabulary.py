"""Word lists, lookup tables and constants.

Every value in this file is a fixed value of the data model; results depend on each one.
"""

# Strings that stand for "missing".
MISSING_WORDS = ["NULL", "NAN", "NONE"]
NO_JUNCTION_WORDS = ["", "NO JUNCTION", "NULL", "NAN", "NONE"]

# Raw columns the cleaned event table leaves out.
UNUSED_COLUMNS = [
    "id", "description", "closed_datetime", "device_id", "created_by_id", "modified_datetime",
    "action_taken_timestamp", "data_sent_to_scita_timestamp", "updated_vehicle_number",
    "validation_timestamp", "vehicle_number", "offence_code", "data_sent_to_scita",
]

# Vehicle severity, 0.1 to 1.0.
VEHICLE_SEVERITY = {
    "TRUCK": 1.0, "HEAVY VEHICLE": 1.0, "BUS": 0.9, "MINI-BUS": 0.8, "MAXI-CAB": 0.8,
    "CAR": 0.6, "JEEP": 0.6, "VAN": 0.6, "AUTO": 0.5, "THREE WHEELER": 0.5, "E-RICKSHAW": 0.5,
    "SCOOTER": 0.3, "MOTORCYCLE": 0.3, "MOPED": 0.3, "CYCLE": 0.1, "BICYCLE": 0.1,
}
DEFAULT_SEVERITY = 0.4

# Trust by validation status.
STATUS_TRUST = {"approved": 1.0, "pending": 0.5, "rejected": 0.1}
DEFAULT_TRUST = 0.3

# Vehicle obstruction weight, 0.5 to 2.0.
VEHICLE_OBSTRUCTION = {
    "SCOOTER": 0.5, "MOTOR CYCLE": 0.5, "MOTORCYCLE": 0.5, "MOPED": 0.5, "BIKE": 0.5,
    "TWO WHEELER": 0.5, "CAR": 1.0, "JEEP": 1.0, "VAN": 1.0, "PASSENGER AUTO": 1.1, "AUTO": 1.1,
    "MAXI-CAB": 1.1, "MAXICAB": 1.1, "LGV": 1.5, "TEMPO": 1.5, "SCHOOL VEHICLE": 1.5, "HGV": 1.8,
    "LORRY/GOODS VEHICLE": 1.8, "LORRY": 1.8, "GOODS VEHICLE": 1.8, "TANKER": 1.8, "TRUCK": 1.8,
    "BUS (BMTC/KSRTC)": 2.0, "PRIVATE BUS": 2.0, "BUS": 2.0,
}
DEFAULT_OBSTRUCTION = 1.0

# Vehicle weights of the documented risk proxy, by group.
PROXY_GROUPS = {
    0.70: ["SCOOTER", "MOTOR CYCLE", "MOTORCYCLE", "MOPED", "BIKE", "TWO WHEELER"],
    1.00: ["CAR", "JEEP", "VAN"],
    1.10: ["PASSENGER AUTO", "AUTO", "MAXI-CAB", "MAXICAB"],
    1.35: ["LGV", "HGV", "LORRY/GOODS VEHICLE", "LORRY", "GOODS VEHICLE", "TANKER", "TRUCK", "TEMPO"],
    1.50: ["BUS (BMTC/KSRTC)", "PRIVATE BUS", "BUS", "SCHOOL VEHICLE", "FACTORY BUS"],
}
PROXY_WEIGHT = {name: weight for weight, names in PROXY_GROUPS.items() for name in names}
DEFAULT_PROXY_WEIGHT = 1.0

# Label groups behind the impact components.
MAIN_ROAD_LABEL = "PARKING IN A MAIN ROAD"
DOUBLE_PARK_LABEL = "DOUBLE PARKING"
JUNCTION_LABELS = ["PARKING NEAR ROAD CROSSING", "PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS"]
ACCESS_LABELS = ["PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC", "PARKING ON FOOTPATH"]

# Documented label severities.
LABEL_SEVERITY = {
    "DOUBLE PARKING": 1.40, "PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS": 1.35,
    "PARKING NEAR ROAD CROSSING": 1.35, "PARKING IN A MAIN ROAD": 1.30,
    "PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC": 1.25, "PARKING ON FOOTPATH": 1.15,
    "WRONG PARKING": 1.00, "NO PARKING": 1.00, "DEFECTIVE NUMBER PLATE": 0.40,
}

# Impact score weights.
IMPACT_WEIGHTS = {
    "lane_blockage": 0.30, "intersection_impact": 0.25, "traffic_degradation": 0.25,
    "access_blockage": 0.10, "vehicle_size": 0.10,
}
ROAD_COMPONENTS = ["lane_blockage", "intersection_impact", "access_blockage", "vehicle_size"]
DEFAULT_DEGRADATION = 0.5

# Composite risk weights.
RISK_WEIGHTS = {
    "density": 0.30, "road_importance": 0.15, "peak_norm": 0.15,
    "repeat_offender": 0.20, "validation_trust": 0.10, "heavy_vehicle_ratio": 0.10,
}

# Time buckets as (first hour, hour after the last, label).
IMPACT_BUCKETS = [(0, 6, "night"), (6, 10, "morning_peak"), (10, 14, "midday"), (14, 16, "afternoon")]
CLUSTER_BUCKETS = [
    (0, 6, "night_0_6"), (6, 10, "morning_6_10"), (10, 16, "midday_10_16"), (16, 22, "evening_16_22"),
]
LEGACY_BUCKETS = CLUSTER_BUCKETS + [(22, 24, "night_22_24")]
ALL_DAY = "all_day"
PEAK_HOURS = [8, 9, 10, 17, 18, 19]
RICH_HOURS = 16  # hours 0..15 carry data

# Geometry.
GRID_STEP = 0.005
ZONE_STEP = 0.0025
ZONE_FACTORS = {9: 1, 8: 2, 7: 8, 5: 64}
EARTH_RADIUS_M = 6371000.0
EARTH_RADIUS_KM = 6371.0
LEG_OFFSETS = [("N", 0.0035, 0.0), ("E", 0.0, 0.0036), ("S", -0.0035, 0.0), ("W", 0.0, -0.0036)]

# Seeds.
SPLIT_SEED = 1337
SEARCH_SEED = 20240315
BOOTSTRAP_SEED = 42
