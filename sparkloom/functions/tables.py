"""Lookup tables and patterns that results depend on."""

# fixed values: violation tags by severity for exact comparison
SEVERITY_EXACT = {
    5: ["DOUBLE PARKING", "NEAR ROAD CROSSING", "NEAR TRAFFIC LIGHT", "NEAR TRAFFIC LIGHT / ZEBRA CROSSING", "NEAR ZEBRA CROSSING"],
    4: ["PARKING IN MAIN ROAD", "NEAR BUS STOP", "NEAR SCHOOL", "NEAR HOSPITAL", "OPPOSITE ANOTHER VEHICLE"],
    3: ["PARKING ON FOOTPATH"],
    2: ["WRONG PARKING", "PARKING OTHER THAN BUS STOP"],
    1: ["NO PARKING"],
}

# fixed values: patterns by severity that may lie anywhere in a tag
SEVERITY_PATTERNS = SEVERITY_EXACT | {
    5: [*SEVERITY_EXACT[5], "NEAR TRAFFIC LIGHT/ZEBRA CROSSING"],
    1: ["NO PARKING", "NO PARKING (GENERIC)"],
}

# fixed values: km/h by road class
ROAD_SPEED = {"motorway": 60.0, "trunk": 55.0, "primary": 45.0, "secondary": 40.0, "tertiary": 35.0, "unclassified": 30.0, "residential": 30.0, "living_street": 20.0, "service": 25.0, "road": 30.0}

# fixed values: km/h by road class for routing in a city
ROUTE_SPEED = {"motorway": 55.0, "trunk": 50.0, "primary": 40.0, "secondary": 35.0, "tertiary": 30.0, "unclassified": 28.0, "residential": 24.0, "living_street": 18.0, "service": 20.0, "road": 24.0}

# fixed values: vehicles per hour and lane by road class
LANE_CAPACITY = {"motorway": 2200.0, "trunk": 2100.0, "primary": 1900.0, "secondary": 1800.0, "tertiary": 1700.0, "unclassified": 1650.0, "residential": 1500.0, "living_street": 1200.0, "service": 1400.0, "road": 1600.0}

# fixed values: metres by vehicle type
VEHICLE_WIDTH = {
    "SCOOTER": 0.80, "MOTOR CYCLE": 0.90, "MOTORCYCLE": 0.90, "BICYCLE": 0.60, "CYCLE": 0.60, "PASSENGER AUTO": 1.60, "AUTO": 1.60,
    "CAR": 1.90, "SUV": 2.00, "JEEP": 2.00, "VAN": 2.20, "TEMPO": 2.20, "BUS": 2.60, "TRUCK": 2.60, "LORRY": 2.60, "TANKER": 2.80,
    "TRACTOR": 2.20, "MINI TRUCK": 2.20, "AMBULANCE": 2.00, "UNKNOWN": 1.90,
}

# fixed values: score by validation status (any other: 0.5)
VALIDATION_SCORE = {"approved": 1.0, "rejected": 0.0, "processing": 0.5, "duplicate": 0.25, "created1": 0.5}

# fixed values: address parts, in the order of a joined address
ADDRESS_PARTS = ["houseNumber", "houseName", "poi", "street", "subSubLocality", "subLocality", "locality", "village", "subDistrict", "district", "city", "state", "pincode"]

ROAD_PRIORITY = list(ROAD_SPEED)
BANDS = ["Watch", "Moderate", "High", "Critical"]
EPS = 1e-9
EARTH_M = 6371000.0

# The weights of the composite scores, by component.
EMERGING_WEIGHTS = {"anomaly": 0.32, "growth_norm": 0.26, "resurgence_norm": 0.18, "slope_norm": 0.12, "recent_norm": 0.12}
NOVELTY_WEIGHTS = {"rop": 0.25, "tvs": 0.20, "vdi": 0.20, "validation_uncertainty": 0.20, "resurgence_score": 0.15}
PRESSURE_WEIGHTS = {
    "ccs_score": 0.25, "delay": 0.15, "growth_surge": 0.10, "layer_b_priority_boost": 0.10, "context_boost": 0.08, "persistence_score": 0.10, "resurgence_score": 0.10,
    "validation_uncertainty": 0.05, "anomaly_score": 0.04, "rop": 0.06, "tvs": 0.04, "vdi": 0.03,
}
VULNERABILITY_WEIGHTS = {"source_pressure_score": 0.35, "spillover_out_score": 0.20, "spillover_in_score": 0.15, "road_node_betweenness": 0.15, "network_pagerank": 0.10, "resurgence_score": 0.05, "validation_uncertainty": 0.05}
PRIORITY_WEIGHTS = {
    "probability_of_escalation": 0.22, "predicted_next_week_ccs_score": 0.18, "current_week_ccs_proxy_score": 0.08, "criticality_factor": 0.08, "growth_multiplier": 0.07, "growth_pct_change": 0.05,
    "layer_b_priority_boost": 0.05, "validation_uncertainty": 0.05, "rop": 0.08, "tvs": 0.06, "vdi": 0.05, "resurgence_score": 0.05, "anomaly_score": 0.04, "network_vulnerability_score": 0.04,
    "spillover_total_score": 0.01, "nearby_sensitive_poi_count": 0.01,
}
DISPATCH_WEIGHTS = {"ccs_score": 0.38, "predicted_next_week_ccs_score": 0.18, "probability_of_escalation": 0.18, "growth_pct_change": 0.14, "criticality_factor": 0.12}
PRESCRIPTIVE_WEIGHTS = {"dispatch_priority_score": 0.24, "predicted_next_week_ccs_score": 0.22, "probability_of_escalation": 0.20, "ccs_score": 0.12, "growth_pct_change": 0.10, "criticality_factor": 0.08, "offender_pressure": 0.04}
OFFENDER_WEIGHTS = {"chronic_vehicles": 0.6, "repeat_vehicles": 0.4}

# What a component counts as where no layer gives it, and the weights of persistence made from volume.
FEATURE_DEFAULTS = {
    "context_multiplier": 1.0, "layer_b_priority_boost": 0.0, "layer_b_alert_flag": False, "validation_uncertainty": None, "resurgence_score": None,
    "persistence_score": None, "anomaly_score": None, "rop": None, "tvs": None, "vdi": None,
}
PERSISTENCE_WEIGHTS = {"records": 0.35, "distinct_days": 0.25, "repeat_vehicles": 0.25, "chronic_vehicles": 0.15}

# How columns collapse to a physical place: (rule, value of a missing one) and the columns.
COLLAPSE_RULES = {
    ("max", None): ["ccs_score", "delay", "resurgence_score", "persistence_score", "anomaly_score", "rop", "tvs", "vdi"],
    ("max", 0): ["distinct_days", "growth_pct_change", "layer_b_priority_boost", "spillover_out_score", "spillover_in_score", "spillover_total_score", "neighbor_count", "in_neighbor_count", "out_neighbor_count", "influence_asymmetry"],
    ("max", 1): ["growth_multiplier", "context_multiplier"],
    ("sum", 0): ["records", "severity_sum", "nearby_sensitive_poi_count"],
    ("mean", 0): ["severity_mean"],
    ("mean", None): [
        "lat", "lon", "validation_uncertainty", "lane_count", "carriageway_width_m", "link_length_m", "junction_degree", "betweenness_centrality", "road_node_distance_m", "road_node_degree",
        "road_node_betweenness", "source_pressure_score", "source_pressure_norm", "propagation_radius_m", "network_pagerank", "network_vulnerability_score",
    ],
    ("any", False): ["layer_b_alert_flag", "layer_d_alert_flag"],
    ("top", None): ["cluster_label", "cluster_label_display", "risk_band", "road_node_id"],
    ("top", ""): ["mappls_address"],
    ("top", "road"): ["road_class"],
    ("top", "fallback"): ["geometry_source"],
    ("first", 0): ["network_component_id"],
    ("first", 1): ["network_component_size"],
}
