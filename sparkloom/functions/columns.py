"""Scalar functions as Column expressions. The identifiers are those of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c, digits: int = 6) -> Column:
    """Rounded half away from zero, without a negative zero; for results that are compared."""
    return F.round(col(c), digits) + F.lit(0.0)


def lookup(key: Column, values: dict, default) -> Column:
    """A literal map; a missing or null key gives the default."""
    entries = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(entries, F.coalesce(key, F.lit(""))), F.lit(default))


def finite(c) -> Column:
    """Null for NaN and infinities."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


# ---- text -----------------------------------------------------------------------------------------------------------

def clean_text(c) -> Column:
    """null is empty; white space at both ends goes."""
    return F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), "^\\s+|\\s+$", "")


def normalize_tag(c, spaced: bool = True) -> Column:
    """upper case and & as AND; spaced: white space collapsed and a slash set apart by blanks."""
    out = F.replace(F.upper(clean_text(c)), F.lit("&"), F.lit("AND"))
    if not spaced:
        return out
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\\s*/\\s*", " / "), "\\s+", " "))


def parse_list(c) -> Column:
    """an array of strings from JSON, from a list in single quotes, or from text with commas; empty for null and blank."""
    s = clean_text(c)
    json = F.from_json(s, "array<string>", {"mode": "PERMISSIVE"})
    plain = F.filter(F.transform(F.split(F.regexp_replace(s, "^[\\[\\(]|[\\]\\)]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: F.trim(x) != "")
    parsed = F.when(s.startswith("[") & json.isNotNull() & ~F.exists(F.coalesce(json, F.array()), lambda x: x.isNull()), json).otherwise(plain)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(parsed)


def severity_exact(tags: Column) -> Column:
    """the highest severity of a tag that is listed; 1 if none is."""
    upper = F.transform(tags, lambda x: F.upper(clean_text(x)))
    out = F.lit(1)
    for level in sorted(t.SEVERITY_EXACT):
        out = F.when(F.arrays_overlap(upper, F.array(*[F.lit(x) for x in t.SEVERITY_EXACT[level]])), level).otherwise(out)
    return out.cast("int")


def _tag_severity(tag: Column) -> Column:
    """The highest severity whose pattern lies in the tag; null if none does."""
    out = F.lit(None).cast("int")
    for level in sorted(t.SEVERITY_PATTERNS):
        hit = F.lit(False)
        for pattern in t.SEVERITY_PATTERNS[level]:
            hit = hit | F.contains(tag, F.lit(pattern))
        out = F.when(hit, level).otherwise(out)
    return out


def severity(tags: Column, spaced: bool = True) -> Column:
    """the highest severity of a tag by patterns; 1 if none matches."""
    found = F.array_max(F.transform(tags, lambda x: _tag_severity(normalize_tag(x, spaced))))
    return F.coalesce(found, F.lit(1)).cast("int")


def matched_tags(tags: Column) -> Column:
    """the normalised tags that match a pattern."""
    return F.filter(F.transform(tags, lambda x: normalize_tag(x)), lambda x: _tag_severity(x).isNotNull())


def dominant_matched(tags: Column) -> Column:
    """the first matched tag, else the first tag; NO PARKING without tags."""
    return F.coalesce(F.get(matched_tags(tags), F.lit(0)), F.when(F.size(tags) > 0, normalize_tag(F.get(tags, F.lit(0)))), F.lit("NO PARKING"))


def dominant_tag(tags: Column) -> Column:
    """the first tag in upper case; empty without tags."""
    return F.upper(clean_text(F.get(tags, F.lit(0))))


def hotspot_unit(junction="junction_name", station="police_station") -> Column:
    """the junction if there is one, else the police station."""
    j, s = clean_text(junction), clean_text(station)
    return F.when((j != "") & (F.upper(j) != "NO JUNCTION"), F.concat(F.lit("JUNCTION::"), j)).otherwise(F.concat(F.lit("POLICE_STATION::"), F.when(s == "", "UNKNOWN").otherwise(s)))


def search_text(c) -> Column:
    """F32: lower case, anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", " "))


def cluster_key(c) -> Column:
    """whole numbers without decimals; other text as it is."""
    s = clean_text(c)
    x = s.try_cast("double")
    return F.when(x.isNotNull() & (x == F.floor(x)), x.cast("bigint").cast("string")).otherwise(s)


def physical_key(label, lat, lon, upper: bool = False) -> Column:
    """label and coordinates to five decimals."""
    text = F.replace(F.upper(clean_text(label)), F.lit("&"), F.lit("AND")) if upper else F.lower(clean_text(label))
    return F.concat_ws("|", text, F.format_string("%.5f", F.round(col(lat), 5)), F.format_string("%.5f", F.round(col(lon), 5)))


def display_label(label, cluster) -> Column:
    """F31."""
    return F.concat(clean_text(label), F.lit(" (Cluster "), col(cluster).cast("string"), F.lit(")"))


def first_non_blank(*columns, default: str = "UNASSIGNED", blank: str = "NO JUNCTION") -> Column:
    """The first column that says something."""
    options = [F.when((clean_text(c) != "") & (F.upper(clean_text(c)) != blank), clean_text(c)) for c in columns]
    return F.coalesce(*options, F.lit(default))


def shown(c, digits: int = 2) -> Column:
    """with thousands separators and fixed digits; N/A for null."""
    return F.coalesce(F.format_number(col(c).cast("double"), digits), F.lit("N/A"))


# ---- time -----------------------------------------------------------------------------------------------------------

def local_time(c, zone: str = "Asia/Kolkata") -> Column:
    """the wall clock of the zone, from a UTC timestamp."""
    return F.from_utc_timestamp(col(c).cast("timestamp"), zone)


def week_start(local) -> Column:
    """Monday, midnight."""
    return F.date_trunc("week", col(local))


def peak_flag(hour, first: int = 8, last: int = 12) -> Column:
    """F13."""
    return col(hour).between(first, last).cast("int")


def validation_score(status) -> Column:
    """F14."""
    return lookup(F.lower(clean_text(status)), t.VALIDATION_SCORE, 0.5)


# ---- numbers --------------------------------------------------------------------------------------------------------

def ratio(a, b) -> Column:
    """F17."""
    return col(a) / (col(b) + F.lit(t.EPS))


def number(c) -> Column:
    """a finite number or null."""
    return finite(col(c).cast("string").try_cast("double"))


def valid_coords(lat, lon) -> Column:
    """F19."""
    a, b = number(lat), number(lon)
    return F.coalesce(a.between(-90, 90) & b.between(-180, 180), F.lit(False))


def flag(c) -> Column:
    """F55."""
    return F.coalesce(col(c).cast("int"), F.lit(0))


def clip(c, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


# ---- geometry -------------------------------------------------------------------------------------------------------

def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """metres east and north of a reference point (equirectangular)."""
    x = F.lit(t.EARTH_M) * F.radians(col(lon) - col(lon0)) * F.cos(F.radians(col(lat0)))
    return x, F.lit(t.EARTH_M) * F.radians(col(lat) - col(lat0))


def haversine_m(lat1, lon1, lat2, lon2, radius: float = t.EARTH_M) -> Column:
    """F22 by arcsine."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine_atan_m(lat1, lon1, lat2, lon2, radius: float = t.EARTH_M) -> Column:
    """F22 by arctangent."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def offset_point(lat, lon, metres, bearing) -> tuple[Column, Column]:
    """the point at a distance and bearing (degrees) on the sphere."""
    d, b, p = col(metres) / F.lit(t.EARTH_M), F.radians(col(bearing)), F.radians(col(lat))
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    return F.degrees(q), F.degrees(F.radians(col(lon)) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q)))


# ---- roads and load -------------------------------------------------------------------------------------------------

def vehicle_width(kind) -> Column:
    """F24."""
    return lookup(F.upper(clean_text(kind)), t.VEHICLE_WIDTH, t.VEHICLE_WIDTH["UNKNOWN"])


def road_speed(road, routing: bool = False) -> Column:
    """F25."""
    return lookup(F.lower(clean_text(road)), t.ROUTE_SPEED if routing else t.ROAD_SPEED, 24.0 if routing else 30.0)


def lane_capacity(road) -> Column:
    """F25."""
    return lookup(F.lower(clean_text(road)), t.LANE_CAPACITY, 1600.0)


def lane_count(c) -> Column:
    """the first number, rounded half to even, at least 1."""
    x = F.nullif(F.regexp_extract(clean_text(c), "(\\d+(?:\\.\\d+)?)", 1), F.lit("")).cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.bround(x, 0).cast("int")))


def width_m(c) -> Column:
    """the first number; a comma is a decimal point."""
    return F.nullif(F.regexp_extract(F.replace(F.lower(clean_text(c)), F.lit(","), F.lit(".")), "(\\d+(?:\\.\\d+)?)", 1), F.lit("")).cast("double")


def road_class(c) -> Column:
    """of several classes the one of highest priority; links count as their class, unknown ones as road."""
    names = F.transform(parse_list(c), lambda x: F.regexp_replace(F.replace(F.lower(clean_text(x)), F.lit(" "), F.lit("_")), "^(motorway|trunk|primary|secondary|tertiary)_link$", "$1"))
    order = F.create_map(*[F.lit(x) for kv in {k: i for i, k in enumerate(t.ROAD_PRIORITY)}.items() for x in kv])
    best = F.array_min(F.transform(names, lambda x: F.coalesce(F.element_at(order, x), F.lit(len(t.ROAD_PRIORITY) - 1))))
    return F.when(col(c).isNull() | best.isNull(), "road").otherwise(F.element_at(F.array(*[F.lit(x) for x in t.ROAD_PRIORITY]), best + 1))


def departures_per_hour(dwell_minutes) -> Column:
    """mu."""
    return F.lit(60.0) / (col(dwell_minutes) + F.lit(t.EPS))


def load(arrivals, departures) -> Column:
    """L."""
    return col(arrivals) / (col(departures) + F.lit(t.EPS))


def blocked_fraction(load_, vehicle_m, carriageway_m) -> Column:
    """F34."""
    return clip(col(load_) * col(vehicle_m) / (col(carriageway_m) + F.lit(t.EPS)), 0.0, 0.95)


def reduced_capacity(base, blocked) -> Column:
    """F34."""
    return F.greatest(col(base) * (1 - col(blocked)), col(base) * 0.1)


def free_flow_minutes(length_m, speed) -> Column:
    """F35."""
    return col(length_m) * 60.0 / (col(speed) * 1000.0)


def bpr_delay(free, volume, base, reduced, alpha: float = 0.56, beta: float = 2.12) -> Column:
    """minutes more at the reduced capacity; not finite or negative: 0."""
    d = col(free) * alpha * (F.pow(col(volume) / col(reduced), F.lit(beta)) - F.pow(col(volume) / col(base), F.lit(beta)))
    return F.greatest(F.coalesce(finite(d), F.lit(0.0)), F.lit(0.0))


def weekly_pressure(records, severity_, peak_share, repeat_share, growth) -> Column:
    """F36."""
    return F.log1p(col(records)) * (1 + clip(severity_, 1.0, 5.0) / 5) * (1 + 0.5 * clip(peak_share, 0.0, 1.0)) * (1 + clip(repeat_share, 0.0, 1.0)) * (1 + clip(growth, 0.0, 5.0))


# ---- scores and plans -----------------------------------------------------------------------------------------------

def score_100(raw, low, high) -> Column:
    """F37."""
    return F.when(col(high) - col(low) <= F.lit(1e-12), 50.0).otherwise(clip(100.0 * (col(raw) - col(low)) / (col(high) - col(low)), 0.0, 100.0))


def band(score, limits=(80.0, 60.0, 40.0), names=("Critical", "High", "Moderate", "Watch")) -> Column:
    """F38; limits may be columns."""
    s = col(score)
    cuts = [x if isinstance(x, Column) else F.lit(x) for x in limits]
    return F.when(s >= cuts[0], names[0]).when(s >= cuts[1], names[1]).when(s >= cuts[2], names[2]).otherwise(names[3])


def band_index(b) -> Column:
    """F39."""
    return lookup(col(b), {k: i for i, k in enumerate(t.BANDS)}, 0)


def worse_band(a, b) -> Column:
    """F39."""
    return F.element_at(F.array(*[F.lit(x) for x in t.BANDS]), F.greatest(band_index(a), band_index(b)) + 1)


def time_window(peak_hour, start=None, end=None) -> Column:
    """HH:00-HH:00, from one hour before the peak to two after it."""
    peak = F.coalesce(col(peak_hour), F.lit(8)).cast("int")
    first = F.coalesce(col(start).cast("int"), peak - 1) if start is not None else peak - 1
    last = F.coalesce(col(end).cast("int"), peak + 2) if end is not None else peak + 2
    two = lambda x: F.lpad(clip(x, 0, 24).cast("string"), 2, "0")
    return F.concat(two(first), F.lit(":00-"), two(last), F.lit(":00"))


def shift(hour) -> Column:
    """F41."""
    return F.when(col(hour) < 12, "Morning").when(col(hour) < 17, "Afternoon").otherwise("Evening")


def shift_by_peak_or_score(hour, score) -> tuple[Column, Column]:
    """shift and window by the peak hour; without one by the score."""
    h, s = col(hour), col(score)
    by = lambda a, b, c, d, e, f, g, i: F.when(h.isNull(), F.when(s >= 80, a).when(s >= 60, b).when(s >= 40, c).otherwise(d)).when((h >= 6) & (h < 10), e).when((h >= 10) & (h < 14), f).when((h >= 14) & (h < 19), g).otherwise(i)
    names = by("Morning", "Evening", "Midday", "Night", "Morning", "Midday", "Evening", "Night")
    windows = by("08:00-11:00", "17:00-20:00", "11:00-14:00", "20:00-23:00", "07:00-10:00", "10:00-13:00", "15:00-18:00", "20:00-23:00")
    return names, windows


#: Wordings by band, for hotspots, forecasts and offenders
HOTSPOT_ACTIONS = {"Critical": "Immediate patrol deployment", "High": "Targeted enforcement + towing readiness", "Moderate": "Monitor and schedule peak-window checks"}
FORECAST_ACTIONS = HOTSPOT_ACTIONS | {"High": "Targeted enforcement + tow readiness"}
OFFENDER_ACTIONS = {"Critical": "Special watch + field verification", "High": "Targeted surveillance + repeat checks", "Moderate": "Monitor vehicle pattern"}


def action(b, wording: dict = HOTSPOT_ACTIONS, default: str = "Routine monitoring") -> Column:
    """F43."""
    return lookup(col(b), wording, default)


def dispatch_action(b, tow, patrols) -> Column:
    """F43, for dispatch."""
    b, tow = col(b), col(tow)
    return (F.when((b == "Critical") & tow, "Immediate patrol + tow standby + camera watch").when(b == "Critical", "Immediate patrol deployment")
        .when((b == "High") & tow, "Targeted patrol + tow readiness").when(b == "High", "Targeted patrol + close monitoring")
        .when((b == "Moderate") & (col(patrols) >= 2), "Scheduled patrol + peak-window checks").when(b == "Moderate", "Peak-window checks").otherwise("Routine monitoring"))


def tow_required(score, final_band, probability, road, width, lanes, high_centrality, chronic, repeat2, least_score: float = 70.0) -> Column:
    """a risky place (score at least least_score, a high band, or probability 0.5), on an arterial or narrow road, with repeat offenders."""
    risky = (col(score) >= least_score) | col(final_band).isin("Critical", "High") | (col(probability) >= 0.5)
    arterial = F.lower(F.coalesce(col(road), F.lit("road"))).isin("motorway", "trunk", "primary", "secondary", "tertiary", "road")
    tight = arterial | (F.coalesce(col(width), F.lit(7.0)) <= 7.5) | (F.coalesce(col(lanes), F.lit(2)) <= 2) | col(high_centrality)
    return risky & tight & ((col(chronic) >= 1) | (col(repeat2) >= 3) | (col(score) >= 80))


def offender_tier(n) -> Column:
    """F45."""
    return F.when(col(n) >= 20, "Critical").when(col(n) >= 10, "High").when(col(n) >= 5, "Moderate").otherwise("Watch")


def stabilised(current, predicted) -> Column:
    """F46."""
    mixed = 0.7 * col(current) + 0.3 * col(predicted)
    return clip(col(current) + clip(mixed - col(current), -20.0, 20.0), 0.0, 100.0)


def forecast_priority(score, probability, delta) -> Column:
    """F47."""
    return 0.5 * col(score) + 30 * col(probability) + 10 * F.greatest(col(delta), F.lit(0.0))


def context_multiplier(poi, traffic_ratio) -> Column:
    """F48."""
    return clip(1 + F.least(F.lit(0.5), 0.08 * col(poi)) + F.least(F.lit(0.5), F.greatest(F.lit(0.0), 0.25 * (col(traffic_ratio) - 1))), 1.0, 2.0)


def geofence_radius(poi) -> Column:
    """F49."""
    return F.when(col(poi) > 0, 100 + F.least(F.lit(400), 50 * col(poi)))


def checks_status(ok) -> Column:
    """F51."""
    return F.when(col(ok) >= 2, "validated").when(col(ok) == 1, "partial").otherwise("unvalidated")


def staffing(units) -> tuple[Column, Column]:
    """coverage and delay reduction in percent."""
    return F.least(F.lit(100.0), 42 + 5.5 * col(units)), F.least(F.lit(35.0), 3.5 + 1.8 * col(units))


def explained(names) -> Column:
    """the share in percent of each of several measures of a row, scaled between the row's least and greatest; equal shares where all are alike."""
    v = F.array(*[col(n).cast("double") for n in names])
    low, span = F.array_min(v), F.array_max(v) - F.array_min(v)
    scaled = F.transform(v, lambda y: (y - low) / (span + t.EPS))
    total = F.aggregate(scaled, F.lit(0.0), lambda p, q: p + q)
    return F.when(span > 0, F.transform(scaled, lambda y: 100 * y / (total + t.EPS))).otherwise(F.array(*[F.lit(100.0 / len(names))] * len(names)))
