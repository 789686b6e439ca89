"""Code tables of both GRIB editions and the texts built from them, as column expressions.

Tables are Python dictionaries; ``name`` turns one into a constant map expression and
``frame`` into a small DataFrame for broadcast joins.  The parameter tables of edition 1
run to hundreds of entries per centre, so they are an argument: a DataFrame (or a CSV
read by Spark) with columns centre, table_version, parameter, name, short, unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Published WMO code tables (number: meaning).
DISCIPLINE = {
    0: "Meteorological products",
    1: "Hydrological products",
    2: "Land surface products",
    3: "Satellite remote sensing products",
    4: "Space weather products",
    10: "Oceanographic products",
    20: "Health and socioeconomic impacts",
    255: "Missing",
}
CENTRE2 = {
    7: "US National Weather Service - NCEP",
    8: "US NWS Telecommunications Gateway",
    9: "US National Weather Service - Other",
    34: "Tokyo (RSMC) - JMA",
    38: "Beijing (RSMC) - CMA",
    40: "Seoul - KMA",
    46: "INPE",
    54: "Montreal (RSMC) - CMC",
    58: "Fleet Numerical Meteorology and Oceanography Center",
    59: "NOAA Forecast Systems Laboratory",
    60: "NCAR",
    74: "UK Met Office - Exeter (RSMC)",
    78: "Offenbach (RSMC) - DWD",
    80: "Rome (RSMC)",
    82: "Norrköping - SMHI",
    85: "Toulouse (RSMC) - Météo-France",
    86: "Helsinki - FMI",
    88: "Oslo - MET Norway",
    94: "Copenhagen - DMI",
    97: "European Space Agency (ESA)",
    98: "European Centre for Medium-Range Weather Forecasts (ECMWF)",
    173: "NASA",
}
SIGNIFICANCE = {
    0: "Analysis",
    1: "Start of forecast",
    2: "Verifying time of forecast",
    3: "Observation time",
    255: "Missing",
}
STATUS = {
    0: "Operational products",
    1: "Operational test products",
    2: "Research products",
    3: "Re-analysis products",
    4: "TIGGE",
    5: "TIGGE test",
    6: "S2S operational products",
    7: "S2S test products",
    8: "UERRA",
    9: "UERRA test",
    10: "Climate Data Record",
    11: "Climate projections",
    12: "Climate Forecast System Reanalysis",
    13: "Climate Forecast System Reforecasts",
    255: "Missing",
}
GRID_TEMPLATE = {
    0: "Latitude/longitude",
    1: "Rotated latitude/longitude",
    2: "Stretched latitude/longitude",
    3: "Stretched and rotated latitude/longitude",
    10: "Mercator",
    20: "Polar stereographic",
    30: "Lambert conformal",
    31: "Albers equal area",
    40: "Gaussian latitude/longitude",
    41: "Rotated Gaussian latitude/longitude",
    50: "Spherical harmonic coefficients",
    90: "Space view perspective",
    100: "Triangular grid (icosahedral)",
    110: "Equatorial azimuthal equidistant",
    120: "Azimuth-range projection",
    140: "Lambert azimuthal equal area",
}
EARTH_SHAPE = {
    0: "Spherical (radius 6 367 470.0 m)",
    1: "Spherical (custom radius)",
    2: "Oblate spheroid (IAU 1965)",
    3: "Oblate spheroid (custom axes)",
    4: "Oblate spheroid (IAG-GRS80)",
    5: "Oblate spheroid (WGS84)",
    6: "Spherical (radius 6 371 229.0 m)",
    7: "Oblate spheroid (custom axes, m)",
    8: "Spherical (radius 6 371 200.0 m, derived)",
    9: "Oblate spheroid (OSGB 1936 / Airy)",
}
PROCESS = {
    0: "Analysis",
    1: "Initialization",
    2: "Forecast",
    3: "Bias-corrected forecast",
    4: "Ensemble forecast",
    5: "Probability forecast",
    6: "Forecast error",
    7: "Analysis error",
    8: "Observation",
    9: "Climatological",
    10: "Probability-weighted forecast",
    11: "Bias-corrected ensemble forecast",
    12: "Post-processed analysis",
    13: "Post-processed forecast",
    14: "Nowcast",
    15: "Hindcast",
    16: "Physical retrieval",
    17: "Regression analysis",
    18: "Difference between two forecasts",
    255: "Missing",
}
TIME_UNIT = {
    0: "Minute",
    1: "Hour",
    2: "Day",
    3: "Month",
    4: "Year",
    5: "Decade (10 years)",
    6: "Normal (30 years)",
    7: "Century",
    10: "3 hours",
    11: "6 hours",
    12: "12 hours",
    13: "Second",
    255: "Missing",
}
SURFACE = {
    1: "Ground or water surface",
    2: "Cloud base level",
    3: "Cloud top level",
    4: "Level of 0°C isotherm",
    5: "Level of adiabatic condensation lifted from the surface",
    6: "Maximum wind level",
    7: "Tropopause",
    8: "Nominal top of the atmosphere",
    9: "Sea bottom",
    20: "Isothermal level (K)",
    100: "Isobaric surface (Pa)",
    101: "Mean sea level",
    102: "Specific altitude above mean sea level (m)",
    103: "Specified height above ground (m)",
    104: "Sigma level",
    105: "Hybrid level",
    106: "Depth below land surface (m)",
    107: "Isentropic (theta) level (K)",
    108: "Level at specified pressure difference from ground (Pa)",
    109: "Potential vorticity surface (10⁻⁶ K m² kg⁻¹ s⁻¹)",
    117: "Mixed-layer depth",
    160: "Depth below sea level (m)",
    200: "Entire atmosphere as a single layer",
    201: "Entire ocean as a single layer",
    255: "Missing",
}
ENSEMBLE = {
    0: "Unperturbed high-resolution control forecast",
    1: "Unperturbed low-resolution control forecast",
    2: "Negatively perturbed forecast",
    3: "Positively perturbed forecast",
    4: "Multi-model forecast",
    255: "Missing",
}
STATISTIC = {
    0: "Average",
    1: "Accumulation",
    2: "Maximum",
    3: "Minimum",
    4: "Difference (end minus start)",
    5: "Root mean square",
    6: "Standard deviation",
    7: "Covariance",
    8: "Difference (start minus end)",
    9: "Ratio",
    10: "Standardized anomaly",
    11: "Summation",
    12: "Confidence index",
    13: "Quality indicator",
    255: "Missing",
}
DATA_TYPE = {
    0: "Analysis products",
    1: "Forecast products",
    2: "Analysis and forecast products",
    3: "Control forecast products",
    4: "Perturbed forecast products",
    5: "Control and perturbed forecast products",
    6: "Processed satellite observations",
    7: "Processed radar observations",
    8: "Event probability",
    255: "Missing",
}
LEVEL1 = {
    0: "Ground or water surface",
    1: "Cloud base level",
    2: "Cloud top level",
    3: "0°C isotherm level",
    4: "Adiabatic condensation level",
    5: "Maximum wind speed level",
    6: "Tropopause level",
    7: "Nominal atmosphere top",
    8: "Sea bottom",
    100: "Isobaric level",
    101: "Layer between two isobaric levels",
    102: "Mean sea level",
    103: "Specified altitude above MSL",
    104: "Layer between two altitudes above MSL",
    105: "Specified height above ground",
    106: "Layer between two heights above ground",
    107: "Sigma level",
    108: "Layer between two sigma levels",
    109: "Hybrid level",
    110: "Layer between two hybrid levels",
    111: "Depth below land surface",
    112: "Layer between two depths below land surface",
    113: "Isentropic (theta) level",
    114: "Layer between two isentropic levels",
    115: "Level at specified pressure difference from ground",
    116: "Layer between two pressure difference levels",
    117: "Potential vorticity surface",
    119: "NAM level",
    120: "Layer between two NAM levels",
    121: "Isobaric layer (high precision)",
    125: "Specified height above ground (high precision)",
    126: "Isobaric level (Pa, high precision)",
    128: "Sigma layer (high precision)",
    141: "Layer between two isobaric surfaces (mixed precision)",
    160: "Subsurface depth",
    200: "Entire atmosphere",
    201: "Entire ocean",
    204: "Highest tropospheric freezing level",
    205: "Cloud ceiling",
    209: "Maximum wind level",
    210: "Boundary layer cloud bottom level",
    211: "Boundary layer cloud top level",
    212: "Boundary layer cloud layer",
    213: "Low cloud bottom level",
    214: "Low cloud top level",
    215: "Low cloud layer",
    216: "Medium cloud bottom level",
    217: "Medium cloud top level",
    218: "Medium cloud layer",
    219: "High cloud bottom level",
    220: "High cloud top level",
    221: "High cloud layer",
    241: "Convective cloud bottom level",
    242: "Convective cloud top level",
}
CENTRE1 = {
    1: "Melbourne (WMC)",
    2: "Melbourne (WMC)",
    3: "Melbourne (WMC)",
    4: "Moscow (WMC)",
    5: "Moscow (WMC)",
    6: "Moscow (WMC)",
    7: "US National Weather Service - NCEP",
    8: "US NWS Telecommunications Gateway",
    9: "US National Weather Service - Other",
    10: "Cairo (RSMC)",
    11: "Cairo (RSMC)",
    12: "Dakar (RSMC)",
    13: "Dakar (RSMC)",
    14: "Nairobi (RSMC)",
    15: "Nairobi (RSMC)",
    16: "Casablanca (RSMC)",
    17: "Tunis (RSMC)",
    18: "Tunis-Casablanca (RSMC)",
    19: "Tunis-Casablanca (RSMC)",
    20: "Las Palmas",
    21: "Algiers (RSMC)",
    22: "ACMAD",
    23: "Mozambique NMC",
    24: "Pretoria (RSMC)",
    25: "La Réunion (RSMC)",
    26: "Khabarovsk (RSMC)",
    27: "Khabarovsk (RSMC)",
    28: "New Delhi (RSMC)",
    29: "New Delhi (RSMC)",
    30: "Novosibirsk (RSMC)",
    31: "Novosibirsk (RSMC)",
    32: "Tashkent (RSMC)",
    33: "Jeddah (RSMC)",
    34: "Tokyo (RSMC)",
    35: "Tokyo (RSMC)",
    36: "Bangkok",
    37: "Ulaanbaatar",
    38: "Beijing (RSMC)",
    39: "Beijing (RSMC)",
    40: "Seoul",
    41: "Buenos Aires (RSMC)",
    42: "Buenos Aires (RSMC)",
    43: "Brasilia (RSMC)",
    44: "Brasilia (RSMC)",
    45: "Santiago",
    46: "Brazilian Space Agency - INPE",
    47: "Colombia NMC",
    48: "Ecuador NMC",
    49: "Peru NMC",
    50: "Venezuela NMC",
    51: "Miami (RSMC)",
    52: "Miami (RSMC)",
    53: "MSC Monitoring",
    54: "Montreal (RSMC)",
    55: "San Francisco",
    57: "US Air Force - AFGWC",
    58: "Fleet Numerical Meteorology and Oceanography Center",
    59: "NOAA Forecast Systems Laboratory",
    60: "NCAR",
    61: "Service ARGOS - Landover",
    62: "US Naval Oceanographic Office",
    63: "IRI",
    64: "Honolulu (RSMC)",
    65: "Darwin (RSMC)",
    66: "Darwin (RSMC)",
    67: "Melbourne (RSMC)",
    69: "Wellington (RSMC)",
    70: "Wellington (RSMC)",
    71: "Nadi (RSMC)",
    72: "Singapore",
    73: "Malaysia NMC",
    74: "UK Met Office - Exeter (RSMC)",
    75: "UK Met Office - Exeter (RSMC)",
    76: "Moscow (RSMC)",
    78: "Offenbach (RSMC)",
    79: "Offenbach (RSMC)",
    80: "Rome (RSMC)",
    81: "Rome (RSMC)",
    82: "Norrköping",
    83: "Norrköping",
    84: "Toulouse (RSMC)",
    85: "Toulouse (RSMC)",
    86: "Helsinki",
    87: "Belgrade",
    88: "Oslo",
    89: "Prague",
    90: "Episkopi",
    91: "Ankara",
    92: "Frankfurt/Main",
    93: "London (WAFC)",
    94: "Copenhagen",
    95: "Rota",
    96: "Athens",
    97: "European Space Agency (ESA)",
    98: "European Centre for Medium-Range Weather Forecasts (ECMWF)",
    99: "De Bilt",
    100: "Brazzaville",
}
# Parameters of edition 2 (discipline, category, number): (short name, name, unit).
PARAMETER2 = {
    (0, 0, 0): ("TMP", "Temperature", "K"),
    (0, 0, 1): ("VTMP", "Virtual temperature", "K"),
    (0, 0, 2): ("POT", "Potential temperature", "K"),
    (0, 0, 3): ("EPOT", "Pseudo-adiabatic potential temperature", "K"),
    (0, 0, 4): ("TMAX", "Maximum temperature", "K"),
    (0, 0, 5): ("TMIN", "Minimum temperature", "K"),
    (0, 0, 6): ("DPT", "Dew-point temperature", "K"),
    (0, 0, 7): ("DEPR", "Dew-point depression", "K"),
    (0, 0, 8): ("LAPR", "Lapse rate", "K m⁻¹"),
    (0, 0, 17): ("SKINT", "Skin temperature", "K"),
    (0, 1, 0): ("SPFH", "Specific humidity", "kg kg⁻¹"),
    (0, 1, 1): ("RH", "Relative humidity", "%"),
    (0, 1, 2): ("MIXR", "Humidity mixing ratio", "kg kg⁻¹"),
    (0, 1, 3): ("PWAT", "Precipitable water", "kg m⁻²"),
    (0, 1, 7): ("PRATE", "Precipitation rate", "kg m⁻² s⁻¹"),
    (0, 1, 8): ("APCP", "Total precipitation", "kg m⁻²"),
    (0, 1, 9): ("NCPCP", "Large-scale precipitation (non-conv.)", "kg m⁻²"),
    (0, 1, 10): ("ACPCP", "Convective precipitation", "kg m⁻²"),
    (0, 1, 11): ("SNOD", "Snow depth", "m"),
    (0, 1, 13): ("WEASD", "Water equivalent of accumulated snow depth", "kg m⁻²"),
    (0, 1, 22): ("CLWMR", "Cloud mixing ratio", "kg kg⁻¹"),
    (0, 2, 0): ("WDIR", "Wind direction (from which blowing)", "° true"),
    (0, 2, 1): ("WIND", "Wind speed", "m s⁻¹"),
    (0, 2, 2): ("UGRD", "U-component of wind", "m s⁻¹"),
    (0, 2, 3): ("VGRD", "V-component of wind", "m s⁻¹"),
    (0, 2, 8): ("VVEL", "Vertical velocity (pressure)", "Pa s⁻¹"),
    (0, 2, 9): ("DZDT", "Vertical velocity (geometric)", "m s⁻¹"),
    (0, 2, 10): ("ABSV", "Absolute vorticity", "s⁻¹"),
    (0, 3, 0): ("PRES", "Pressure", "Pa"),
    (0, 3, 1): ("PRMSL", "Pressure reduced to MSL", "Pa"),
    (0, 3, 2): ("PTEND", "Pressure tendency", "Pa s⁻¹"),
    (0, 3, 5): ("HGT", "Geopotential height", "gpm"),
    (0, 3, 6): ("DIST", "Geometric height", "m"),
    (0, 3, 9): ("DEN", "Density", "kg m⁻³"),
    (0, 6, 1): ("TCDC", "Total cloud cover", "%"),
    (0, 6, 3): ("LCDC", "Low cloud cover", "%"),
    (0, 6, 4): ("MCDC", "Medium cloud cover", "%"),
    (0, 6, 5): ("HCDC", "High cloud cover", "%"),
    (0, 7, 6): ("CAPE", "Convective available potential energy", "J kg⁻¹"),
    (0, 7, 7): ("CIN", "Convective inhibition", "J kg⁻¹"),
    (2, 0, 0): ("LAND", "Land cover (0=sea, 1=land)", "proportion"),
    (2, 0, 5): ("SOILM", "Soil moisture content", "kg m⁻²"),
    (10, 0, 3): ("WVHGT", "Significant height of combined wind+swell", "m"),
    (10, 1, 2): ("SST", "Sea surface temperature", "K"),
}
# Fallbacks and local ranges.
FALLBACK = {"DISCIPLINE": "Unknown discipline", "SIGNIFICANCE": "Unknown", "STATUS": "Unknown", "GRID_TEMPLATE": "Unknown grid template", "EARTH_SHAPE": "Unknown earth shape", "PROCESS": "Unknown generating process", "TIME_UNIT": "Unknown time-range unit", "SURFACE": "Unknown fixed surface", "ENSEMBLE": "Unknown ensemble type", "STATISTIC": "Unknown statistical process", "DATA_TYPE": "Unknown", "LEVEL1": "Unknown level type", "CENTRE1": "Unknown centre"}
LOCAL = ("PROCESS", "SURFACE", "ENSEMBLE", "STATISTIC", "DATA_TYPE")  # 192 to 254 are reserved for local use
# Units and pattern of the level values of edition 1.
LEVEL_UNIT = {100: "hPa", 115: "hPa", 116: "hPa", 121: "hPa", 141: "hPa", 103: "m", 105: "m", 160: "m", 111: "cm", 112: "cm", 125: "cm", 113: "K", 114: "K", 126: "Pa", 117: "PVU", 107: "σ", 108: "σ", 128: "σ", 101: "kPa", 104: "hm", 106: "hm"}
NO_LEVEL = (*range(1, 10), 102, 200, 201, 204, 205, 209, *range(210, 222), 241, 242)


def name(table: str, code: Column) -> Column:
    """Meaning of a code; the table's fallback (NULL if it has none) for unknown codes."""
    known = globals()[table]
    m = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    out = F.try_element_at(m, code.cast("int"))
    if table in LOCAL:
        out = F.coalesce(out, F.when(code.between(192, 254), "Reserved for local use"))
    return F.coalesce(out, F.lit(FALLBACK[table])) if table in FALLBACK else out


def frame(spark: SparkSession, table: str) -> DataFrame:
    """(code, name) of a table."""
    return spark.createDataFrame(sorted(globals()[table].items()), "code int, name string")


def parameters2(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*k, *v) for k, v in PARAMETER2.items()], "discipline int, category int, number int, short string, name string, unit string")


def with_parameter2(messages: DataFrame) -> DataFrame:
    """Parameter short name, name and unit by a broadcast join; unknown ones are named by their numbers."""
    j = messages.join(F.broadcast(parameters2(messages.sparkSession)), ["discipline", "category", "number"], "left")
    return j.withColumn("name", F.coalesce("name", F.format_string("Parameter %d/%d/%d", "discipline", "category", "number")))


def with_parameter1(messages: DataFrame, table: DataFrame) -> DataFrame:
    """Parameters of edition 1 from a given table: the centre's own tables from 128 on, else the common one (centre NULL)."""
    own = table.where("centre is not null").select("centre", "table_version", "parameter", F.struct("name", "short", "unit").alias("_own"))
    base = table.where("centre is null").select("parameter", F.struct("name", "short", "unit").alias("_base"))
    j = messages.join(F.broadcast(own), ["centre", "table_version", "parameter"], "left").join(F.broadcast(base), "parameter", "left")
    local = (F.col("table_version") >= 128) & (F.col("centre") == 98)
    pick = F.when(local, F.col("_own")).otherwise(F.coalesce("_own", "_base"))
    return j.withColumn("_p", pick).withColumns({"name": F.coalesce("_p.name", F.format_string("Parameter %d", "parameter")), "short": F.col("_p.short"), "unit": F.col("_p.unit")}).drop("_p", "_own", "_base")


def hours1(unit: Column, p: Column) -> Column:
    """Forecast hours of edition 1: minutes truncate, seconds round."""
    p = p.cast("int")
    factor = F.when(unit == 2, 24).when(unit == 10, 3).when(unit == 11, 6).when(unit == 12, 12).otherwise(1)
    return F.when(unit == 0, F.floor(p / 60)).when(unit == 13, F.floor(p / 3600.0 + 0.5)).otherwise(p * factor).cast("int")


def forecast1(unit: Column, p1: Column, p2: Column, time_range: Column) -> Column:
    """Forecast text of edition 1 by time range indicator."""
    a, b = hours1(unit, p1).cast("string"), hours1(unit, p2).cast("string")
    both = hours1(unit, p1 * 256 + p2).cast("string")
    span = lambda end: F.concat(a, F.lit("–"), b, F.lit(end))
    return (
        F.when(time_range == 1, "analysis").when(time_range == 2, span("h valid")).when(time_range == 3, span("h average")).when(time_range == 4, span("h accum"))
        .when(time_range == 5, span("h diff")).when(time_range == 6, F.concat(F.lit("−"), a, F.lit(" to −"), b, F.lit("h average")))
        .when(time_range == 7, F.concat(F.lit("−"), a, F.lit(" to +"), b, F.lit("h average"))).when(time_range == 10, F.concat(F.lit("+"), both, F.lit("h")))
        .when(time_range == 51, "climatological mean").otherwise(F.concat(F.lit("+"), a, F.lit("h")))
    )


def hours2(unit: Column, t: Column) -> Column:
    """Forecast hours of edition 2 (integer division truncates); 0 for units without hours."""
    cut = lambda n: F.expr("0") + (F.signum(t) * F.floor(F.abs(t) / n)).cast("int")
    return F.when(unit == 0, cut(60)).when(unit == 1, t).when(unit == 2, t * 24).when(unit == 10, t * 3).when(unit == 11, t * 6).when(unit == 12, t * 12).when(unit == 13, cut(3600)).otherwise(0).cast("int")


def forecast2(unit: Column, t: Column) -> Column:
    return F.when(unit == 1, F.concat(F.lit("+"), t.cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("+"), t.cast("string"), F.lit(" "), name("TIME_UNIT", unit)))


def level1(kind: Column, a: Column, b: Column) -> Column:
    """Level value text of edition 1."""
    both = a * 256 + b
    two = lambda f, x, y: F.format_string(f"{f} – {f}", x, y)
    return (
        F.when(kind.isin(*NO_LEVEL), "—").when(kind == 125, F.format_string("%.2f", both / 100.0)).when(kind == 107, F.format_string("%.4f", both / 10000.0))
        .when(kind == 117, F.format_string("%.3f", both / 1000.0)).when(kind.isin(101, 104, 106, 110, 112, 116, 120), two("%d", a, b)).when(kind == 108, two("%.2f", a / 100.0, b / 100.0))
        .when(kind == 114, two("%d", 475 - a, 475 - b)).when(kind == 121, two("%d", 1100 - a, 1100 - b)).when(kind == 128, two("%.3f", 1.1 - a * 0.001, 1.1 - b * 0.001))
        .when(kind == 141, two("%d", a, 1100 - b)).otherwise(both.cast("string"))
    )


def level_type1(kind: Column) -> Column:
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL_UNIT.items() for x in kv]), kind.cast("int"))
    return F.when(unit.isNull(), name("LEVEL1", kind)).otherwise(F.concat(F.lit("("), unit, F.lit(") "), name("LEVEL1", kind)))


def surface_value(scale: Column, scaled: Column) -> Column:
    """scaled * 10^-scale; NULL if either is missing (255, all ones)."""
    return F.when((scale != 255) & (scaled != 4294967295), scaled * F.pow(F.lit(10.0), -scale.cast("double")))


def reference_time1(century: Column, yy: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    return F.format_string("%04d-%02d-%02dT%02d:%02d:00Z", (century - 1) * 100 + yy, month, day, hour, minute)
