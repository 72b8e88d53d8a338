"""Column labels: canonical names and the alias dictionary."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

_NOT_WORD = "[^A-Za-z0-9_]"


def canonical_name(label: Column) -> Column:
    """Lower-case ASCII letters, digits and underscores of a label."""
    return F.lower(F.regexp_replace(label, _NOT_WORD, ""))


def underscore_name(label: Column) -> Column:
    """Canonical name that keeps word breaks as underscores."""
    return F.regexp_replace(F.replace(F.lower(label), F.lit(" "), F.lit("_")), _NOT_WORD, "")


# Labels whose canonical name follows neither rule.
SPECIAL_LABELS = {
    "0-100kph Time(s)": "kphTime0-100",
    "0-100mph Time(s)": "mphTime0-100",
    "0-200kph Time(s)": "kphTime0-200",
    "0-30mph Time(s)": "mphTime0-300",
    "0-60mph Time(s)": "mphTime0-60",
    "1/4 mile time(s)": "quarterMileTime",
    "1/8 mile time(s)": "eighthMileTime",
    "100-0kph Time(s)": "kphTime100-0",
    "100-200kph Time(s)": "kphTime100-200",
    "40-60mph Time(s)": "mphTime40-60",
    "60-0mph Time(s)": "mphTime60-0",
    "60-120mph Time(s)": "mphTime60-120",
    "60-130mph Time(s)": "mphTime60-130",
    "60-80mph Time(s)": "mphTime60-80",
    "80-100mph Time(s)": "mphTime80-100",
    "80-120kph Time(s)": "kphTime80-120",
    "0200kphtimes": "kphTime0200",
    "100200kphtimes": "kphTime100200",
    "030mphtimes": "mphtimes030",
    "060mphtimes": "mphtimes060",
    "60130mphtimes": "mphtimes60130",
    "8mphtimes0100": "mphtimes01008",
    "6080mphtimes": "mphtimes6080",
    "60120mphtimes": "mphtimes60120",
    "14miletimes": "miletimes14",
    "18miletimes": "miletimes18",
    "1000kphtimes": "kphTime1000",
    "Torque(Nm)": "torquefnm",
    "Air Fuel Ratio(Measured)(:1)": "airfuelrationmeasure",
    "Altitude": "altitudem",
    "Barometric pressure (from vehicle)(psi)": "barometricpressurefromvpsi",
    "G(x)": "gravityxg",
    "G(y)": "gravityyg",
    "G(z)": "gravityzg",
    "Gravity X(G)": "gravityxg",
    "Gravity Y(G)": "gravityyg",
    "Gravity Z(G)": "gravityzg",
}

# Labels named by the underscore rule.
UNDERSCORE_LABELS = [
    "Accelerator PedalPosition F(%)",
    "Relative Accelerator Pedal Position(%)",
    "Fuel trim bank 1 sensor 1(%)",
    "Fuel Rate (direct from ECU)(L/m)",
    "Fuel pressure(psi)",
    "Percentage of Highway driving(%)",
    "Barometer (on Android device)(mb)",
    "Cost per mile/km (Trip)(£/km)",
    "EGR Commanded(%)",
    "NOx Post SCR(ppm)",
    "Commanded Equivalence Ratio(lambda)",
    "NOx Pre SCR(ppm)",
    "Engine Oil Temperature(°C)",
    "Fuel Rail Pressure (relative to manifold vacuum)(psi)",
    "O2 Sensor1 Equivalence Ratio(alternate)",
    "Engine Load(Absolute)(%)",
    "Charge air cooler temperature (CACT)(°C)",
    "Charge air cooler temperature (CACT)(°F)",
    "DPF Pressure(bar)",
    "DPF Temperature(°F)",
    "Engine Oil Temperature(°F)",
    "Run time since engine start(s)",
    "Relative Throttle Position(%)",
    "Timing Advance(°)",
    "Hybrid Battery Charge (%)(%)",
    "Accelerator PedalPosition D(%)",
    "Evap System Vapour Pressure(Pa)",
    "Turbo Pressure Control(psi)",
    "O2 Sensor1 Equivalence Ratio",
    "Absolute Throttle Position B(%)",
    "Exhaust Pressure(psi)",
    "DPF Pressure(psi)",
    "DPF Temperature(°C)",
    "EGR Error(%)",
    "Fuel Trim Bank 1 Long Term(%)",
    "Cost per mile/km (Instant)(£/km)",
    "Accelerator PedalPosition E(%)",
    "Ethanol Fuel %(%)",
    "Drivers demand engine % torque(%)",
    "Distance travelled since codes cleared(km)",
    "Air Fuel Ratio(Commanded)(:1)",
    "Fuel Level (From Engine ECU)(%)",
    "Engine reference torque(Nm)",
    "Exhaust Pressure(bar)",
    "Fuel Rail Pressure (relative to manifold vacuum)(kpa)",
    "Turbo Pressure Control(bar)",
    "Exhaust gas temp Bank 1 Sensor 1(°C)",
    "Exhaust gas temp Bank 1 Sensor 1(°F)",
    "Exhaust gas temp Bank 1 Sensor 2(°C)",
    "Exhaust gas temp Bank 1 Sensor 2(°F)",
    "Exhaust gas temp Bank 1 Sensor 3(°C)",
    "Exhaust gas temp Bank 1 Sensor 3(°F)",
    "Exhaust gas temp Bank 1 Sensor 4(°C)",
    "Exhaust gas temp Bank 1 Sensor 4(°F)",
    "Exhaust gas temp Bank 2 Sensor 1(°C)",
    "Exhaust gas temp Bank 2 Sensor 1(°F)",
    "Exhaust gas temp Bank 2 Sensor 2(°C)",
    "Exhaust gas temp Bank 2 Sensor 2(°F)",
    "Exhaust gas temp Bank 2 Sensor 3(°C)",
    "Exhaust gas temp Bank 2 Sensor 3(°F)",
    "Exhaust gas temp Bank 2 Sensor 4(°C)",
    "Exhaust gas temp Bank 2 Sensor 4(°F)",
    "Catalyst Temperature (Bank 1 Sensor 1)(°C)",
    "Catalyst Temperature (Bank 1 Sensor 1)(°F)",
    "Catalyst Temperature (Bank 1 Sensor 2)(°C)",
    "Catalyst Temperature (Bank 1 Sensor 2)(°F)",
    "Catalyst Temperature (Bank 2 Sensor 1)(°C)",
    "Catalyst Temperature (Bank 2 Sensor 1)(°F)",
    "Catalyst Temperature (Bank 2 Sensor 2)(°C)",
    "Catalyst Temperature (Bank 2 Sensor 2)(°F)",
    "Transmission Temperature(Method 1)(°C)",
    "Transmission Temperature(Method 1)(°F)",
    "Transmission Temperature(Method 2)(°C)",
    "Transmission Temperature(Method 2)(°F)",
]


def alias_name(label: Column, extra: dict[str, str] | None = None, known: list[str] | None = None) -> Column:
    """Name of a raw label: dictionary first (``extra`` overrides it), else the canonical rule.

    With ``known`` columns, a dictionary name that is none of them gives way to a canonical one that is."""
    label = F.trim(label)
    special = {**SPECIAL_LABELS, **(extra or {})}
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(special.items())])
    overridden = set(extra or {})
    by_underscore = label.isin([x for x in UNDERSCORE_LABELS if x not in overridden])
    plain = canonical_name(label)
    named = F.coalesce(lookup[label], F.when(by_underscore, underscore_name(label)), plain)
    if known is None:
        return named
    return F.when(~named.isin(known) & plain.isin(known), plain).otherwise(named)


def merge_labels(known: DataFrame, labels: DataFrame, label: str = "label", name: str = "name") -> DataFrame:
    """Dictionary (label, name) extended by new labels, named by the underscore rule.

    A label that is already known gets its new name.
    """
    fresh = labels.select(label).distinct().withColumn("_fresh", underscore_name(F.col(label)))
    return known.join(fresh, label, "full_outer").select(
        label, F.coalesce("_fresh", name).alias(name)
    )
