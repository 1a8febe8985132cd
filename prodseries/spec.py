"""Roles of the columns of a daily entity series.

Operators are written against role names (``entity``, ``day``, ``hours`` ...).
A :class:`SeriesSpec` says which source column plays which role, so the same
operator runs on any table with one row per (entity, day).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Raw values keep all their decimals; measures have the scale of a SeriesSpec.
EXACT = T.DecimalType(38, 18)
MEASURE = T.DecimalType(18, 6)
TOTAL = T.DecimalType(28, 6)

VOLUMES = ("oil", "gas", "water")
FLUIDS = VOLUMES + ("injection",)
STATES = ("OP", "WI")
MODES = ("production", "injection")
STATE_LABELS = {"OP": "Producer", "WI": "Injector"}


def exactly(column: Column, source: T.DataType, target: T.DecimalType) -> Column:
    """The column as a decimal type; a value that would be rounded or cut is an error."""
    if isinstance(source, T.IntegralType) or isinstance(source, T.DecimalType) and source.scale <= target.scale:
        return column.cast(target)
    wide = column.cast(EXACT) if not isinstance(source, T.DecimalType) else column
    wrong = F.raise_error(F.concat(F.lit(f"does not fit {target.simpleString()}: "), column.cast("string")))
    return F.when(wide.isNotNull(), F.when(wide == wide.cast(target), wide.cast(target)).otherwise(wrong))


@dataclass(frozen=True)
class SeriesSpec:
    """Source column for each role. Defaults are the names of the core tables."""

    entity: str = "npd_well_bore_code"
    entity_name: str = "npd_well_bore_name"
    day: str = "production_date"
    hours: str = "on_stream_hrs"
    state: str = "well_type"
    mode: str = "flow_kind"
    oil: str = "bore_oil_vol"
    gas: str = "bore_gas_vol"
    water: str = "bore_wat_vol"
    injection: str = "bore_wi_vol"
    sensors: dict[str, str] = field(
        default_factory=lambda: {
            "downhole_pressure": "avg_downhole_pressure",
            "downhole_temperature": "avg_downhole_temperature",
            "tubing_dp": "avg_dp_tubing",
            "annulus_pressure": "avg_annulus_press",
            "choke_size": "avg_choke_size_p",
            "wellhead_pressure": "avg_whp_p",
            "wellhead_temperature": "avg_wht_p",
            "choke_dp": "dp_choke_size",
        }
    )
    labels: dict[str, str] = field(default_factory=lambda: {"choke_unit": "avg_choke_uom"})
    # (should be the larger, should be the smaller): reviewed, never enforced
    ordered_sensors: tuple[tuple[str, str], ...] = (
        ("downhole_pressure", "wellhead_pressure"),
        ("downhole_temperature", "wellhead_temperature"),
    )
    #: The type of all measures. Choose more decimals for finer data: values that do not fit stop the read.
    measure: T.DecimalType = MEASURE
    choke: str | None = "choke_size"
    choke_partner: str | None = "choke_dp"

    FACT_ROLES = ("entity", "day", "state", "mode", "hours", "oil", "gas", "water", "injection")

    def fact(self, df: DataFrame) -> DataFrame:
        """Project a daily table to its roles; measures take the spec's type."""
        number = lambda name: exactly(F.col(name), df.schema[name].dataType, self.measure)
        cols = []
        for role in self.FACT_ROLES:
            c = F.col(getattr(self, role))
            if role == "day":
                c = c.cast("date")
            elif role in ("hours", "oil", "gas", "water", "injection"):
                c = number(getattr(self, role))
            cols.append(c.alias(role))
        cols += [number(src).alias(role) for role, src in self.sensors.items()]
        cols += [F.col(src).alias(role) for role, src in self.labels.items()]
        return df.select(*cols)

    def dimension(self, df: DataFrame) -> DataFrame:
        """Project a dimension table to (entity, entity_name)."""
        return df.select(
            F.col(self.entity).alias("entity"), F.col(self.entity_name).alias("entity_name")
        )

    def comments(self) -> dict[str, str]:
        """Comment of each source column that plays a role."""
        out = {}
        for role in (*self.FACT_ROLES, "entity_name"):
            kind, unit, null = ROLE_NOTES[role]
            out[getattr(self, role)] = f"{kind}{f' in {unit}' if unit else ''}; NULL: {null}"
        out |= {src: f"{role.replace('_', ' ')}; NULL: not measured" for role, src in {**self.sensors, **self.labels}.items()}
        return out

    def publish(self, df: DataFrame) -> DataFrame:
        """Rename role columns back to the names of this spec."""
        names = {role: getattr(self, role) for role in self.FACT_ROLES}
        names["entity_name"] = "wellbore_name" if self.entity_name == "npd_well_bore_name" else self.entity_name
        names.update(self.sensors)
        names.update(self.labels)
        return df.withColumnsRenamed({r: s for r, s in names.items() if r in df.columns})


# The driver tables mapped onto the roles (see sources/driver_tables.py).
DRIVER = SeriesSpec(
    entity="entity",
    entity_name="entity_name",
    day="day",
    hours="hours",
    state="state",
    mode="mode",
    oil="oil",
    gas="gas",
    water="water",
    injection="injection",
    sensors={"downhole": "downhole", "wellhead": "wellhead"},
    labels={},
    ordered_sensors=(("downhole", "wellhead"),),
    choke="wellhead",
    choke_partner="downhole",
)

# What each role holds, its unit, and what NULL means: the role metadata behind
# describe_views() and the column comments of the published tables.
ROLE_NOTES = {
    "entity": ("identifier", "", "never NULL"),
    "entity_name": ("identifier", "", "never NULL"),
    "day": ("date", "day", "never NULL"),
    "state": ("operating state", "", "never NULL; may change from day to day"),
    "mode": ("operating mode", "", "never NULL; may change from day to day"),
    "hours": ("activity", "hours", "not measured; different from a recorded 0"),
    "oil": ("volume", "Sm3", "not applicable or not measured; different from 0"),
    "gas": ("volume", "Sm3", "not applicable or not measured; different from 0"),
    "water": ("volume", "Sm3", "not applicable or not measured; may be negative"),
    "injection": ("volume", "Sm3", "not applicable or not measured; different from 0"),
    "is_active": ("activity flag", "", "hours not measured: neither active nor inactive"),
}


def role_of(column: str, spec: SeriesSpec) -> str:
    """Static classification of a column: identifier, volume, sensor and so on."""
    if column in ROLE_NOTES:
        return ROLE_NOTES[column][0]
    if column in spec.sensors:
        for kind in ("pressure", "temperature", "choke"):
            if kind in column:
                return kind
        return "sensor"
    if column in spec.labels:
        return "unit label"
    return "other"
