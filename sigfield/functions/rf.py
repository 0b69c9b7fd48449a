"""Radio propagation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigfield.functions.scalars import clamp, smoothstep

# fixed values: attenuation in dB, reflection, absorption, penetration of each material
MATERIAL = {
    "drywall": (4.0, 0.08, 0.22, 0.90),
    "glass": (2.5, 0.16, 0.16, 0.76),
    "wood": (3.0, 0.10, 0.28, 0.82),
    "brick": (11.0, 0.18, 0.46, 0.58),
    "concrete": (22.0, 0.26, 0.64, 0.38),
    "reinforced_concrete": (28.0, 0.38, 0.78, 0.22),
    "stone": (14.0, 0.24, 0.58, 0.44),
    "metal": (42.0, 0.74, 0.90, 0.08),
}
# fixed values: path loss exponent, wall factor, radius in m, shadow factor, diffraction, loss at 1 m
# and exponent of an access point's prediction
BAND = {
    "24ghz": (1.72, 0.86, 42.0, 0.82, 0.34, 52.0, 1.82),
    "5ghz": (2.12, 1.18, 28.0, 1.05, 0.22, 56.0, 2.12),
    "6ghz": (2.34, 1.34, 22.0, 1.18, 0.16, 58.0, 2.28),
}


def _lookup(key: Column, table: dict, at: int, default: str) -> Column:
    out = F.lit(table[default][at])
    for name, row in table.items():
        if name != default:
            out = F.when(key == name, row[at]).otherwise(out)
    return out


def of_material(m: Column, at: int) -> Column:
    return _lookup(m, MATERIAL, at, "drywall")


def of_band(b: Column, at: int) -> Column:
    return _lookup(b, BAND, at, "24ghz")


def distance_decay_db(d_m: Column, band: Column) -> Column:
    return F.when(d_m > 0, of_band(band, 0) * 10 * F.log10(d_m + 1)).otherwise(F.lit(0.0))


def material_loss_db(material: Column, band: Column, thickness_m: Column) -> Column:
    return of_material(material, 0) * of_band(band, 1) * clamp(thickness_m / 0.12, 0.65, 2.4)


def crossing_loss_db(material: Column, band: Column, thickness_m: Column, path_angle: Column, wall_angle: Column) -> Column:
    """What one crossing of a wall costs."""
    steep = clamp(F.lit(1.0) / F.greatest(F.abs(F.sin(path_angle - wall_angle)), F.lit(0.26)), 1.0, 2.8)
    through = material_loss_db(material, band, thickness_m) * steep * (F.lit(1.08) - of_material(material, 3) * 0.22)
    return through + of_material(material, 1) * of_band(band, 1) * 2.6 + of_material(material, 2) * of_band(band, 3) * 1.8


def obstacle_loss_db(material: Column, band: Column, runs: Column, blocked: Column, px_per_m: Column) -> Column:
    """Loss of a ray with so many blocked runs and samples."""
    base = material_loss_db(material, band, F.lit(0.1))
    return runs * base * (F.lit(0.44) + of_material(material, 2) * 0.22) + F.least(F.lit(12.0), blocked / F.greatest(px_per_m, F.lit(1.0)) * base * (F.lit(0.28) + of_material(material, 1) * 0.18))


def shadow_db(wall_db: Column, band: Column) -> Column:
    """Shadow behind walls of a loss."""
    wall = F.greatest(wall_db, F.lit(0.0))
    return F.least(F.lit(18.0), wall * 0.18 * of_band(band, 3) + F.sqrt(wall) * 0.45)


def propagation_loss_db(d_m: Column, wall_db: Column, band: Column) -> Column:
    wall = F.greatest(wall_db, F.lit(0.0))
    shadow = shadow_db(wall, band)
    credit = F.when(wall > 0, F.least(wall * 0.18, of_band(band, 4) * F.sqrt(d_m + 1))).otherwise(F.lit(0.0))
    return distance_decay_db(d_m, band) + wall + shadow - credit


def angular_difference_deg(a: Column, b: Column) -> Column:
    return F.abs(((a - b) % 360 + 540) % 360 - 180)


def antenna_loss_db(directional: Column, azimuth_deg: Column, bearing_deg: Column) -> Column:
    return F.when(directional, smoothstep(35.0, 165.0, angular_difference_deg(azimuth_deg, bearing_deg)) * 14).otherwise(F.lit(0.0))


def transmit_dbm(signal_dbm: Column, band: Column, gain_db: Column) -> Column:
    return F.when(signal_dbm < 0, clamp(signal_dbm + of_band(band, 5) - gain_db, 0.0, 30.0)).otherwise(F.lit(20.0))


def predicted_rssi(d_m: Column, band: Column, signal_dbm: Column, gain_db: Column, radius_m: Column, wall_db: Column, antenna_db: Column) -> Column:
    """RSSI that an access point gives at a distance behind walls."""
    gain = clamp(gain_db, 0.0, 12.0)
    reach = clamp(radius_m, 4.0, 120.0)
    wall = F.greatest(wall_db, F.lit(0.0))
    shadow = shadow_db(wall, band)
    credit = F.when(wall > 0, F.least(wall * 0.18, of_band(band, 4) * F.sqrt(d_m + 1))).otherwise(F.lit(0.0))
    log_loss = of_band(band, 5) + of_band(band, 6) * 10 * F.log10(F.greatest(d_m, F.lit(1.0)))
    beyond = smoothstep(reach * 0.82, reach * 1.35, d_m) * 18
    return clamp(transmit_dbm(signal_dbm, band, gain) + gain - log_loss - wall - shadow + credit - beyond - antenna_db, -96.0, -24.0)


def idw_weight(d: Column, power: float | Column = 2.2, alpha: float | Column = 0.0) -> Column:
    """Inverse distance weight, infinite at distance 0."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    power = power if isinstance(power, Column) else F.lit(float(power))
    return F.when(d <= 1e-9, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.pow(F.greatest(d, F.lit(1e-9)) + F.greatest(alpha, F.lit(0.0)), power))
