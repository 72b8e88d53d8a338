"""Small trip logs written by the tests."""

from datetime import datetime, timedelta
from pathlib import Path

HEADER = "GPS Time, Device Time, Longitude, Latitude,GPS Speed(km/h),Speed (OBD)(km/h),Fuel cost (trip)(cost)"
T0 = datetime(2022, 6, 29, 8, 0, 0)


def gps(t):
    return t.strftime("%a %b %d %H:%M:%S GMT %Y")


def device(t):
    return t.strftime("%d-%b-%Y %H:%M:%S.") + f"{t.microsecond // 1000:03d}"


def row(t, lon=10.0, lat=50.0, gps_speed="30.5", obd="31", cost="1.25"):
    return f"{gps(t)},{device(t)},{lon},{lat},{gps_speed},{obd},{cost}"


def trip(start=T0, n=60, step=1, lon=10.0, lat=50.0):
    """Rows of a trip that moves north-east."""
    return [row(start + timedelta(seconds=i * step), lon + i * 0.001, lat + i * 0.001) for i in range(n)]


def write(folder, name, rows, header=HEADER):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return path
