"""Registered queries and their SQL: importing the package registers all."""

from . import background, distortion, drizzling, masters, measurement, objects, photometry, registration, resampling
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "background", "distortion", "drizzling", "masters", "measurement", "objects", "photometry", "registration", "resampling"]
