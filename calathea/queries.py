"""All queries of the library."""

from .plans import assets, calendars, catalog, library, models, places, reads, series, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
