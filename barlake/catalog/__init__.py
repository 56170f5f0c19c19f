"""Named queries with their check SQL."""

from barlake.catalog import bars, market, models, news, quality, readers, storage, trading
from barlake.catalog.base import ORACLES, QUERIES
