"""All registered queries."""

from .registry import ORACLE, QUERIES  # noqa: F401
from . import catalog_lexicon, catalog_audit, catalog_episodes, catalog_inks, catalog_jobs, catalog_masks, catalog_raster  # noqa: F401
