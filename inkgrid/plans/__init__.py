"""All registered queries and their SQL."""

from inkgrid.plans import q_catalog, q_misc, q_outlines, q_palette, q_pixels, q_shapes  # noqa: F401
from inkgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
