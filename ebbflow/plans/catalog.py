"""Imports every query module so that its registrations run."""

from . import cube_queries  # noqa: F401
from . import profile_queries  # noqa: F401
from . import feature_queries  # noqa: F401
from . import join_queries  # noqa: F401
from . import quality_queries  # noqa: F401
from . import forecast_queries  # noqa: F401
from . import scenario_queries  # noqa: F401
from . import source_queries  # noqa: F401
