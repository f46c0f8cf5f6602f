"""All registered queries."""

from . import q_basic, q_features, q_joins, q_landing, q_landing_text, q_metrics, q_models, q_seismic, q_streaming, q_windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
