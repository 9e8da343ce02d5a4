"""All SQL twins. The import order matters: later modules refer to earlier selects."""

from renewlake.oracles import snapshots  # noqa: F401  isort: skip
from renewlake.oracles import feature_store  # noqa: F401  isort: skip
from renewlake.oracles import ingest  # noqa: F401  isort: skip
from renewlake.oracles import descriptive  # noqa: F401  isort: skip
from renewlake.oracles import predictive  # noqa: F401  isort: skip
from renewlake.oracles.base import ORACLES

__all__ = ["ORACLES"]
