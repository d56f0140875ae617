"""Marginalia: searching, converting, chunking and indexing a corpus of notes on Spark."""

import sys

from pyspark import cloudpickle

from marginalia.config import EngineConfig, load_config
from marginalia.session import build_session

__all__ = ["EngineConfig", "build_session", "load_config"]

# Functions sent to the workers carry their code along, so the workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
