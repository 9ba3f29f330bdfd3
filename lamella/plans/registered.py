"""All registered queries: importing this module registers those of every module beside it."""

from . import reports, series, volumes  # noqa: F401
from .catalog import ORACLE, QUERIES  # noqa: F401
