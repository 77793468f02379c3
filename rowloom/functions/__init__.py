"""Functions for computed cells: column expressions only."""

from .cells import *  # noqa: F403
