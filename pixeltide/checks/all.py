"""Importing this module registers every query."""

from pixeltide.checks import annotation_checks, camera_checks, config_checks, document_checks, file_checks, frame_checks, pixel_checks, stream_checks  # noqa: F401
from pixeltide.checks.core import ORACLES, QUERIES  # noqa: F401
