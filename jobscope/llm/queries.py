"""Loads every operator module, so that its query is registered."""

from . import (  # noqa: F401
    collocations,
    decontaminate,
    id_files,
    imatch,
    kneser_ney,
    language_id,
    license_scan,
    near_dedup,
    sampled_pieces,
    site_style_tree,
    substring_dedup,
    warc,
    whitening,
)
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
