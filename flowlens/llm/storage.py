"""Intermediate tables of the training-data operators, in the shared folder."""

from flowlens.sources.stage import shared_folder, stored

__all__ = ["shared_folder", "stored"]
