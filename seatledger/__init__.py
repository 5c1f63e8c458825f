"""seatledger: set-based reports and change batches for shared-subscription resale, on Spark."""

from .model import Tables  # noqa: F401
