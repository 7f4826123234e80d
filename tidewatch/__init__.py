"""Shipment-order anomaly analytics on Spark DataFrames."""

from tidewatch.config import DetectorConfig
from tidewatch.errors import DataValidationError
from tidewatch.operators.validate import validate_orders
from tidewatch.plans.analyze import analyze, analyze_files
from tidewatch.plans.detect import detect

__all__ = [
    "DataValidationError", "DetectorConfig", "analyze", "analyze_files", "detect", "validate_orders",
]
