"""Operational-telemetry analytics as Spark DataFrame functions.

Every public function takes DataFrames and returns DataFrames (or Columns), so a
pipeline is one declarative plan.  See the README for the map of modules.
"""

__version__ = "0.1.0"
