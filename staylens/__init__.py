"""staylens — hotel booking occupancy-volatility analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built on
Spark SQL built-ins.  Sub-packages:

* ``functions`` — column expressions (date parsing, segment mapping, null tokens)
* ``sources``   — CSV scan, schema contracts, driver-table fixture mapping, sinks
* ``operators`` — cleaning, fact build, KPI views, metrics, quality, dashboard data
* ``plans``     — session settings, materialisation, the end-to-end pipeline,
                  the query registry and its DuckDB oracle SQL
* ``streaming`` — intentionally empty (batch-only by design)
"""

from staylens.config import Config, DEFAULT_CONFIG

__all__ = ["Config", "DEFAULT_CONFIG"]
