"""siltmark: before/after change analytics over many located, timed events, as Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing loops over events on the driver.

Conventions
-----------
* Times are UTC.  ``session.prepare`` pins the session time zone.
* A pixel value is NULL when not measured, 0 when measured without evidence and
  positive when there is evidence.  NaN is turned into NULL on ingest.
* A raster is a long table of cells keyed by (event, ..., row, col).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Arrow helpers travel to the executors by value, so no package install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
