"""Supplier-bill control on Spark: extraction, duplicates, checks, risk, workflow, reports.

Every operator is a function from DataFrames to a DataFrame; nothing here
collects data to the driver.
"""

import sys

from pyspark import cloudpickle

# Python functions of the package travel to the workers with the job that uses them, so
# executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
