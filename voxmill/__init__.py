"""voxmill: instance analytics on 3D volumes held as Spark tables of voxels."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Grouped-map helpers travel with the job, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
