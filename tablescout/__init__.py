"""PySpark library for catalog search, guarded reads, log scoring and run events.

Functions of the package travel to the executors inside the tasks that use them, so the
package has to be installed on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
