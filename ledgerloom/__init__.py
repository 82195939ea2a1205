"""ledgerloom: a Spark-first analytics engine for corporate disclosures.

Every operator is a ``DataFrame -> DataFrame`` function.  Python functions that
run on executors are pickled by value, so the executors need no copy of this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
