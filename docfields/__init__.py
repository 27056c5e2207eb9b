"""docfields: PySpark-native document field extraction and table profiling.

Every operator is a plain ``DataFrame -> DataFrame`` function; see the
sub-packages ``sources``, ``functions``, ``operators``, ``plans`` and
``streaming``.
"""

__version__ = "0.1.0"
