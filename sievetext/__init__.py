"""sievetext: preparing and learning from text with untrusted labels, on Spark.

Sub-packages: ``functions`` (Column expressions), ``operators`` (DataFrame ->
DataFrame operators), ``sources`` (readers and writers), ``plans`` (multi-stage
preparation and training), ``streaming`` (per-micro-batch encoding).
``queries`` registers every operator as a query over the given tables.
"""

__version__ = "0.1.0"
