"""callrisk: payment-default risk analytics on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function (chain with
``df.transform``); sources build DataFrames, sinks write them.
"""

__version__ = "0.1.0"
