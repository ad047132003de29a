"""windrow: a PySpark-native engine for windowed sequence predictions and the tables around them.

Everything takes and returns DataFrames or Columns. The subpackage ``llm`` holds the
operators for training data; nothing outside it imports it.
"""

__version__ = "0.1.0"
