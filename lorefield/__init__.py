"""lorefield: a Spark-native engine for knowledge corpora.

Sub-packages: ``functions`` (column expressions), ``operators`` (relational operators), ``plans``
(composed queries), ``sources`` (readers, chunkers, sinks) and ``streaming`` (Structured Streaming).
Everything is written on the DataFrame API; Python runs only where no built-in expression can say it.
"""
