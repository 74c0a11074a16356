"""flowlens: Spark-native analytics over click-level workflow event logs.

Layers:
  functions/  column expressions (pure, JVM-side, codegen-friendly)
  sources/    readers, writers and the adapters that map the given tables to event logs
  operators/  DataFrame operators: instance assembly, evaluation, sampling, similarity, roll-ups
  plans/      the registered queries and their independent DuckDB oracles
  streaming/  incremental evaluation of an append-only response log
"""

__version__ = "0.1.0"
