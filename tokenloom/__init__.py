"""tokenloom: language-model data work as Spark DataFrame / SQL / Streaming jobs.

Subpackages
-----------
sources    corpus readers, bounded ingest, sinks (S1-S8)
functions  column expressions: text, arrays, math (P1-P4, P7-P12, A7, T2, V1)
operators  vocabulary, sequences, rank/split/shard/batch, n-gram scoring,
           decoding, evaluation, telemetry, vectors, UDF surface
plans      end-to-end jobs composed from the operators
streaming  Structured Streaming ingest, tokenization and log roll-up (ST1-ST3)
"""

__version__ = "0.1.0"
