from .corpus import (ingest_bounded, nth_smallest, read_corpus, read_tokenized,
                     source_kind)
from .sinks import append_metrics, manifest, write_manifest, write_tokenized

__all__ = ["ingest_bounded", "nth_smallest", "read_corpus", "read_tokenized", "source_kind",
           "append_metrics", "manifest", "write_manifest", "write_tokenized"]
