from .ingest import finish_log_windows, stream_ingest, stream_log_windows, stream_metrics, stream_tokenize

__all__ = ["finish_log_windows", "stream_ingest", "stream_log_windows", "stream_metrics", "stream_tokenize"]
