"""Sources and sinks: log readers, corpora derived from the driver tables, writers."""

from logweave.sources.logs import (
    read_logs, logformat_to_regex, parse_raw_logs, parse_raw_lines, dense_line_ids, line_window, read_labels,
)
from logweave.sources.corpora import (
    event_logs, event_labels, doc_lines, conversation_lines, page_urls, order_logs,
)
from logweave.sources.sinks import valid_results, write_results, dedup_count, summary_upsert
from logweave.sources.profiles import PROFILES, profiles_frame, profile

__all__ = [n for n in dir() if not n.startswith("_")]
