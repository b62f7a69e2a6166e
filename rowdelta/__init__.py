"""Exact dataset comparison on Spark DataFrames."""

__version__ = "0.1.0"

from rowdelta.api import (  # noqa: E402
    compare_fields_files,
    compare_fields_files_sorted,
    compare_file_fields,
    compare_file_fields_sorted,
    compare_file_schema,
    compare_files,
    compare_sources,
    duplicates_source,
)
from rowdelta.errors import (  # noqa: E402
    ComparatorError,
    CorruptedInputError,
    DiskLimitExceededError,
    InvalidInputError,
    KeyExtractionError,
    MissingOptionalDependencyError,
    NormalizationError,
    RowDeltaError,
    TempStorageError,
    UnsupportedFormatError,
)
from rowdelta.functions.normalize import compose_normalizers, string_normalizer  # noqa: E402
from rowdelta.operators.approx import BloomFilter, build_bloom_filter, probabilistic_diff_candidates  # noqa: E402
from rowdelta.operators.duplicates import duplicate_groups, duplicates  # noqa: E402
from rowdelta.operators.events import (  # noqa: E402
    EventSummary,
    iter_compare_events,
    iter_event_rows,
    iter_field_diff_events,
    iter_sorted_field_diff_events,
    schema_diff_result_events,
    summarize_event_file,
    summarize_events,
)
from rowdelta.operators.fields import FieldChange, FieldDiffResult, FieldDiffStats, compare_fields, compare_fields_sorted, iter_field_diff_sorted  # noqa: E402
from rowdelta.operators.fuzzy import compare_fuzzy_strings  # noqa: E402
from rowdelta.operators.presence import compare, compare_by_hash, compare_by_key, compare_iter, compare_streams, diff, intersection, unique  # noqa: E402
from rowdelta.operators.results import CompareResult, CompareStats  # noqa: E402
from rowdelta.operators.schema import ColumnSchema, SchemaDiffResult, SchemaResult, compare_schema, infer_schema  # noqa: E402
from rowdelta.operators.sinks import iter_field_diff_rows, iter_result_rows, iter_result_values  # noqa: E402
from rowdelta.sources.connectors import (  # noqa: E402
    ConnectorRegistry,
    CSVConnector,
    DataFrameConnector,
    FileConnector,
    IterableConnector,
    JSONLConnector,
    ParquetConnector,
    SourceConnector,
    TableConnector,
    TextConnector,
    TSVConnector,
    connect,
    create_connector,
    list_connectors,
    register_connector,
)
from rowdelta.streaming.merge import compare_sorted_iter, iter_sorted_diff, write_sorted_diff, write_sorted_diff_file  # noqa: E402

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("api", "errors", "functions", "operators", "plans", "sources", "streaming")]
