"""Loading tables in small, repeatable batches and checking what was loaded, in DataFrames and Spark SQL."""

from tableload.functions.columns import (
    decode_base64,
    project,
    select_all,
    stamp_load_time,
    with_commit_metadata,
    with_file_name,
)
from tableload.operators.keyed import bulk_load, bulk_load_table, dedupe_batch, merge_into, upsert
from tableload.operators.layout import file_sizes, rechunk
from tableload.operators.publish import (
    drop_snapshots,
    key_bucket,
    merge_partitions,
    merge_snapshot,
    publish_snapshot,
    read_partitions,
    read_snapshot,
    rows_since,
    upsert_partitions,
    upsert_snapshot,
)
from tableload.operators.quality import (
    ApproxCountDistinct,
    Check,
    Completeness,
    Mean,
    NonNegative,
    Size,
    Uniqueness,
    metrics_table,
    run_analyzers,
    verify,
    write_reports,
)
from tableload.operators.states import check_partitions, metrics_from_states, write_states
from tableload.operators.tables import create_table, insert_all, insert_by_name, replace_partitions
from tableload.operators.writes import (
    Report,
    append,
    create,
    load_warehouse,
    observe_counts,
    overwrite,
    overwrite_partitions,
    write_csv,
    write_single_csv,
)
from tableload.plans.sql import sql_transform
from tableload.sources.delimited import scan_csv, scan_large_csv
from tableload.sources.quoted import scan_quoted_csv
from tableload.sources.records import (
    bad_records,
    decode_envelope,
    encode_envelope,
    good_records,
    only_good_records,
    records_to_table,
)
from tableload.sources.tables import (
    catalog_schema,
    scan,
    scan_catalog_entry,
    scan_catalog_table,
    scan_parquet,
    scan_table,
    scan_view,
)
from tableload.streaming.micro_batch import read_envelopes, stream_append, stream_upsert
from tableload.workspace import LeaseError, drop_scratch, scratch_path, writer

__all__ = [name for name in dir() if not name.startswith("_")]
