"""Declared schemas of the inputs. Every inventory or history row names its server."""

SCHEMAS = {
    "tables": "server STRING, object_id INT, schema_id INT, table_name STRING, is_system BOOLEAN,"
    " is_memory_optimized BOOLEAN, is_replicated BOOLEAN, is_cdc_tracked BOOLEAN",
    "table_schemas": "server STRING, schema_id INT, schema_name STRING",
    "partition_stats": "server STRING, object_id INT, index_id INT, row_count BIGINT, reserved_page_count BIGINT",
    "index_usage": "server STRING, object_id INT, index_id INT, user_seeks BIGINT, user_scans BIGINT,"
    " user_lookups BIGINT, user_updates BIGINT",
    "missing_index": "server STRING, object_id INT",
    "operational_stats": "server STRING, object_id INT, row_lock_wait_ms BIGINT, page_lock_wait_ms BIGINT,"
    " page_io_latch_wait_ms BIGINT, leaf_insert BIGINT, leaf_update BIGINT, leaf_delete BIGINT, leaf_ghost BIGINT",
    "indexes": "server STRING, object_id INT, index_id INT, index_name STRING, type INT, type_desc STRING",
    "index_columns": "server STRING, object_id INT, index_id INT, column_name STRING, key_ordinal INT,"
    " is_included BOOLEAN",
    "column_meta": "server STRING, object_id INT, column STRING, ordinal INT, data_type STRING,"
    " is_computed BOOLEAN, is_lob BOOLEAN",
    "statement_stats": "server STRING, source STRING, handle STRING, execution_count BIGINT,"
    " total_logical_reads BIGINT, total_worker_us BIGINT, total_elapsed_us BIGINT,"
    " last_execution_time TIMESTAMP, start_offset INT, end_offset INT",
    "batch_texts": "server STRING, handle STRING, text STRING",
    "query_log": "server STRING, source STRING, execution_count BIGINT, total_logical_reads BIGINT,"
    " total_cpu_ms DOUBLE, total_elapsed_ms DOUBLE, last_execution_time TIMESTAMP, statement_text STRING",
    "runtime_stats": "server STRING, plan_id BIGINT, interval_id BIGINT, count_executions BIGINT,"
    " avg_logical_io_reads DOUBLE, avg_cpu_time DOUBLE, avg_duration DOUBLE",
    "runtime_intervals": "server STRING, interval_id BIGINT, end_time TIMESTAMP",
    "query_plans": "server STRING, plan_id BIGINT, query_id BIGINT",
    "query_ids": "server STRING, query_id BIGINT, text_id BIGINT",
    "query_texts": "server STRING, text_id BIGINT, query_text STRING",
    "log_status": "server STRING, actual_state STRING, readonly_reason INT, current_mb BIGINT, max_mb BIGINT",
    "waits": "server STRING, wait_type STRING, wait_time_ms BIGINT, waiting_tasks_count BIGINT,"
    " signal_wait_time_ms BIGINT",
    "databases": "server STRING, database_name STRING, recovery_model STRING, is_auto_shrink_on BOOLEAN,"
    " is_auto_close_on BOOLEAN, is_published BOOLEAN, is_subscribed BOOLEAN, is_distributor BOOLEAN,"
    " is_cdc_enabled BOOLEAN",
    "backups": "server STRING, database_name STRING, type STRING, finish_time TIMESTAMP",
    "integrity_checks": "server STRING, database_name STRING, last_good TIMESTAMP",
    "settings": "server STRING, name STRING, value BIGINT, value_in_use BIGINT",
    "temp_files": "server STRING, name STRING, type_desc STRING, is_percent_growth BOOLEAN, cpu_count INT",
    "jobs": "server STRING, job_id STRING, name STRING, enabled BOOLEAN, owner_sid BINARY",
    "job_runs": "server STRING, job_id STRING, step_id INT, run_status INT, run_time TIMESTAMP, message STRING",
    "job_activity": "server STRING, job_id STRING, start_time TIMESTAMP, next_run_time TIMESTAMP",
    "replicas": "server STRING, ag_name STRING, replica STRING, role STRING, connected_state STRING,"
    " sync_health STRING",
    "replica_databases": "server STRING, ag_name STRING, replica STRING, database_name STRING,"
    " is_suspended BOOLEAN, sync_state STRING, log_send_queue_kb BIGINT, redo_queue_kb BIGINT, lag_seconds BIGINT",
    "replication_errors": "server STRING, distributor STRING, time TIMESTAMP, error_text STRING",
    "components": "server STRING, name STRING, modified TIMESTAMP",
    "principals": "server STRING, principal_id INT, sid BINARY, name STRING, type STRING, type_desc STRING,"
    " is_disabled BOOLEAN, create_date TIMESTAMP, default_database STRING",
    "server_role_members": "server STRING, member_principal_id INT, role_principal_id INT",
    "db_principals": "server STRING, database STRING, principal_id INT, name STRING, type STRING,"
    " type_desc STRING, sid BINARY, auth_type STRING",
    "db_role_members": "server STRING, database STRING, member_principal_id INT, role_principal_id INT",
    "db_permissions": "server STRING, database STRING, grantee_principal_id INT, class INT, class_desc STRING,"
    " major_id INT, minor_id INT, permission STRING, state STRING",
    "objects": "server STRING, database STRING, object_id INT, schema_id INT, name STRING",
    "db_schemas": "server STRING, database STRING, schema_id INT, name STRING",
    "columns": "server STRING, database STRING, object_id INT, column_id INT, name STRING",
    "linked_servers": "server STRING, name STRING, product STRING, provider STRING, data_source STRING,"
    " uses_self_credential BOOLEAN",
}

# The uniform finding row every check emits.
FINDING = (
    "source STRING, category STRING, severity STRING, severity_rank INT, title STRING, details STRING,"
    " recommendation STRING, database STRING, object STRING, raw MAP<STRING,STRING>,"
    " needs_annotation BOOLEAN, question STRING"
)
