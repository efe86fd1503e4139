"""Names, limits and labels the results depend on."""

# Severity levels, least urgent first (rank = position).
SEVERITIES = ["Info", "Low", "Medium", "High", "Critical"]

# Discovery, sampling and reporting limits.
MIN_ROWS = 1_000_000
MIN_MB = 500
TOP_TABLES = 25
SAMPLE_TARGET_ROWS = 1_000_000
SAMPLE_SEED = 424242
COLUMN_BATCH = 20
STATEMENTS_PER_TABLE = 20
ROWGROUP_ROWS = 1_048_576
MAX_SERVER_MEMORY_UNSET = 2_147_483_647
REDO_QUEUE_WARNING_KB = 1_048_576

# Reasons why a statement log has silently stopped capturing
# (storage limit reached, too many distinct statements, disk full).
STALE_LOG_REASON_BITS = 65536 | 131072 | 524288

# Column verdict labels.
COLUMN_VERDICTS = {
    "excellent": "EXCELLENT - highly repetitive, compresses extremely well",
    "good": "GOOD - solid run-length/dictionary compression expected",
    "bad": "BAD - high-cardinality wide string, dictionary pressure risk",
    "poor": "POOR - nearly unique values, little compression benefit",
    "neutral": "NEUTRAL",
}

# Why a column is not measured.
SKIP_COMPUTED = "skipped: computed column"
SKIP_LOB = "skipped: LOB/unsupported type (also a columnstore concern in itself)"

# Table verdict labels.
TABLE_VERDICTS = {
    "columnar": "already columnstore",
    "strong": "STRONG COLUMNSTORE CANDIDATE",
    "genuine": "GENUINE COLUMNSTORE CANDIDATE (workload evidence supports it)",
    "promising": "PROMISING CANDIDATE — test it",
    "compression": "MARGINAL — compression win possible, low priority",
    "marginal": "MARGINAL",
    "small": "NOT A CANDIDATE (too small / wrong shape)",
    "no": "NOT A COLUMNSTORE CANDIDATE",
}

# Index notes.
INDEX_NOTE_DROP = "DROP CANDIDATE: written to, never read (since last restart)"
INDEX_NOTE_WIDE = "WIDE: 5+ included columns - likely replaceable by columnstore"

# Wait types that only mean idling or background work.
IDLE_WAITS = """
SLEEP_TASK BROKER_TASK_STOP BROKER_TO_FLUSH BROKER_EVENTHANDLER LAZYWRITER_SLEEP
CHECKPOINT_QUEUE REQUEST_FOR_DEADLOCK_SEARCH XE_TIMER_EVENT XE_DISPATCHER_WAIT
XE_DISPATCHER_JOIN LOGMGR_QUEUE CLR_AUTO_EVENT CLR_MANUAL_EVENT CLR_SEMAPHORE
SQLTRACE_BUFFER_FLUSH WAITFOR DIRTY_PAGE_POLL HADR_FILESTREAM_IOMGR_IOCOMPLETION
RESOURCE_QUEUE ONDEMAND_TASK_QUEUE SLEEP_SYSTEMTASK SLEEP_BPOOL_FLUSH
DISPATCHER_QUEUE_SEMAPHORE FT_IFTS_SCHEDULER_IDLE_WAIT SP_SERVER_DIAGNOSTICS_SLEEP
QDS_PERSIST_TASK_MAIN_LOOP_SLEEP DBMIRROR_EVENTS_QUEUE DBMIRROR_WORKER_QUEUE
DBMIRRORING_CMD BROKER_RECEIVE_WAITFOR PWAIT_ALL_COMPONENTS_INITIALIZED
SQLTRACE_INCREMENTAL_FLUSH_SLEEP SQLTRACE_WAIT_ENTRIES WAIT_FOR_RESULTS
WAIT_XTP_RECOVERY BROKER_TRANSMITTER WAIT_XTP_HOST_WAIT WAIT_XTP_CKPT_CLOSE
XE_LIVE_TARGET_TVF
""".split()

# Job run status codes.
RUN_STATUS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled"}

# Job-name prefixes of the expected maintenance jobs.
MAINTENANCE_PREFIXES = ["DatabaseBackup - ", "DatabaseIntegrityCheck - ", "IndexOptimize - "]

# Diagnostic components looked for, and where each is published.
_FIRST_RESPONDER_KIT = "https://github.com/BrentOzarULTD/SQL-Server-First-Responder-Kit"
COMPONENTS = {
    "sp_Blitz": _FIRST_RESPONDER_KIT,
    "sp_BlitzIndex": _FIRST_RESPONDER_KIT,
    "sp_BlitzCache": _FIRST_RESPONDER_KIT,
    "sp_BlitzFirst": _FIRST_RESPONDER_KIT,
    "sp_BlitzLock": _FIRST_RESPONDER_KIT,
    "sp_BlitzBackups": _FIRST_RESPONDER_KIT,
    "sp_WhoIsActive": "https://github.com/amachanic/sp_whoisactive",
}

# Permissions that are risky when granted.
RISKY_PERMISSIONS = ["CONTROL", "ALTER", "TAKE OWNERSHIP"]

# Principal types that can log in (SQL, Windows user, Windows group).
LOGIN_TYPES = ["S", "U", "G"]

# Candidate column names per finding role, in order of preference.
FINDING_ROLES = {
    "priority": ["Priority"],
    "category": ["FindingsGroup", "Category"],
    "title": ["Finding", "CheckName"],
    "details": ["Details", "Detail"],
    "recommendation": ["URL", "HowToStopThisWarning"],
    "database": ["DatabaseName", "Database"],
}

# Assessment notes (printf templates), in rule order.
NOTES = {
    "columnar": "Already has a columnstore index",
    "low": "%s%% of columns are highly repetitive (<=1%% distinct) - excellent compression expected",
    "medium": "%s%% of columns are repetitive (<=10%% distinct) - good compression expected",
    "unique": "Data is mostly high-cardinality - compression benefit will be modest",
    "small": "CAUTION: only ~%s potential rowgroups (%s rows) - likely too small to benefit",
    "scans": "scan-heavy access pattern",
    "bloat": "NC indexes (%s MB) outweigh base data (%s MB) - big reclaim potential",
    "write_heavy": "CAUTION: write-heavy - consider nonclustered columnstore instead of clustered",
    "writes": "write activity is significant - test delta-store behavior",
    "update_heavy": "CAUTION: UPDATE-dominated writes fragment columnstore quickly",
    "updates": "noticeable UPDATE share - plan for index maintenance",
    "pressure": "CAUTION: %s high-cardinality wide string column(s) risk dictionary pressure / trimmed rowgroups",
    "lob": "%s LOB/unsupported column(s) present - verify columnstore compatibility on your version",
    "replicated": "NOTE: table is replicated",
    "tracked": "NOTE: table is CDC-tracked",
    "latches": "high PAGEIOLATCH waits - IO-bound scans; columnstore compression usually helps here",
}
