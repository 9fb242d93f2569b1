"""Event types, their fields, and the schema of telemetry tables.

Tables are flat. ``processes``: proc (identity), pid, ppid, start, exited_at, name, exe, cmdline, user. ``events``:
event_id (arrival order), ts, type, proc, and the columns of the fields below. An empty or null text is missing.
"""

from __future__ import annotations

# The event types, and which fields of which kind each has.
EVENT_TYPES = ("PROCESS_START", "PROCESS_EXIT", "PROCESS_EXEC", "PROCESS_SNAPSHOT", "NETWORK_CONNECT", "NETWORK_CLOSE", "FILE_CREATE", "FILE_MODIFY", "FILE_DELETE", "FILE_RENAME", "PERSISTENCE_CHANGE", "DNS_QUERY", "SCRIPT_EXECUTION")
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
STATUSES = ("new", "acknowledged", "dismissed")
PROCESS = {"name": "string", "exe": "path", "cmdline": "string", "user": "string"}
NETWORK = {"remote_addr": "address", "remote_port": "number", "local_port": "number", "protocol": "string", "state": "string", "direction": "string", "result": "string", "bytes_sent": "number", "bytes_received": "number", "duration_ms": "number"}
DNS = {"domain": "string", "query_type": "string", "resolver": "address"}
FILE = {"path": "path", "old_path": "path"}
BY_TYPE = {
    **dict.fromkeys(("PROCESS_START", "PROCESS_EXIT", "PROCESS_EXEC"), PROCESS),
    **dict.fromkeys(("NETWORK_CONNECT", "NETWORK_CLOSE"), NETWORK),
    **dict.fromkeys(("FILE_CREATE", "FILE_MODIFY", "FILE_DELETE", "FILE_RENAME"), FILE),
    "DNS_QUERY": DNS,
}


def fields_of(event_type: str) -> dict[str, str]:
    """Field kinds of an event type; some types have none."""
    return BY_TYPE.get(event_type, {})
