"""Text renderings, widths and clamps used by reports."""

from __future__ import annotations

import math

# Bytes of a column type, of a record's header and directory entry, of an internal entry and a page header.
WIDTHS = {"int": 4, "bigint": 8, "timestamp": 8, "bool": 1}
RECORD_HEADER, SLOT_ENTRY, INTERNAL_ENTRY, PAGE_HEADER, DEFAULT_LENGTH = 5, 2, 13, 102, 32


def column_width(kind: str, length: int | None = None) -> int:
    return (length or DEFAULT_LENGTH) + 1 if kind == "varchar" else WIDTHS.get(kind, 8)


def record_bytes(columns: list[tuple[str, str, int | None]]) -> int:
    return RECORD_HEADER + SLOT_ENTRY + sum(column_width(kind, length) for _, kind, length in columns)


def clamp(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def require(condition: bool, message: str) -> None:
    """Refuses to go on where an invariant doesn't hold."""
    if not condition:
        raise AssertionError(f"invariant violated: {message}")


def format_bytes(n: float) -> str:
    """Bytes below 1 KB, KB with a decimal below ten, MB with two."""
    if n < 1024:
        return f"{n:.0f} B"
    if n < 1024**2:
        return f"{n / 1024:.{1 if n < 10240 else 0}f} KB"
    return f"{n / 1024**2:.2f} MB"


def format_percent(x: float, digits: int = 1) -> str:
    return f"{100 * x:.{digits}f}%" if math.isfinite(x) else "—"


def format_number(x: float) -> str:
    """Thousands by commas, three decimals at most."""
    return f"{x:,.3f}".rstrip("0").rstrip(".") if x % 1 else f"{x:,.0f}"


# Labels of commands; a name in braces stands for the command's argument.
LABELS = {
    "create_table": "CREATE TABLE {name}", "create_index": "CREATE INDEX {name} ON ({column})", "drop_index": "DROP INDEX {name}",
    "insert": "INSERT key={key}", "bulk_insert": "BULK INSERT ×{count} ({pattern})", "update": "UPDATE key={key}", "delete": "DELETE key={key}",
    "search": "SELECT … WHERE pk={key}", "range_scan": "SELECT … WHERE pk BETWEEN {low} AND {high}", "full_scan": "SELECT … (full index scan)",
    "flush_all": "FLUSH DIRTY PAGES", "configure": "SET {names}", "commit_txn": "COMMIT", "abort_txn": "ROLLBACK", "flush_memtable": "FLUSH MEMTABLE → L0",
}


def command_label(kind: str, **arguments: object) -> str:
    """One line for a command; kinds whose text depends on an option are composed here."""
    if kind == "begin_txn":
        level = arguments.get("isolation")
        return f"BEGIN ISOLATION LEVEL {str(level).replace('-', ' ').upper()}" if level else "BEGIN"
    if kind == "vacuum":
        return "VACUUM FULL" if arguments.get("full") else "VACUUM"
    if kind == "compact":
        level = arguments.get("level")
        return "COMPACT" if level is None else f"COMPACT L{level} → L{level + 1}"
    if kind == "query":
        columns, predicate = arguments.get("columns"), arguments.get("predicate")
        where = predicate.describe() if predicate is not None else ""
        return f"SELECT {', '.join(columns) if columns else '*'}" + (f" WHERE {where}" if where else "")
    if kind == "use_session":
        return f"\\c {arguments.get('session')}"
    if kind == "run_background":
        return f"RUN BACKGROUND JOBS ×{arguments['jobs']}" if arguments.get("jobs") else "RUN BACKGROUND JOBS"
    if kind == "crash":
        return "CRASH + RECOVER FROM WAL"
    if kind == "configure":
        return f"SET {arguments.get('names') or ', '.join(arguments)}"
    if kind == "create_table":
        schema = arguments.get("schema")
        return f"CREATE TABLE {arguments.get('name') or (schema.name if schema else 'users')}"
    return LABELS.get(kind, kind.replace("_", " ").upper()).format(**{"pattern": "sequential"} | arguments)


def describe_event(type_: str, detail: str = "", amount: int | None = None) -> str:
    """One line for an event of any type: its name in words, and what it carries."""
    words = type_.lower().replace("_", " ")
    line = words[:1].upper() + words[1:]
    for short in ("sst", "wal", "bg", "lsm", "cow"):
        line = " ".join(w.upper() if w.lower() == short else w for w in line.split(" "))
    return line + (f": {detail}" if detail else "") + (f" ({format_number(amount)})" if amount else "")
