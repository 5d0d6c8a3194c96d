"""Read-only rule for SQL text: one SELECT, WITH or EXPLAIN, nothing that writes, runs code or opens paths."""

from __future__ import annotations

import re


# The texts of this module's errors are part of the tool's contract.
class ReadOnlySqlError(ValueError):
    """A statement that is not provably read-only; the message says which rule it breaks."""


# The leading words that are allowed, and words that no statement may hold.
LEADING = ("SELECT", "WITH", "EXPLAIN")
FORBIDDEN = "INSERT UPDATE DELETE REPLACE DROP ALTER CREATE TRUNCATE PRAGMA ATTACH DETACH VACUUM REINDEX ANALYZE BEGIN COMMIT ROLLBACK SAVEPOINT".split()
# What begins like a query on Spark and still runs code or changes the session.
SPARK_FORBIDDEN = "MERGE REFRESH CACHE UNCACHE MSCK LOAD ADD SET RESET USE GRANT REVOKE EXECUTE".split()
CODE_CALLS = ("reflect", "java_method", "try_reflect")

_TOKEN = re.compile(
    r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"[^"]*"|`[^`]*`|\[[^\]]*\]|['"`\[].*\Z|/\*.*\Z|[A-Za-z_][A-Za-z_0-9]*|\s+|.""",
    re.S,
)


def blanked(sql: str) -> str:
    """The text with comments, strings and quoted names as blanks; an unclosed one swallows the rest."""
    out = []
    for m in _TOKEN.finditer(sql):
        t = m.group()
        # an index into an array is no quoted name
        index = t.startswith("[") and re.fullmatch(r"\[\s*\d*\s*\]", t)
        out.append(" " if not index and (t[:2] in ("--", "/*") or t[0] in "'\"`[") else t)
    return "".join(out)


def assert_read_only(sql: str) -> None:
    """Raises ReadOnlySqlError unless ``sql`` is one statement that only reads."""
    text = blanked(sql).strip()
    leading = re.match(r"[A-Za-z_]*", text).group().upper()
    if leading not in LEADING:
        raise ReadOnlySqlError("Read-only access: statements must begin with SELECT, WITH, or EXPLAIN.")
    words = re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)
    for w in words:
        if w.upper() in FORBIDDEN:
            raise ReadOnlySqlError(f"Read-only access: {w.upper()} statements are not permitted.")
    if re.search(r";\s*\S", text):
        raise ReadOnlySqlError("Read-only access: only one statement is permitted.")
    for name in CODE_CALLS:
        if re.search(rf"\b{name}\s*\(", text, re.I) or re.search(rf"[`\"]{name}[`\"]\s*\(", sql, re.I):
            raise ReadOnlySqlError(f"Read-only access: {name} calls are not permitted.")
    if re.search(r"\bTRANSFORM\s*\(.*\bUSING\b|\bMAP\s+.*\bUSING\b|\bREDUCE\s+.*\bUSING\b", text, re.I | re.S):
        raise ReadOnlySqlError("Read-only access: TRANSFORM ... USING is not permitted.")
    after = re.match(r"EXPLAIN\s+(?:QUERY\s+PLAN\s+|EXTENDED\s+|CODEGEN\s+|COST\s+|FORMATTED\s+)?([A-Za-z_]+)", text, re.I)
    if leading == "EXPLAIN" and (not after or after.group(1).upper() not in ("SELECT", "WITH")):
        raise ReadOnlySqlError("Read-only access: only queries can be explained.")
    for w in SPARK_FORBIDDEN:
        if re.match(rf"EXPLAIN\s+{w}\b", text, re.I) or re.search(rf"\)\s*{w}\b", text, re.I):
            raise ReadOnlySqlError(f"Read-only access: {w} statements are not permitted.")
    if re.search(r"(?:\b(?:FROM|JOIN)|,)\s*(?:parquet|orc|json|csv|text|avro|binaryfile|delta)\s*\.", text, re.I):
        raise ReadOnlySqlError("Read-only access: tables by path are not permitted.")
