"""Syslog line grammar as column expressions.

Lines are single-line text; the character classes are ASCII, and addresses are dotted quads without a range check.
Two patterns are applied to a line, one for the header and one for all message forms: the match is rewritten into
newline-separated fields, which no field of a single line can contain, and the fields are then taken by position. Few
and short expressions matter here, as the JVM does not compile very long generated methods.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The header and message forms, in the order in which they are tried.
_IP = r"\d+\.\d+\.\d+\.\d+"
HEADER = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
FAILED = rf"Failed password for (?:invalid user )?(\S+)\s+from\s+({_IP})\s+port\s+(\d+)"
ACCEPTED = rf"Accepted (?:password|publickey) for (\S+)\s+from\s+({_IP})\s+port\s+(\d+)"
SUDO = r"(\S+)\s*:\s*TTY=\S+\s*;\s*PWD=\S+\s*;\s*USER=\S+\s*;\s*COMMAND=(.+)"
CONNECTION = rf"[cC]onnection\s+from\s+({_IP})\s+(?:on\s+)?port\s+(\d+)"
FIREWALL = rf"(?:BLOCKED|DROP|REJECT)\s+.*SRC=({_IP})\s+.*DPT=(\d+)"

_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

# All forms in one pattern. Each alternative searches the whole message before the next one is tried, so the first
# form wins wherever it stands; the look-ahead only spares lines without a terminal the search for a sudo user.
MESSAGE = f"^(?:.*?{FAILED}.*|.*?{ACCEPTED}.*|(?=.*TTY=).*?{SUDO}|.*?{CONNECTION}.*|.*?{FIREWALL}.*)$"
_GROUPS = 12


def strip(line: Column) -> Column:
    """Line without surrounding white space."""
    return F.btrim(line, F.lit(_BLANKS))


def header_fields(line: Column) -> Column:
    """``[time, host, service, pid, message]`` of a stripped line; another length if there is no header."""
    return F.split(F.regexp_replace(line, HEADER, "$1\n$2\n$3\n$4\n$5"), "\n")


def message_groups(message: Column) -> Column:
    """``['', group 1, ..., group 12]`` of :data:`MESSAGE`, empty where a group has no part; the message alone if no
    form matches."""
    return F.split(F.regexp_replace(message, MESSAGE, "".join(f"\n${i}" for i in range(1, _GROUPS + 1))), "\n")


def message_columns(groups: str, message: str) -> dict[str, str]:
    """SQL texts of ``action, user, source_ip, destination_port`` and ``message`` from :func:`message_groups` of the text
    ``message`` in column ``groups``; only one form has parts, so joining the groups of a field picks it."""

    def group(i):
        return f"try_element_at({groups}, {i + 1})"

    def field(*groups_of_field):
        return f"nullif(concat({', '.join(group(i) for i in groups_of_field)}), '')"

    return {
        "action": f"""CASE WHEN size({groups}) = 1 THEN 'OTHER' WHEN {group(1)} != '' THEN 'FAILED_LOGIN'
            WHEN {group(4)} != '' THEN 'ACCEPTED_LOGIN' WHEN {group(7)} != '' THEN 'SUDO_COMMAND'
            WHEN {group(9)} != '' THEN 'CONNECTION' ELSE 'BLOCKED' END""",
        "user": field(1, 4, 7),
        "source_ip": field(2, 5, 9, 11),
        "destination_port": f"try_cast({field(3, 6, 10, 12)} AS bigint)",
        "message": f"coalesce({field(8)}, {message})",
    }
