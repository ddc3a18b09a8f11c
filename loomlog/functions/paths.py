"""Identifiers inside paths, payloads and command strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def session_id_from_path(path: Column) -> Column:
    """File name without its .jsonl suffix."""
    return F.regexp_replace(base_name(path), r"\.jsonl$", "")


def uuid_from_path(path: Column) -> Column:
    """UUID directly before the .jsonl suffix."""
    return J.non_empty(F.regexp_extract(path, rf"({UUID})\.jsonl$", 1))


def flat_session_id(path: Column, meta_id: Column) -> Column:
    """UUID suffix of a rollout file, else the id of its session_meta row."""
    return F.coalesce(uuid_from_path(path), meta_id, session_id_from_path(path))


def find_session_id(payload: Column) -> Column:
    """Known keys first, then the first nested string ending in ``<uuid>.jsonl``."""
    keys = (
        "$.session_id", "$.sessionId", "$.conversation_id", "$.conversationId",
        "$.session.id", "$.session.sessionId", "$.session.session_id",
    )

    def usable(text: Column) -> Column:
        return F.coalesce(F.when(text.rlike(f"^{UUID}$"), text), uuid_from_path(text))

    known = F.coalesce(*[usable(J.as_id(payload, k)) for k in keys])
    nested = J.non_empty(F.regexp_extract(F.to_json(payload), rf'({UUID})\.jsonl"(?!\s*:)', 1))
    return F.when(J.is_object(payload), F.coalesce(known, nested))


def first_nonblank(payload: Column, keys: list[str]) -> Column:
    """First non-blank string under the keys, on the object, then on its ``payload`` child."""
    found = [J.as_string(payload, f"$.{prefix}{key}") for prefix in ("", "payload.") for key in keys]
    return F.coalesce(*[F.when(~J.blank(c), c) for c in found])


def fork_file_name(name: Column, old_id: Column, new_id: Column) -> Column:
    """P20: swap the id at the end of a rollout file name, else a default name."""
    suffix = F.lit(".jsonl")
    ends = name.endswith(F.concat(old_id, suffix))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(old_id) - 6)
    return F.when(ends & (F.length(old_id) > 0), F.concat(stem, new_id, suffix)).otherwise(
        F.concat(F.lit("rollout-fork-"), new_id, suffix)
    )


def flag_from_command(command: Column, flag: str) -> Column:
    """``--flag=value`` or ``--flag value`` of a command string."""
    name = re.escape(flag)
    joined = F.regexp_extract(command, rf"(?:^|\s)--{name}=(\S+)", 1)
    spaced = F.regexp_extract(command, rf"(?:^|\s)--{name}\s+(\S+)", 1)
    return F.coalesce(J.non_empty(joined), J.non_empty(spaced))


def agreed(value: Column) -> Column:
    """P21 aggregate: the single distinct non-blank value of a group, else NULL."""
    usable = F.when(~J.blank(value), value)
    return F.when(F.min(usable) == F.max(usable), F.max(usable))


def legacy_cwd(text: Column) -> Column:
    """P19 scalar: the <cwd> tag of a text that carries an environment block."""
    tag = F.regexp_extract(text, r"<cwd>([^<]+)</cwd>", 1)
    return F.when(F.contains(text, F.lit("<environment_context>")), J.non_empty(tag))


def project_dir_names(cwd: str) -> list[str]:
    """Directory names of a working directory, current form first."""
    dashed = cwd.replace("/", "-")
    return [dashed.replace(".", "-"), dashed]
