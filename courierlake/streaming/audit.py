"""Events of the application as rows of the audit log: a table tells for each kind where its columns come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """How a kind of event becomes an entry: its action, the properties that name the actor and the target, and the detail (a property, or a
    pattern with properties in braces). ``success`` names a property, or a property and the value that it must have; none is success."""

    action: str
    actor: str
    target: str | None = None
    ip: bool = False
    detail: str | None = None
    success: str | None = None


#: The kinds of events and their entries.
KINDS = {
    "UserLoggedIn": Kind("user.login", "user", ip=True, success="success"),
    "MfaLogin": Kind("user.login", "user", ip=True, detail="{method|mfa}", success="success"),
    "MfaEnabled": Kind("mfa.enabled", "user", ip=True, success="success"),
    "MfaDisabled": Kind("mfa.disabled", "user", ip=True, success="success"),
    "MfaReset": Kind("mfa.reset", "reset_by", "target_user", ip=True),
    "UserCreated": Kind("user.created", "created_by", "new_user"),
    "UserUpdated": Kind("user.updated", "updated_by", "target_user"),
    "UserRemoved": Kind("user.removed", "removed_by", "target_user"),
    "RoleCreated": Kind("role.created", "created_by", "role_name"),
    "RoleUpdated": Kind("role.updated", "updated_by", "role_name"),
    "RoleRemoved": Kind("role.removed", "removed_by", "role_name"),
    "EmailViewed": Kind("email.viewed", "user", "email_id", ip=True),
    "EmailDeleted": Kind("email.deleted", "user", "email_id"),
    "EmailRepaired": Kind("email.repaired", "user", "email_id", detail="{status}", success="status=repaired"),
    "RetentionPurged": Kind("email.retention_purged", "=system", "account", detail="deleted={deleted} window_days={window_days}", success="success"),
    "AttachmentDownloaded": Kind("attachment.downloaded", "user", "email_id", detail="{content_hash}"),
    "SearchPerformed": Kind("search.performed", "user", detail="{query}"),
    "SettingsChanged": Kind("settings.changed", "user", detail="{key}"),
    "BackupCreated": Kind("backup.created", "user"),
    "BackupRestoreStaged": Kind("backup.restore_staged", "user"),
}


def _filled(pattern: str, prop) -> Column:
    """A pattern's text with properties in place of ``{name}`` or ``{name|otherwise}``."""
    out: list[Column] = []
    for i, part in enumerate(pattern.replace("}", "{").split("{")):
        if i % 2:
            name, _, otherwise = part.partition("|")
            out.append(F.coalesce(prop(name), F.lit(otherwise)) if otherwise else prop(name))
        elif part:
            out.append(F.lit(part))
    return out[0] if len(out) == 1 else F.concat(*out)


def entries(events: DataFrame, kind: str = "kind", props: str = "props", ts: str = "ts_ms", key: str = "event_id") -> DataFrame:
    """``key``, ``ts_ms``, ``actor``, ``action``, ``target``, ``ip``, ``detail`` and ``success`` of events with JSON properties.

    Kinds that aren't in ``KINDS`` have no entry. Properties that are missing, or JSON that is damaged, give nulls, and a missing ``success`` a failure.
    The key is the time and the event's number in fixed widths, so keys sort by time. Repeated events give equal entries; an
    empty table gives an empty one.
    """
    held = events.withColumn("__p", F.from_json(props, "map<string,string>"))
    prop = lambda name: F.lit(name[1:]) if name.startswith("=") else F.try_element_at("__p", F.lit(name))

    def by_kind(of, otherwise=None) -> Column:
        out = F.lit(otherwise)
        for name, k in KINDS.items():
            if (value := of(k)) is not None:
                out = F.when(F.col(kind) == name, value).otherwise(out)
        return out

    def success(k: Kind) -> Column | None:
        name, _, value = (k.success or "").partition("=")
        return F.coalesce(prop(name) == (value or "true"), F.lit(False)) if name else None

    columns = {
        "actor": by_kind(lambda k: prop(k.actor)), "action": by_kind(lambda k: F.lit(k.action)), "target": by_kind(lambda k: prop(k.target) if k.target else None),
        "ip": by_kind(lambda k: prop("ip") if k.ip else None), "detail": by_kind(lambda k: _filled(k.detail, prop) if k.detail else None), "success": by_kind(success, True),
    }
    row = F.concat(F.lpad(F.col(ts).cast("string"), 13, "0"), F.lit("-"), F.lpad(F.col(key).cast("string"), 12, "0"))
    return held.where(F.col(kind).isin(*KINDS)).select(row.alias("key"), F.col(ts).alias("ts_ms"), *(c.alias(name) for name, c in columns.items()))
