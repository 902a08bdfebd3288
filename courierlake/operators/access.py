"""Who may do what: roles, permissions and the accounts they open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permissions that one for all accounts implies, and those that managing an account implies.
IMPLIED_BY_ALL = {
    "data:read": "data:read:all",
    "data:delete": "data:delete:all",
    "data:raw:download": "data:raw:download:all",
    "data:export:batch": "data:export:batch:all",
    "account:manage": "account:manage:all",
    "account:read:details": "account:manage:all",
}
IMPLIED_BY_MANAGE = {"data:read": "account:manage", "account:read:details": "account:manage"}


def global_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """``user_id`` and ``permission`` of what global roles give. Users have ``global_roles``, roles ``role_id`` and
    ``permissions``."""
    held = users.select("user_id", F.explode("global_roles").alias("role_id")).join(roles, "role_id")
    return held.select("user_id", F.explode("permissions").alias("permission")).distinct()


def users_with(users: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    """Users who have a permission for all accounts: administrators, or by a global role."""
    enough = [permission] + [IMPLIED_BY_ALL[permission]] * (permission in IMPLIED_BY_ALL)
    by_role = global_permissions(users, roles).where(F.col("permission").isin(enough)).select("user_id")
    return users.where("is_admin").select("user_id").union(by_role).distinct()


def account_permissions(users: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    """``user_id`` and ``account_id`` of what the role in an account gives (``account_access``: account to role)."""
    enough = [permission] + [IMPLIED_BY_MANAGE[permission]] * (permission in IMPLIED_BY_MANAGE)
    held = users.select("user_id", F.explode("account_access").alias("account_id", "role_id")).join(roles, "role_id")
    return held.where(F.arrays_overlap("permissions", F.array(*map(F.lit, enough)))).select("user_id", "account_id")


def has_permission(requests: DataFrame, users: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    """``requests`` (``user_id``, ``account_id``) with ``allowed``."""
    everywhere = users_with(users, roles, permission).withColumn("__all", F.lit(True))
    here = account_permissions(users, roles, permission).distinct().withColumn("__here", F.lit(True))
    held = requests.join(everywhere, "user_id", "left").join(here, ["user_id", "account_id"], "left")
    return held.select(*requests.columns, F.coalesce("__all", "__here", F.lit(False)).alias("allowed"))


def search_scope(user_id, users: DataFrame, roles: DataFrame, everything: str = "data:read:all") -> DataFrame | None:
    """The accounts that a user may search, as a table; None if all. The accounts of the access map count
    whatever their role allows."""
    one = users.where(F.col("user_id") == user_id)
    if one.where("is_admin").union(one.join(global_permissions(one, roles).where(F.col("permission") == everything), "user_id", "left_semi")).limit(1).count():
        return None
    return one.select(F.explode(F.map_keys("account_access")).alias("account_id"))


#: Accounts of one request at most: each is an entry in the access map of every user of that request.
MOST_GRANTED = 10_000


def grant(users: DataFrame, accounts: DataFrame, role_id, most: int = MOST_GRANTED) -> DataFrame:
    """Users with a role in each of the accounts added to their access maps; an earlier role there is replaced.
    The accounts are one row, which is broadcast: more than ``most`` are an error, as each of them becomes an entry of each user's map. Null
    accounts are left out, repeated ones count once, and without any account the users stay as they are."""
    few = accounts.select("account_id").where("account_id is not null").distinct().limit(most + 1)
    ids = F.array_sort(F.collect_list("account_id"))
    given = few.agg(F.when(F.count("*") > most, F.raise_error(F.lit(f"more than {most} accounts in one request"))).otherwise(ids).alias("__ids"))
    made = F.map_from_arrays("__ids", F.transform("__ids", lambda _: F.lit(role_id)))
    old = F.map_filter(F.coalesce("account_access", F.expr("cast(map() as map<bigint,bigint>)")), lambda k, _: ~F.array_contains("__ids", k))
    return users.crossJoin(F.broadcast(given)).withColumn("account_access", F.when(F.size("__ids") > 0, F.map_concat(old, made)).otherwise(F.col("account_access"))).drop("__ids")
