"""Users, sessions, access.

Defined results: a null key, host, user or name matches nothing, and neither do digits of more than 64 bits;
of added users without a name one stays; a session of a user who is gone has a
null username; repeated requests are answered each; empty tables give empty results; columns that an
operator does not name are carried along where it returns the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.functions import scalars as S
from pagetrail.operators.intervals import inside

TTL = 86_400
PRIVATE = ("secret", "invite_secret", "invite_counter", "id", "parent_id")


def public_users(users: DataFrame) -> DataFrame:
    return users.select("id", "parent_id", "username", "creation_datetime")


def redact(users: DataFrame) -> DataFrame:
    return users.drop(*PRIVATE)


def lookup(df: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose column is among keys(key)."""
    return df.join(keys.select(F.col("key").alias("__key")).distinct(), F.col(col) == F.col("__key"), "left_semi")


def resolve_users(idents: DataFrame, users: DataFrame) -> DataFrame:
    """idents(ident) with their user: digits are an id, anything else a username; two hash joins, not one with OR."""
    by_id = idents.filter(S.all_digits(F.col("ident"))).join(users, F.col("ident").try_cast("long") == users["id"])
    return by_id.unionByName(idents.filter(~S.all_digits(F.col("ident"))).join(users, F.col("ident") == users["username"]))


def valid_names(users: DataFrame) -> DataFrame:
    return users.withColumn("valid", F.col("username").rlike("^[a-zA-Z0-9]+$"))


def unexpired(sessions: DataFrame, as_of) -> DataFrame:
    return sessions.filter(F.col("expires_at_datetime") > as_of)


def on_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows of allowed hosts; the list is the local host and its peers, a configuration."""
    return rows.join(F.broadcast(hosts), "host", "left_semi")


def resolve_sessions(requests: DataFrame, sessions: DataFrame, users: DataFrame, hosts: DataFrame, as_of) -> DataFrame:
    """request_id, host, session_user, username of every request; null where key, host, validity or user fail."""
    asked = requests.select("request_id", S.session_parts(F.col("session_key")).alias("s")).select("request_id", "s.key", "s.host")
    live = on_hosts(unexpired(sessions, as_of), hosts).select("key", "host", F.col("user_id").alias("session_user"))
    known = users.select(F.col("id").alias("session_user"), "username")
    return asked.join(live, ["key", "host"], "left").join(known, "session_user", "left").select("request_id", "host", "session_user", "username")


def valid_at_request(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests inside some session of their user; user and time bin are the equi key (`operators.intervals`)."""
    return inside(requests, sessions, "user_id", "ts", "user_id", "creation_datetime", "expires_at_datetime")


def classify_access(resolved: DataFrame, local_host: str, allow_foreign: bool = True, admin_only: bool = False) -> DataFrame:
    """resolved with `access`: missing_user, foreign, not_admin or ok, the first that holds."""
    access = F.when(F.col("username").isNull(), "missing_user")
    if not allow_foreign:
        access = access.when(F.col("host") != local_host, "foreign")
    if admin_only:
        access = access.when(F.col("username") != "admin", "not_admin")
    return resolved.withColumn("access", access.otherwise("ok"))


def bump_counters(users: DataFrame, uses: DataFrame) -> DataFrame:
    """users with invite_counter raised by the rows of uses(id); null counts as 0."""
    n = uses.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    return users.join(n, "id", "left").withColumn("invite_counter", F.coalesce("invite_counter", F.lit(0)).cast("long") + F.coalesce("__n", F.lit(0))).drop("__n")


def add_sessions(sessions: DataFrame, new: DataFrame, ttl: int = TTL) -> DataFrame:
    """sessions and those of new(key, host, user_id, creation_datetime), which last ttl seconds."""
    return sessions.unionByName(new.withColumn("expires_at_datetime", F.col("creation_datetime") + ttl).select(*sessions.columns))


def add_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """users and those of new, with no invite used; a username that exists, or comes again with a larger id, adds nothing."""
    first = new.groupBy("username").agg(F.min_by(F.struct(*[new[c] for c in new.columns]), F.struct(F.col("id").isNull(), F.col("id"))).alias("row")).select("row.*")
    fresh = first.join(users.select(F.col("username").alias("__name")), F.col("username").eqNullSafe(F.col("__name")), "left_anti").withColumn("invite_counter", F.lit(0))
    return users.unionByName(fresh.select(*[F.col(c).cast(users.schema[c].dataType) for c in users.columns]))
