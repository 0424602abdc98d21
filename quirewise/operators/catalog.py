"""Ownership and account tables: assignment, merge, partial update, backfill, seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, iso_timestamp
from ..sources.routing import classify_files
from .tables import is_empty

SECRET_COLUMNS = ("hashed_password", "refresh_token", "google_id", "profile_picture")


def file_listing(files: DataFrame) -> DataFrame:
    """File records as the API shows them: renamed type, ISO time or NULL."""
    return files.select(
        "filename",
        F.col("file_type").alias("type"),
        "is_structured",
        "structure_type",
        iso_timestamp("created_at").alias("created_at"),
    )


def user_view(users: DataFrame) -> DataFrame:
    return users.select("id", "email", "full_name", "is_active", "role", "created_at")


def files_with_owner(files: DataFrame, users: DataFrame) -> DataFrame:
    owners = users.select(F.col("id").alias("user_id"), "full_name")
    return files.join(owners, "user_id")


def assign_owner(files: DataFrame, users: DataFrame, directory: str = "directory") -> DataFrame:
    """The directory names the owner; an unknown one falls to the first admin, else the first user.

    The fallback is a scalar subquery, so no join is spent on it.
    """
    fallback = users.agg(F.coalesce(F.min(F.when(F.col("role") == "admin", F.col("id"))), F.min("id"))).scalar()
    known = users.select(F.col("id").alias("_owner"))
    return (
        files.join(known, F.col(directory) == F.col("_owner"), "left")
        .withColumn("user_id", F.coalesce(F.col("_owner"), fallback))
        .drop("_owner")
    )


def uncataloged_files(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    return listing.join(catalog.select("filename", "user_id"), ["filename", "user_id"], "left_anti")


def catalog_backfill(listing: DataFrame, users: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows for every listed file that has none: owner, type, structure."""
    owned = assign_owner(listing, users)
    return classify_files(uncataloged_files(owned, catalog)).select(
        "filename", "file_type", "is_structured", "structure_type", "user_id"
    )


def merge_accounts(accounts: DataFrame, logins: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Upsert sign-ins into accounts, matched on email.

    A match overwrites ``google_id``, fills an empty ``full_name``, takes a given picture and
    stamps ``updated_at``; no match inserts an active user. Several sign-ins of one email act
    as if applied in turn: last id, first given name, last given picture. That fold is an
    aggregate with map-side combine, so both sides of the full outer join are unique on email.
    """
    turn = F.struct(*order_by)
    name, picture = filled("name"), filled("profile_picture")
    n = logins.groupBy(F.col("email").alias("n_email")).agg(
        F.max_by("google_id", turn).alias("n_google_id"),
        F.min_by(name, F.when(name.isNotNull(), turn)).alias("n_name"),
        F.max_by(picture, F.when(picture.isNotNull(), turn)).alias("n_picture"),
    )
    old, new = F.col("id").isNotNull(), F.col("n_email").isNotNull()
    return accounts.join(n, F.col("email") == F.col("n_email"), "full_outer").select(
        F.coalesce("id", F.expr("uuid()")).alias("id"),
        F.coalesce("email", "n_email").alias("email"),
        F.when(new, F.col("n_google_id")).otherwise(F.col("google_id")).alias("google_id"),
        F.coalesce(filled("full_name"), F.col("n_name"), F.col("full_name")).alias("full_name"),
        F.coalesce("n_picture", "profile_picture").alias("profile_picture"),
        F.when(old, F.col("is_active")).otherwise(F.lit(True)).alias("is_active"),
        F.when(old, F.col("role")).otherwise(F.lit("user")).alias("role"),
        F.when(old & ~new, F.col("updated_at")).otherwise(F.current_timestamp()).alias("updated_at"),
        F.when(~old, F.lit("inserted")).when(new, F.lit("updated")).otherwise(F.lit("kept")).alias("action"),
    )


def partial_update(
    users: DataFrame,
    changes: DataFrame,
    order_by: Sequence[str],
    fields: Sequence[str] = ("full_name", "is_active", "profile_picture"),
) -> tuple[DataFrame, DataFrame]:
    """``(users, rejected changes)``: only given fields change, ``role`` only by an admin.

    ``changes`` holds ``id, <fields>, role, admin_action`` and any number of rows per id,
    applied in ``order_by`` order: per field the last given value wins.
    """
    turn = F.struct(*order_by)

    def last_given(value):
        return F.max_by(value, F.when(value.isNotNull(), turn))

    role = F.when(F.coalesce("admin_action", F.lit(False)), F.col("role"))
    news = changes.groupBy("id").agg(
        *[last_given(F.col(f)).alias(f"_new_{f}") for f in fields], last_given(role).alias("_new_role")
    )
    values = {f: F.coalesce(f"_new_{f}", f) for f in (*fields, "role")}
    updated = (
        users.join(news.withColumn("_hit", F.lit(True)), "id", "left")
        .withColumns(values)
        .withColumn("updated_at", F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col("updated_at")))
        .select(*users.columns)
    )
    rejected = changes.join(users.select("id"), "id", "left_anti").withColumn("error", F.lit("User not found"))
    return updated, rejected


def seed_if_empty(users: DataFrame, admin: DataFrame) -> DataFrame:
    """Add the seed row only to an empty table."""
    return users.unionByName(admin) if is_empty(users) else users
