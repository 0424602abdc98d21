import pytest
from pyspark.sql import functions as F

from quirewise.errors import UnsupportedFileType
from quirewise.operators import catalog
from quirewise.sources.routing import classify_files, split_supported

ACCOUNTS = "id string, email string, full_name string, google_id string, profile_picture string, is_active boolean, role string, updated_at timestamp"


def test_merge_applies_sign_ins_in_turn(spark):
    accounts = spark.createDataFrame(
        [
            ("1", "a@x", "", None, "old", False, "admin", None),
            ("2", "b@x", "Bea", "g0", None, True, "user", None),
            ("3", "c@x", None, None, None, True, "user", None),
        ],
        ACCOUNTS,
    )
    logins = spark.createDataFrame(
        [
            (1, "a@x", "g1", "Ann", None),
            (2, "a@x", "g2", "Anna", "new"),
            (3, "b@x", "g3", "Other", ""),
            (4, "d@x", "g4", None, None),
            (5, "d@x", "g5", "Dee", None),
        ],
        "n int, email string, google_id string, name string, profile_picture string",
    )
    out = {r["email"]: r for r in catalog.merge_accounts(accounts, logins, ["n"]).collect()}
    a = out["a@x"]
    assert (a["full_name"], a["google_id"], a["profile_picture"], a["is_active"], a["role"], a["action"]) == (
        "Ann", "g2", "new", False, "admin", "updated",
    )
    assert a["updated_at"] is not None
    assert (out["b@x"]["full_name"], out["b@x"]["google_id"], out["b@x"]["profile_picture"]) == ("Bea", "g3", None)
    assert out["c@x"]["action"] == "kept" and out["c@x"]["updated_at"] is None
    d = out["d@x"]
    assert (d["full_name"], d["google_id"], d["role"], d["is_active"], d["action"]) == ("Dee", "g5", "user", True, "inserted")
    assert len(d["id"]) == 36


def test_partial_update(spark):
    users = spark.createDataFrame(
        [(1, "Ann", True, None, "user", None), (2, "Bob", True, "p", "user", None)],
        "id int, full_name string, is_active boolean, profile_picture string, role string, updated_at timestamp",
    )
    changes = spark.createDataFrame(
        [
            (1, 1, None, False, None, "admin", False),
            (2, 1, "Anna", None, None, None, None),
            (3, 1, None, None, "q", "admin", True),
            (4, 9, "Zed", None, None, None, None),
        ],
        "n int, id int, full_name string, is_active boolean, profile_picture string, role string, admin_action boolean",
    )
    updated, rejected = catalog.partial_update(users, changes, ["n"])
    one, two = sorted(updated.collect(), key=lambda r: r["id"])
    assert (one["full_name"], one["is_active"], one["profile_picture"], one["role"]) == ("Anna", False, "q", "admin")
    assert one["updated_at"] is not None and two["updated_at"] is None and two["full_name"] == "Bob"
    assert [(r["id"], r["error"]) for r in rejected.collect()] == [(9, "User not found")]


def test_role_needs_an_admin(spark):
    users = spark.createDataFrame([(1, "user", None)], "id int, role string, updated_at timestamp")
    changes = spark.createDataFrame([(1, 1, "admin", False)], "n int, id int, role string, admin_action boolean")
    assert catalog.partial_update(users, changes, ["n"], fields=[])[0].first()["role"] == "user"


def test_owner_falls_to_first_admin_then_first_user(spark):
    files = spark.createDataFrame([("f", "2"), ("g", "x")], "filename string, directory string")
    users = spark.createDataFrame([("2", "user"), ("5", "admin"), ("4", "admin")], "id string, role string")
    owners = {r["filename"]: r["user_id"] for r in catalog.assign_owner(files, users).collect()}
    assert owners == {"f": "2", "g": "4"}
    plain = catalog.assign_owner(files, users.filter("role = 'user'"))
    assert {r["user_id"] for r in plain.collect()} == {"2"}


def test_seed_only_into_an_empty_table(spark):
    admin = spark.createDataFrame([("root",)], "id string")
    some = spark.createDataFrame([("a",)], "id string")
    assert catalog.seed_if_empty(some, admin).count() == 1
    assert catalog.seed_if_empty(some.limit(0), admin).first()["id"] == "root"


def test_routing(spark):
    names = ["a.csv", "b.XLS", "c.xlsx", "d.txt", "e", "f.zip", ".hidden"]
    files = spark.createDataFrame([(n,) for n in names], "filename string")
    out = {r["filename"]: r for r in classify_files(files).collect()}
    assert [out[n]["file_type"] for n in names] == ["csv", "xls", "xlsx", "txt", "unknown", "zip", "unknown"]
    assert [out[n]["structure_type"] for n in names] == ["csv", "excel", "excel", None, None, None, None]
    good, bad = split_supported(files)
    assert good.count() == 4 and bad.count() == 3
    with pytest.raises(UnsupportedFileType):
        split_supported(files, strict=True)
    split_supported(files.filter("filename like '%.csv'"), strict=True)


def test_iso_time_or_null(spark):
    files = spark.createDataFrame([("a", "txt", False, None, None)], "filename string, file_type string, is_structured boolean, structure_type string, created_at timestamp")
    assert catalog.file_listing(files).first()["created_at"] is None
    assert catalog.file_listing(files).columns == ["filename", "type", "is_structured", "structure_type", "created_at"]


def test_user_view_hides_secrets(spark):
    users = spark.createDataFrame([("1", "e", "n", True, "user", None, "h", "t")], "id string, email string, full_name string, is_active boolean, role string, created_at timestamp, hashed_password string, refresh_token string")
    assert not set(catalog.SECRET_COLUMNS) & set(catalog.user_view(users).columns)
    assert catalog.files_with_owner(users.select(F.col("id").alias("user_id")), users).first()["full_name"] == "n"
