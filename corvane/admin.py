"""Users, their authorisations and permissions, and the command line."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.functions.hashing import hashed
from corvane.functions.security import label

TABLE_PERMISSIONS = ("READ", "WRITE", "BULK_IMPORT", "ALTER_TABLE", "GRANT", "DROP_TABLE")
SYSTEM_PERMISSIONS = ("GRANT", "CREATE_TABLE", "DROP_TABLE", "ALTER_TABLE", "CREATE_USER", "DROP_USER", "ALTER_USER", "SYSTEM", "CREATE_NAMESPACE", "DROP_NAMESPACE", "ALTER_NAMESPACE", "OBTAIN_DELEGATION_TOKEN")
STORES = {"blobstore": ("blobs",), "termstore": ("postings", "counts", "hashes"), "cache": ("cache",)}
#: Rows between which an ingest with --split has files of its own.
SPLITS = [*"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]


class Registry:
    """Users in one JSON file, replaced as a whole on each change."""

    def __init__(self, path: str):
        self.path = path

    def _load(self) -> dict:
        if not os.path.exists(self.path):
            return {}
        with open(self.path) as f:
            return json.load(f)

    def _save(self, users: dict) -> None:
        with open(self.path + ".new", "w") as f:
            json.dump(users, f, sort_keys=True)
        os.replace(self.path + ".new", self.path)

    def _user(self, users: dict, name: str) -> dict:
        if name not in users:
            raise KeyError(f"no user {name}")
        return users[name]

    def all(self) -> list[str]:
        return sorted(self._load())

    def exists(self, name: str) -> bool:
        return name in self._load()

    def create(self, name: str) -> None:
        users = self._load()
        users.setdefault(name, {"auths": [], "tables": {}, "system": []})
        self._save(users)

    def delete(self, name: str) -> None:
        users = self._load()
        users.pop(name, None)
        self._save(users)

    def auths(self, name: str) -> set[str]:
        return set(self._user(self._load(), name)["auths"])

    def set_auths(self, name: str, auths: str | set[str]) -> None:
        """A set, or labels with commas between them."""
        users = self._load()
        own = {a.strip() for a in auths.split(",") if a.strip()} if isinstance(auths, str) else set(auths)
        self._user(users, name)["auths"] = sorted(own)
        self._save(users)

    def _change(self, name: str, table: str | None, permission: str, give: bool) -> None:
        if permission not in (SYSTEM_PERMISSIONS if table is None else TABLE_PERMISSIONS):
            raise ValueError(f"unknown permission {permission}")
        users = self._load()
        user = self._user(users, name)
        own = set(user["system"] if table is None else user["tables"].get(table, ()))
        own = own | {permission} if give else own - {permission}
        if table is None:
            user["system"] = sorted(own)
        else:
            user["tables"][table] = sorted(own)
        self._save(users)

    def grant(self, name: str, permission: str, table: str | None = None) -> None:
        self._change(name, table, permission, True)

    def revoke(self, name: str, permission: str, table: str | None = None) -> None:
        self._change(name, table, permission, False)

    def has(self, name: str | None, permission: str, table: str | None = None) -> bool:
        """False for a user that there is none of."""
        user = self._load().get(name)
        if user is None:
            return False
        return permission in (user["system"] if table is None else user["tables"].get(table, ()))

    def revoke_all(self, name: str) -> None:
        users = self._load()
        self._user(users, name).update(tables={}, system=[])
        self._save(users)

    def users_with(self, permission: str, table: str | None = None) -> list[str]:
        return [n for n in self.all() if self.has(n, permission, table)]


def actions() -> list[str]:
    grants = [f"{s}_{x}" for s in STORES for x in ("grant_alter_permission", "revoke_alter_permission", "grant_read_permission", "grant_write_permission")]
    return ["create_user", *grants, "create", "destroy", "truncate", "remove", "compact", "ingest", "ingest_many", "reindex", "backup", "backup_many"]


@dataclass
class Configuration:
    """Where a store is and who uses it; the session is made when it is asked for."""

    path: str
    user: str | None = None
    registry: str | None = None
    app: str = "corvane"

    @cached_property
    def spark(self) -> SparkSession:
        return SparkSession.builder.appName(self.app).getOrCreate()

    def store(self):
        from corvane.operators.stores import DataStore

        return DataStore(self.spark, self.path, Registry(self.registry) if self.registry else None, self.user)


def _pairs(datasets: str | None, paths: str | None) -> list[tuple[str, str]]:
    """Datasets with their files, one for each."""
    names, files = (x.split(",") if x else [] for x in (datasets, paths))
    if not names or len(names) != len(files):
        raise ValueError(f"{len(names)} datasets and {len(files)} files: one file is needed for each dataset")
    return list(zip(names, files))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one action. With --user, the permissions that the registry has for the user are checked, but for actions on
    the registry itself."""
    from corvane.operators.stores import DataStore
    from corvane.sources import files

    parser = argparse.ArgumentParser("corvane")
    parser.add_argument("action", choices=actions())
    parser.add_argument("--store", required=True, help="folder of the store")
    for name in ("user", "dataset", "file", "id-field", "auths", "registry"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--split", action="store_true", help="ingest: files of their own between single letters and digits")
    parser.add_argument("--hash", action="store_true", help="ingest: ids are hashes of what the id field has")
    a = parser.parse_args(argv)
    registry = Registry(a.registry or f"{a.store}/users.json")
    if a.action == "create_user":
        os.makedirs(os.path.dirname(registry.path), exist_ok=True)
        registry.create(a.user)
        return 0
    if a.action.endswith("_permission"):
        store, verb, permission, _ = a.action.split("_")
        for table in STORES[store]:
            change = registry.grant if verb == "grant" else registry.revoke
            change(a.user, {"alter": "ALTER_TABLE", "read": "READ", "write": "WRITE"}[permission], table)
        return 0
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    store = DataStore(spark, a.store, registry if a.user else None, a.user)
    if a.action == "create":
        store.create()
    elif a.action == "destroy":
        store.destroy()
    elif a.action == "truncate":
        store.truncate()
    elif a.action == "remove":
        store.remove(a.dataset)
    elif a.action == "compact":
        store.compact()
    elif a.action in ("ingest", "ingest_many"):
        for dataset, path in _pairs(a.dataset, a.file):
            if a.split:
                for table in ("blobs", "postings", "counts"):
                    store.tables.split(table, SPLITS)
            docs = files.json_lines(spark, path, dataset, a.id_field or "id")
            store.persist(docs.withColumn("doc_id", hashed(F.col("doc_id"))) if a.hash else docs)
    elif a.action == "reindex":
        store.reindex(a.dataset)
    else:
        # a backup has the documents as they are, for which READ on the blobs is enough
        for dataset, path in _pairs(a.dataset, a.file):
            files.backup(store.jsons({f"{label(dataset)}_RAW_DATA"}, dataset), path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
