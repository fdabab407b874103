"""Users, roles and privileges on tables and paths: a deny anywhere wins, no grant means no."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import secrets
import uuid

PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "ALL")


class AccessError(PermissionError):
    pass


class Authority:
    """Kept in a JSON file beside the catalog; passwords as salted scrypt digests."""

    def __init__(self, file: str):
        self.file = file
        self.state: dict = {"users": {}, "roles": {}}
        if os.path.exists(file):
            with open(file) as f:
                self.state = json.load(f)

    def _save(self) -> None:
        temp = f"{self.file}.{uuid.uuid4().hex}"
        with open(temp, "w") as f:
            json.dump(self.state, f, indent=1, sort_keys=True)
        os.replace(temp, self.file)

    def create_user(self, name: str, password: str | None = None, admin: bool = False) -> None:
        if name in self.state["users"]:
            raise AccessError(f"user {name} already exists")
        salt = secrets.token_hex(16)
        self.state["users"][name] = {"salt": salt, "hash": self._hash(password or "", salt), "roles": [], "admin": admin}
        self._save()

    @staticmethod
    def _hash(password: str, salt: str) -> str:
        return hashlib.scrypt(password.encode(), salt=bytes.fromhex(salt), n=2**14, r=8, p=1).hex()

    def login(self, name: str, password: str) -> bool:
        u = self.state["users"].get(name)
        return u is not None and secrets.compare_digest(u["hash"], self._hash(password, u["salt"]))

    def drop_user(self, name: str) -> None:
        if self.state["users"].pop(name, None) is None:
            raise AccessError(f"user {name} does not exist")
        self._save()

    def create_role(self, name: str) -> None:
        if name in self.state["roles"]:
            raise AccessError(f"role {name} already exists")
        self.state["roles"][name] = {"rules": []}
        self._save()

    def drop_role(self, name: str) -> None:
        if self.state["roles"].pop(name, None) is None:
            raise AccessError(f"role {name} does not exist")
        for u in self.state["users"].values():
            u["roles"] = [r for r in u["roles"] if r != name]
        self._save()

    def grant_role(self, role: str, user: str) -> None:
        if role not in self.state["roles"] or user not in self.state["users"]:
            raise AccessError(f"role {role} or user {user} does not exist")
        if role not in self.state["users"][user]["roles"]:
            self.state["users"][user]["roles"].append(role)
        self._save()

    def revoke_role(self, role: str, user: str) -> None:
        self.state["users"][user]["roles"] = [r for r in self.state["users"][user]["roles"] if r != role]
        self._save()

    def rule(self, verb: str, privilege: str, kind: str, target: str, role: str) -> None:
        """verb: GRANT, DENY or REVOKE (which takes both back); kind: TABLE or PATH, target may be a glob."""
        if privilege not in PRIVILEGES:
            raise AccessError(f"unknown privilege {privilege}")
        if role not in self.state["roles"]:
            raise AccessError(f"role {role} does not exist")
        rules = self.state["roles"][role]["rules"]
        same = [privilege, kind, target]
        self.state["roles"][role]["rules"] = [r for r in rules if r[1:] != same or (verb != "REVOKE" and r[0] != verb)]
        if verb != "REVOKE":
            self.state["roles"][role]["rules"].append([verb, *same])
        self._save()

    def allowed(self, user: str, privilege: str, kind: str, target: str) -> bool:
        u = self.state["users"].get(user)
        if u is None:
            return False
        if u["admin"]:
            return True
        rules = [r for role in u["roles"] for r in self.state["roles"].get(role, {"rules": []})["rules"]]
        hits = [r[0] for r in rules if r[1] in (privilege, "ALL") and r[2] == kind and fnmatch.fnmatchcase(target, r[3])]
        return "DENY" not in hits and "GRANT" in hits

    def check_table(self, user: str, table: str, privilege: str = "SELECT") -> None:
        if not self.allowed(user, privilege, "TABLE", table):
            raise AccessError(f"{user} may not {privilege} table {table}")

    def check_path(self, user: str, path: str, privilege: str = "SELECT") -> None:
        if not self.allowed(user, privilege, "PATH", path):
            raise AccessError(f"{user} may not {privilege} path {path}")

    def check_query(self, con, sql: str) -> None:
        """Every catalog table that the text names, subqueries included."""
        from pelagia.plans.tokens import name_of, tokenize

        for t in tokenize(sql):
            if t.kind in ("word", "quoted") and name_of(t) in con.catalog.entries:
                self.check_table(con.user, name_of(t))
