"""Accounts, and signed tokens that say who asks and in which workspace."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from siltstone.errors import EngineError
from siltstone.fs import Files

#: Seconds that a token is valid.
VALID = 24 * 3600
_COST = {"n": 1 << 14, "r": 8, "p": 1}


class Unauthorized(EngineError):
    """No valid token, or no such account with that password."""


@dataclass(frozen=True)
class Identity:
    user: str
    workspace: str


def _packed(x: bytes) -> str:
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def _unpacked(x: str) -> bytes:
    return base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))


def sign(who: Identity, secret: bytes, now: float, valid: float = VALID) -> str:
    """A JSON web token, signed with HMAC-SHA256."""
    parts = {"alg": "HS256", "typ": "JWT"}, {"sub": who.user, "workspace": who.workspace, "iat": int(now), "exp": int(now + valid)}
    body = ".".join(_packed(json.dumps(p, separators=(",", ":")).encode()) for p in parts)
    return f"{body}.{_packed(hmac.digest(secret, body.encode(), 'sha256'))}"


def verified(token: str, secret: bytes, now: float) -> Identity:
    """Who the token is for; an error if it isn't signed this way, is changed or too old."""
    try:
        head, claims, mark = token.split(".")
        if json.loads(_unpacked(head))["alg"] != "HS256" or not hmac.compare_digest(_unpacked(mark), hmac.digest(secret, f"{head}.{claims}".encode(), "sha256")):
            raise ValueError
        known = json.loads(_unpacked(claims))
        if now >= known["exp"]:
            raise ValueError
        return Identity(known["sub"], known["workspace"])
    except (ValueError, KeyError, TypeError):
        raise Unauthorized("the token isn't valid") from None


class Accounts:
    """A file for each account and each workspace, made once and never changed; passwords are kept as salted scrypt hashes."""

    def __init__(self, spark: SparkSession, root: str, secret: bytes, clock: Callable[[], float] = time.time):
        if len(secret) < 16:
            raise EngineError("the secret must have 16 bytes at least")
        self.root, self.secret, self.files, self.clock = f"{root.rstrip('/')}/accounts", secret, Files(spark), clock

    def _at(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}-{hashlib.sha256(name.encode()).hexdigest()}.json"

    def signup(self, email: str, password: str, workspace: str = "") -> str:
        """A token for the new account, in the workspace of that name (its own by default), which is made if there is none."""
        email = email.strip().lower()
        if "@" not in email or len(password) < 8:
            raise EngineError("an account needs an address and a password of 8 characters at least")
        at, salt = self._at("user", email), os.urandom(16)
        if self.files.exists(at):
            raise EngineError("there is an account with this address")
        home = self._workspace(workspace.strip() or email)
        self.files.write_new(at, json.dumps({"user": uuid.uuid4().hex, "email": email, "workspace": home, "salt": salt.hex(), "hash": hashlib.scrypt(password.encode(), salt=salt, **_COST).hex()}).encode())
        return self.login(email, password)

    def _workspace(self, name: str) -> str:
        at = self._at("workspace", name)
        if not self.files.exists(at):
            try:
                self.files.write_new(at, json.dumps({"id": uuid.uuid4().hex, "name": name}).encode())
            except EngineError:
                pass  # someone else made it just now
        return json.loads(self.files.read(at))["id"]

    def login(self, email: str, password: str) -> str:
        """The same error, after the same work, whether the account or the password is wrong."""
        at = self._at("user", email.strip().lower())
        known = json.loads(self.files.read(at)) if self.files.exists(at) else {"salt": "00" * 16, "hash": "", "user": "", "workspace": ""}
        found = hashlib.scrypt(password.encode(), salt=bytes.fromhex(known["salt"]), **_COST).hex()
        if not hmac.compare_digest(found, known["hash"]):
            raise Unauthorized("wrong address or password")
        return sign(Identity(known["user"], known["workspace"]), self.secret, self.clock())

    def who(self, token: str) -> Identity:
        return verified(token, self.secret, self.clock())
