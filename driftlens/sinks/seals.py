"""Detached Ed25519 signatures over a document's canonical form: layout may change, values may not.

Needs the ``cryptography`` package, which is imported only here and only when a document is sealed or verified.
"""

from __future__ import annotations

import base64
import json
import os

from .documents import canonical


def _body(path: str) -> bytes:
    with open(path, encoding="utf-8") as f:
        return canonical(json.load(f))


def seal(key: str, paths: list[str]) -> str:
    """Sign each document beside itself (``.sig``); a missing key is made, readable by its owner only. Returns the public key's path."""
    from cryptography.hazmat.primitives import serialization as form
    from cryptography.hazmat.primitives.asymmetric.ed25519 import Ed25519PrivateKey

    if os.path.exists(key):
        with open(key, "rb") as f:
            private = form.load_pem_private_key(f.read(), password=None)
    else:
        private = Ed25519PrivateKey.generate()
        os.makedirs(os.path.dirname(key) or ".", exist_ok=True)
        with os.fdopen(os.open(key, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
            f.write(private.private_bytes(form.Encoding.PEM, form.PrivateFormat.PKCS8, form.NoEncryption()))
    public = f"{key}.pub"
    with open(public, "wb") as f:
        f.write(private.public_key().public_bytes(form.Encoding.PEM, form.PublicFormat.SubjectPublicKeyInfo))
    for path in paths:
        with open(f"{path}.sig", "w", encoding="ascii") as f:
            f.write(base64.b64encode(private.sign(_body(path))).decode())
    return public


def verify(public: str, paths: list[str]) -> dict[str, str]:
    """verified, changed or unsigned for each document."""
    from cryptography.exceptions import InvalidSignature
    from cryptography.hazmat.primitives import serialization as form

    with open(public, "rb") as f:
        key = form.load_pem_public_key(f.read())
    out = {}
    for path in paths:
        if not os.path.exists(f"{path}.sig"):
            out[path] = "unsigned"
            continue
        with open(f"{path}.sig", encoding="ascii") as f:
            signature = base64.b64decode(f.read())
        try:
            key.verify(signature, _body(path))
            out[path] = "verified"
        except InvalidSignature:
            out[path] = "changed"
    return out
