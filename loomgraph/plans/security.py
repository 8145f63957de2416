"""Authentication, authorization and tenant governance."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Unauthenticated(PermissionError):
    code = "UNAUTHENTICATED"


class Denied(PermissionError):
    code = "PERMISSION_DENIED"


@dataclass
class Principal:
    subject: str
    tenant: str
    roles: set[str] = field(default_factory=set)
    scopes: set[str] = field(default_factory=set)
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Resource:
    tenant: str
    action: str
    required: dict[str, str] = field(default_factory=dict)
    clearance: int = 0


def _part(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def authenticate(token: str, secret: bytes, issuer: str | None = None, audience: str | None = None, now: float | None = None) -> Principal:
    """HS256 token -> principal; exp and nbf without leeway, iss and aud if asked for."""
    now = time.time() if now is None else now
    try:
        head, body, signature = token.split(".")
        claims = json.loads(_part(body))
        good = json.loads(_part(head)).get("alg") == "HS256" and hmac.compare_digest(hmac.new(secret, f"{head}.{body}".encode(), hashlib.sha256).digest(), _part(signature))
    except (ValueError, AttributeError) as e:
        raise Unauthenticated("malformed token") from e
    if not good:
        raise Unauthenticated("bad signature")
    if "exp" not in claims or claims["exp"] <= now or claims.get("nbf", 0) > now:
        raise Unauthenticated("token is not valid now")
    audiences = claims.get("aud", [])
    if issuer and claims.get("iss") != issuer or audience and audience not in ([audiences] if isinstance(audiences, str) else audiences):
        raise Unauthenticated("wrong issuer or audience")
    return Principal(claims["sub"], claims["tenant"], set(claims.get("roles", [])), set(claims.get("scopes", [])), claims.get("attributes", {}))


#: Actions of each role, and the scopes that allow an action (fixed values).
ROLE_ACTIONS = {"reader": {"query"}, "ingestor": {"ingest"}, "admin": {"ingest", "query", "admin"}}
ACTION_SCOPES = {"ingest": {"ingest:write", "admin:*"}, "query": {"query:execute", "admin:*"}, "admin": {"admin:*"}}
CLEARANCE = "clearance_level"


def authorize(who: Principal, what: Resource, tenant_boundary: bool = True) -> None:
    """Tenant, then role or scope, then attributes, then clearance; the first that fails is the error.

    A role that may administrate may do everything. Clearance is the principal's attribute of that name.
    """
    if tenant_boundary and (not what.tenant.strip() or who.tenant != what.tenant.strip()):
        raise Denied("tenant")
    by_role = any({what.action, "admin"} & ROLE_ACTIONS.get(r, set()) for r in who.roles)
    if not by_role and not who.scopes & ACTION_SCOPES.get(what.action, set()):
        raise Denied("role_or_scope")
    for key, value in what.required.items():
        if who.attributes.get(key) != value:
            raise Denied(f"attributes: {key}")
    if what.clearance:
        level = who.attributes.get(CLEARANCE, "")
        if not (level.isascii() and level.isdigit() and int(level) >= what.clearance):
            raise Denied("clearance")


def governed(requests: DataFrame, policies: DataFrame, now_unix: Column) -> DataFrame:
    """requests(tenant, region, metadata) with policies(tenant, residency_region, retention_days, kms_key_id) stamped on.

    A request for another region than the policy's gets an error. Tenants without a policy pass unchanged.
    """
    p = policies.withColumnRenamed("tenant", "policy_tenant")
    both = requests.join(p, requests["tenant"] == p["policy_tenant"], "left")
    deadline = now_unix + F.col("retention_days").cast("bigint") * 86_400
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (("residency_region", F.col("residency_region")), ("retention_until_unix", deadline), ("kms_key_id", F.col("kms_key_id")))])
    new = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    kept = F.map_filter("metadata", lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    error = F.when(F.col("policy_tenant").isNotNull() & F.col("region").isNotNull() & (F.col("region") != F.col("residency_region")), "residency_violation")
    return both.select(*[c for c in requests.columns if c != "metadata"], F.map_concat(kept, new).alias("metadata"), error.alias("error"))
