"""Signed tokens: HS256 web tokens, session tokens, webhook signatures, digest answers; and the six-case test matrix."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def make_token(secret: str, stream: str = "", action: str = "", exp: int = 0) -> str:
    """An HS256 token; empty claims are left out."""
    claims = {k: v for k, v in (("sub", stream), ("action", action), ("exp", exp)) if v}
    body = f"{_b64(json.dumps({'alg': 'HS256', 'typ': 'JWT'}, separators=(',', ':')).encode())}.{_b64(json.dumps(claims, separators=(',', ':')).encode())}"
    return f"{body}.{_b64(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest())}"


def check_token(token: str | None, secret: str, stream: str, action: str, now: int) -> bool:
    """Always HS256, whatever the header says; exp 0 or none never ends; sub and action bind only where present."""
    parts = (token or "").split(".")
    if len(parts) != 3:
        return False
    try:
        signature = base64.urlsafe_b64decode(parts[2] + "=" * (-len(parts[2]) % 4))
        claims = json.loads(base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4)))
    except ValueError:
        return False
    good = hmac.compare_digest(signature, hmac.new(secret.encode(), f"{parts[0]}.{parts[1]}".encode(), hashlib.sha256).digest())
    exp = claims.get("exp") or 0
    return good and not (exp and now > exp) and claims.get("sub") in (None, "", stream) and claims.get("action") in (None, "", action)


def token_valid(token: Column, secret: str, stream: Column, action: Column, now: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(t: pd.Series, s: pd.Series, a: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([check_token(*x) for x in zip(t, [secret] * len(t), s, a, n)], dtype=bool)

    return of(token, stream, action, now)


def hmac_hex(secret: str, data: Column) -> Column:
    """HMAC-SHA256 in hex."""

    @F.pandas_udf("string")
    def of(d: pd.Series) -> pd.Series:
        return d.map(lambda x: hmac.new(secret.encode(), x.encode() if isinstance(x, str) else bytes(x), hashlib.sha256).hexdigest(), na_action="ignore")

    return of(data)


def session_token(secret: str, expiry: Column) -> Column:
    """hex(expiry) and its signature."""
    h = F.lower(F.hex(expiry))
    return F.concat_ws(".", h, hmac_hex(secret, h))


def digest_answer(user: Column, realm: Column, password: Column, method: Column, uri: Column, nonce: Column) -> Column:
    """The answer of MD5 digest authentication, in built-in functions."""
    return F.md5(F.concat_ws(":", F.md5(F.concat_ws(":", user, realm, password)), nonce, F.md5(F.concat_ws(":", method, uri))))


def allowed(mode: str, token_ok: Column, callback_ok: Column) -> Column:
    """none: all; token; callback; token+callback: either."""
    return {"none": F.lit(True), "token": token_ok, "callback": callback_ok, "token+callback": token_ok | callback_ok}.get(mode, F.lit(False))


def cases(spark: SparkSession, now: int = 1_700_000_000, secret: str = "secret") -> DataFrame:
    """Six tokens for each protocol and action, checked."""
    rows = []
    for protocol in ("rtmp", "rtsp", "srt", "whip"):
        for action, other in (("publish", "subscribe"), ("subscribe", "publish")):
            for name, token in (("valid", make_token(secret, "live/a", action, now + 60)), ("expired", make_token(secret, "live/a", action, now - 60)), ("wrong_secret", make_token("other", "live/a", action, now + 60)), ("missing", None), ("wrong_stream", make_token(secret, "live/b", action, now + 60)), ("wrong_action", make_token(secret, "live/a", other, now + 60))):
                rows.append((protocol, action, name, token))
    df = spark.createDataFrame(rows, "protocol string, action string, name string, token string")
    return df.withColumn("allowed", token_valid(F.col("token"), secret, F.lit("live/a"), F.col("action"), F.lit(now)))
