"""Service requests built from batches, as columns.

Input: batches with ``text`` (segments each + newline), ``from_lang``,
``to_lang`` and ``provider``. Credentials are driver-side parameters; they
enter the plan only as literals (and key material only as derived pad
blocks), never as a table column that could be written out.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlinear import dims
from interlinear.functions.hashing import hmac_sha256, hmac_sha256_hex, sha256_hex
from interlinear.functions.text import utrim

# The signed-JSON provider's request constants.
TC3_ALGORITHM = "TC3-HMAC-SHA256"
TC3_HOST = "tmt.tencentcloudapi.com"
TC3_SERVICE = "tmt"
TC3_ACTION = "TextTranslateBatch"
TC3_VERSION = "2018-03-21"
TC3_CONTENT_TYPE = "application/json"
TC3_SIGNED_HEADERS = "content-type;host"
TC3_TERMINATOR = "tc3_request"
TC3_CANONICAL_PREFIX = (
    "POST\n/\n\ncontent-type:application/json\nhost:tmt.tencentcloudapi.com\n\ncontent-type;host\n"
)


@dataclass
class Md5FormUser:
    appid: str
    key: str
    salt: str = "0"


@dataclass
class SignedJsonUser:
    id: str
    key: str
    region: str = dims.DEFAULT_REGION
    projectid: int = 0


@dataclass
class PlainFormUser:
    key: str
    dict_no: str = ""
    memory_no: str = ""


@dataclass
class Credentials:
    baidu: Md5FormUser | None = None
    tencent: SignedJsonUser | None = None
    niutrans: PlainFormUser | None = None
    extra: dict = field(default_factory=dict)


def with_query(batches: DataFrame) -> DataFrame:
    """R1 + R2: trimmed batch text ``q`` and its lines (inner empties kept)."""
    q = utrim("text")
    return batches.withColumn("q", q).withColumn("lines", F.split(F.col("q"), "\n", -1))


def form_md5(reqs: DataFrame, user: Md5FormUser) -> DataFrame:
    """sign = md5(appid + q + salt + key); form (q, from, to, appid, salt, sign)."""
    sign = F.md5(F.concat(F.lit(user.appid), F.col("q"), F.lit(user.salt), F.lit(user.key)))
    form = F.struct(F.col("q"), F.col("from_lang").alias("from"), F.col("to_lang").alias("to"),
                    F.lit(user.appid).alias("appid"), F.lit(user.salt).alias("salt"), sign.alias("sign"))
    return reqs.withColumn("sign", sign).withColumn("form", form)


def payload_json(reqs: DataFrame, projectid: int = 0) -> DataFrame:
    """Compact JSON in key order Source, Target, ProjectId, SourceTextList."""
    body = F.to_json(F.struct(F.col("from_lang").alias("Source"), F.col("to_lang").alias("Target"),
                              F.lit(projectid).cast("int").alias("ProjectId"), F.col("lines").alias("SourceTextList")))
    return reqs.withColumn("payload", body)


def payload_sha256(reqs: DataFrame) -> DataFrame:
    """Lower-hex SHA-256 of the payload bytes."""
    return reqs.withColumn("hashed_payload", sha256_hex(F.col("payload")))


def signing_key(secret: str, date: str) -> bytes:
    """R6 key chain: HMAC(HMAC(HMAC('TC3'+key, date), service), 'tc3_request').

    Depends only on the secret and the UTC date, so it is derived once per
    distinct date on the driver.
    """
    k = hmac_sha256(("TC3" + secret).encode(), date.encode())
    k = hmac_sha256(k, TC3_SERVICE.encode())
    return hmac_sha256(k, TC3_TERMINATOR.encode())


def utc_date(timestamp: int) -> str:
    return _dt.datetime.fromtimestamp(int(timestamp), _dt.timezone.utc).strftime("%Y-%m-%d")


def tc3_signature_expr(payload, secret: str, timestamp: int):
    """Signature column for a payload column (canonical request -> string to
    sign -> keyed hash with the day's signing key)."""
    date = utc_date(timestamp)
    scope = f"{date}/{TC3_SERVICE}/{TC3_TERMINATOR}"
    canonical = F.concat(F.lit(TC3_CANONICAL_PREFIX), sha256_hex(payload))
    to_sign = F.concat(F.lit(f"{TC3_ALGORITHM}\n{int(timestamp)}\n{scope}\n"), sha256_hex(canonical))
    return hmac_sha256_hex(signing_key(secret, date), to_sign)


def tc3_signature(reqs: DataFrame, user: SignedJsonUser, timestamp: int) -> DataFrame:
    """Canonical request, credential scope, string to sign, signature.

    ``timestamp`` is an explicit run parameter (epoch seconds), so a re-run of
    a failed task signs identically.
    """
    date = utc_date(timestamp)
    scope = f"{date}/{TC3_SERVICE}/{TC3_TERMINATOR}"
    canonical = F.concat(F.lit(TC3_CANONICAL_PREFIX), sha256_hex(F.col("payload")))
    to_sign = F.concat(F.lit(f"{TC3_ALGORITHM}\n{int(timestamp)}\n{scope}\n"), sha256_hex(canonical))
    sig = hmac_sha256_hex(signing_key(user.key, date), to_sign)
    return (reqs.withColumn("credential_scope", F.lit(scope))
                .withColumn("timestamp", F.lit(str(int(timestamp))))
                .withColumn("signature", sig))


def region_lookup(reqs: DataFrame, regions: DataFrame, region_col: str = "region") -> DataFrame:
    """Resolve each row's region against the 16 known names (an
    equi-join, broadcast if small); null means the default region, an
    unknown name resolves to null and is reported by ``region_ok``."""
    r = reqs.withColumn(region_col, F.coalesce(F.col(region_col), F.lit(dims.DEFAULT_REGION)))
    known = regions.select(F.col("region").alias("_known_region"))
    r = r.join(known, r[region_col] == known["_known_region"], "left")
    return r.withColumn("region_ok", F.col("_known_region").isNotNull()).drop("_known_region")


def auth_headers(reqs: DataFrame, user: SignedJsonUser) -> DataFrame:
    """Authorization string and the 7-entry header map (region from the
    ``region`` column, see ``region_lookup``)."""
    auth = F.concat(F.lit(f"{TC3_ALGORITHM} Credential={user.id}/"), F.col("credential_scope"),
                    F.lit(f", SignedHeaders={TC3_SIGNED_HEADERS}, Signature="), F.col("signature"))
    headers = F.create_map(
        F.lit("authorization"), auth,
        F.lit("content-type"), F.lit(TC3_CONTENT_TYPE),
        F.lit("host"), F.lit(TC3_HOST),
        F.lit("x-tc-action"), F.lit(TC3_ACTION),
        F.lit("x-tc-version"), F.lit(TC3_VERSION),
        F.lit("x-tc-region"), F.col("region"),
        F.lit("x-tc-timestamp"), F.col("timestamp"),
    )
    return reqs.withColumn("authorization", auth).withColumn("headers", headers)


def form_plain(reqs: DataFrame, user: PlainFormUser) -> DataFrame:
    """Form (src_text, from, to, apikey, dictNo, memoryNo); memoryNo carries
    the memory id (the dictionary id is not reused for it)."""
    form = F.struct(F.col("q").alias("src_text"), F.col("from_lang").alias("from"), F.col("to_lang").alias("to"),
                    F.lit(user.key).alias("apikey"), F.lit(user.dict_no).alias("dictNo"),
                    F.lit(user.memory_no).alias("memoryNo"))
    return reqs.withColumn("form", form)


def lang_rules(reqs: DataFrame) -> DataFrame:
    """O7: 'auto' is allowed as source for two providers only, never as target.
    Rows are kept; ``lang_error`` says why a pair is rejected."""
    err = (F.when(F.col("to_lang") == "auto", F.lit("target language cannot be auto"))
           .when((F.col("from_lang") == "auto") & (F.col("provider") == "niutrans"),
                 F.lit("source language cannot be auto for this provider")))
    return reqs.withColumn("lang_error", err)


def build_requests(batches: DataFrame, creds: Credentials, timestamp: int) -> DataFrame:
    """One request row per batch, built by its provider's rules.

    One narrow projection: ``sign``, ``payload`` and ``headers`` are CASE
    expressions on ``provider`` (only the matching branch is evaluated), so
    the batches are read once whatever the provider mix. A provider without
    credentials or an unknown name gives a non-``ready`` status, not an error.
    """
    base = lang_rules(with_query(batches))
    prov = F.col("provider")
    sign = F.lit(None).cast("string")
    payload = F.lit(None).cast("string")
    headers = F.lit(None).cast("map<string,string>")
    served = []
    region_bad = False
    if creds.baidu:
        u = creds.baidu
        md5 = F.md5(F.concat(F.lit(u.appid), F.col("q"), F.lit(u.salt), F.lit(u.key)))
        form = F.struct(F.col("q"), F.col("from_lang").alias("from"), F.col("to_lang").alias("to"),
                        F.lit(u.appid).alias("appid"), F.lit(u.salt).alias("salt"), md5.alias("sign"))
        sign = F.when(prov == "baidu", md5).otherwise(sign)
        payload = F.when(prov == "baidu", F.to_json(form)).otherwise(payload)
        served.append("baidu")
    if creds.tencent:
        u = creds.tencent
        region_bad = u.region not in {r for r, _ in dims.REGIONS}
        date = utc_date(timestamp)
        scope = f"{date}/{TC3_SERVICE}/{TC3_TERMINATOR}"
        body = F.to_json(F.struct(F.col("from_lang").alias("Source"), F.col("to_lang").alias("Target"),
                                  F.lit(u.projectid).cast("int").alias("ProjectId"), F.col("lines").alias("SourceTextList")))
        canonical = F.concat(F.lit(TC3_CANONICAL_PREFIX), sha256_hex(body))
        to_sign = F.concat(F.lit(f"{TC3_ALGORITHM}\n{int(timestamp)}\n{scope}\n"), sha256_hex(canonical))
        sig = hmac_sha256_hex(signing_key(u.key, date), to_sign)
        auth = F.concat(F.lit(f"{TC3_ALGORITHM} Credential={u.id}/{scope}, SignedHeaders={TC3_SIGNED_HEADERS}, Signature="), sig)
        hmap = F.create_map(
            F.lit("authorization"), auth, F.lit("content-type"), F.lit(TC3_CONTENT_TYPE),
            F.lit("host"), F.lit(TC3_HOST), F.lit("x-tc-action"), F.lit(TC3_ACTION),
            F.lit("x-tc-version"), F.lit(TC3_VERSION), F.lit("x-tc-region"), F.lit(u.region),
            F.lit("x-tc-timestamp"), F.lit(str(int(timestamp))))
        sign = F.when(prov == "tencent", sig).otherwise(sign)
        payload = F.when(prov == "tencent", body).otherwise(payload)
        headers = F.when(prov == "tencent", hmap).otherwise(headers)
        served.append("tencent")
    if creds.niutrans:
        u = creds.niutrans
        form = F.struct(F.col("q").alias("src_text"), F.col("from_lang").alias("from"), F.col("to_lang").alias("to"),
                        F.lit(u.key).alias("apikey"), F.lit(u.dict_no).alias("dictNo"), F.lit(u.memory_no).alias("memoryNo"))
        payload = F.when(prov == "niutrans", F.to_json(form)).otherwise(payload)
        served.append("niutrans")
    status = (F.when(~prov.isin(*dims.PROVIDER_LABELS), F.lit("unknown_provider"))
              .when(~prov.isin(*served) if served else F.lit(True), F.lit("no_credentials"))
              .when((prov == "tencent") & F.lit(region_bad), F.lit("unknown_region"))
              .when(F.col("lang_error").isNotNull(), F.lit("rejected"))
              .otherwise(F.lit("ready")))
    return base.select("*", sign.alias("sign"), payload.alias("payload"), headers.alias("headers"), status.alias("req_status"))
