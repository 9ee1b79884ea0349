"""Small fixed dimension tables: providers, error codes, regions.

They are bounded by construction (three providers, 82 error codes, 16
regions), so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Provider request limits and default requests per second.
# (provider, limit unit, default limit, default qps)
PROVIDERS = [
    ("baidu", "bytes", 6000, 1),
    ("tencent", "chars", 2000, 5),
    ("niutrans", "chars", 5000, 50),
]

# Region names accepted by the signed-JSON provider, with the
# name its documentation table lists when that differs.
REGIONS = [
    ("ap-beijing", "ap-beijing"), ("ap-shanghai", "ap-shanghai"),
    ("ap-shanghai-fsi", "ap-shanghai-fsi"), ("ap-guangzhou", "ap-guangzhou"),
    ("ap-shenzhen-fsi", "ap-shenzhen-fsi"), ("ap-chengdu", "ap-chengdu"),
    ("ap-chongqing", "ap-chongqing"), ("ap-hongkong", "ap-hongkong"),
    ("ap-bangkok", "ap-bangkok"), ("ap-mumbai", "ap-mumbai"), ("ap-seoul", "ap-seoul"),
    ("ap-singapore", "ap-singapore"), ("ap-frankfurt", "eu-frankfurt"),
    ("ap-ashburn", "na-ashburn"), ("ap-siliconvalley", "na-siliconvalley"),
    ("ap-toronto", "na-toronto"),
]
DEFAULT_REGION = "ap-beijing"

# Provider error codes with a short meaning of our own wording.
ERROR_CODES = [
    ("baidu", "52000", "success"),
    ("baidu", "52001", "request timed out; retry"),
    ("baidu", "52002", "system error; retry"),
    ("baidu", "52003", "unauthorized user; check the appid and that the service is enabled"),
    ("baidu", "54000", "a required parameter is empty"),
    ("baidu", "54001", "invalid signature; check how the sign is computed"),
    ("baidu", "54003", "access frequency limited; slow down or upgrade the plan"),
    ("baidu", "54004", "insufficient account balance"),
    ("baidu", "54005", "long queries sent too often; wait 3 s and retry"),
    ("baidu", "58000", "client IP not allowed"),
    ("baidu", "58001", "target language direction not supported"),
    ("baidu", "58002", "service is switched off"),
    ("baidu", "90107", "account verification not passed or not yet effective"),
    ("tencent", "ActionOffline", "the action is offline"),
    ("tencent", "AuthFailure.InvalidAuthorization", "Authorization header is not in the expected format"),
    ("tencent", "AuthFailure.InvalidSecretId", "invalid key type (not an API key)"),
    ("tencent", "AuthFailure.MFAFailure", "multi-factor authentication failed"),
    ("tencent", "AuthFailure.SecretIdNotFound", "key does not exist or is disabled"),
    ("tencent", "AuthFailure.SignatureExpire", "signature expired; clock differs from server by over five minutes"),
    ("tencent", "AuthFailure.SignatureFailure", "signature is wrong; check the signing steps"),
    ("tencent", "AuthFailure.TokenFailure", "token error"),
    ("tencent", "AuthFailure.UnauthorizedOperation", "request not authorized"),
    ("tencent", "DryRunOperation", "dry run: the request would have succeeded"),
    ("tencent", "FailedOperation", "operation failed"),
    ("tencent", "InternalError", "internal error"),
    ("tencent", "InvalidAction", "the action does not exist"),
    ("tencent", "InvalidParameter", "invalid parameter (format or type)"),
    ("tencent", "InvalidParameterValue", "invalid parameter value"),
    ("tencent", "InvalidRequest", "malformed multipart request body"),
    ("tencent", "IpInBlacklist", "IP address is blacklisted"),
    ("tencent", "IpNotInWhitelist", "IP address is not whitelisted"),
    ("tencent", "LimitExceeded", "quota exceeded"),
    ("tencent", "MissingParameter", "missing parameter"),
    ("tencent", "NoSuchProduct", "product does not exist"),
    ("tencent", "NoSuchVersion", "API version does not exist"),
    ("tencent", "RequestLimitExceeded", "request rate limit exceeded"),
    ("tencent", "RequestLimitExceeded.GlobalRegionUinLimitExceeded", "main account exceeded the rate limit"),
    ("tencent", "RequestLimitExceeded.IPLimitExceeded", "IP rate limited"),
    ("tencent", "RequestLimitExceeded.UinLimitExceeded", "main account rate limited"),
    ("tencent", "RequestSizeLimitExceeded", "request body too large"),
    ("tencent", "ResourceInUse", "resource in use"),
    ("tencent", "ResourceInsufficient", "insufficient resources"),
    ("tencent", "ResourceNotFound", "resource not found"),
    ("tencent", "ResourceUnavailable", "resource unavailable"),
    ("tencent", "ResponseSizeLimitExceeded", "response too large"),
    ("tencent", "ServiceUnavailable", "service temporarily unavailable"),
    ("tencent", "UnauthorizedOperation", "unauthorized operation"),
    ("tencent", "UnknownParameter", "unknown parameter supplied"),
    ("tencent", "UnsupportedOperation", "operation not supported"),
    ("tencent", "UnsupportedProtocol", "unsupported protocol; only GET and POST"),
    ("tencent", "UnsupportedRegion", "region not supported by this action"),
    ("tencent", "FailedOperation.NoFreeAmount", "monthly free quota used up"),
    ("tencent", "FailedOperation.ServiceIsolate", "service suspended for arrears"),
    ("tencent", "FailedOperation.UserNotRegistered", "service not activated"),
    ("tencent", "InternalError.BackendTimeout", "backend timed out; retry later"),
    ("tencent", "InternalError.ErrorUnknown", "unknown error"),
    ("tencent", "InternalError.RequestFailed", "request failed"),
    ("tencent", "InvalidParameter.DuplicatedSessionIdAndSeq", "duplicated session id and sequence"),
    ("tencent", "InvalidParameter.MissingParameter", "parameter error"),
    ("tencent", "InvalidParameter.SeqIntervalTooLarge", "sequence gap larger than 2000"),
    ("tencent", "LimitExceeded.LimitedAccessFrequency", "request frequency exceeded"),
    ("tencent", "UnauthorizedOperation.ActionNotFound", "fill in a valid Action name"),
    ("tencent", "UnsupportedOperation.AudioDurationExceed", "audio slice longer than 8 s"),
    ("tencent", "UnsupportedOperation.TextTooLong", "text longer than 2000 per request"),
    ("tencent", "UnsupportedOperation.UnSupportedTargetLanguage", "target language not supported"),
    ("tencent", "UnsupportedOperation.UnsupportedLanguage", "language not supported"),
    ("tencent", "UnsupportedOperation.UnsupportedSourceLanguage", "source language not supported"),
    ("niutrans", "10000", "input is empty"),
    ("niutrans", "10001", "too many requests; QPS limit exceeded"),
    ("niutrans", "10003", "request text too long"),
    ("niutrans", "10005", "source text is not UTF-8"),
    ("niutrans", "13001", "insufficient character quota or no access"),
    ("niutrans", "13002", "apikey must not be empty"),
    ("niutrans", "13003", "content filter error"),
    ("niutrans", "13007", "language not supported"),
    ("niutrans", "13008", "request processing timed out"),
    ("niutrans", "14001", "sentence splitting error"),
    ("niutrans", "14002", "tokenization error"),
    ("niutrans", "14003", "post-processing error"),
    ("niutrans", "14004", "alignment failed"),
    ("niutrans", "000000", "invalid request parameters"),
    ("niutrans", "000001", "Content-Type multipart/form-data not supported"),
]
UNKNOWN_ERROR = "unknown error"

# Provider display names used in formatted error messages.
PROVIDER_LABELS = {"baidu": "Baidu Translate API", "tencent": "Tencent Cloud API", "niutrans": "NiuTrans API"}


def providers(spark: SparkSession, overrides: dict[str, int] | None = None) -> DataFrame:
    """Provider limits; ``overrides`` maps provider -> limit value."""
    rows = [(p, u, int((overrides or {}).get(p, v)), q) for p, u, v, q in PROVIDERS]
    return spark.createDataFrame(rows, "provider string, limit_unit string, limit_value bigint, qps int")


def error_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERROR_CODES, "provider string, code string, meaning string")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, documented string")


def values_sql(rows, cols, alias: str = "t") -> str:
    """The same rows as a SQL VALUES list (used by the DuckDB oracles)."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"
