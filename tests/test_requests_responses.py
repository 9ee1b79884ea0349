"""Request signing and response parsing goldens."""

import hashlib

from pyspark.sql import functions as F

from interlinear import dims
from interlinear.functions.hashing import hmac_sha256_hex
from interlinear.operators import requests as R
from interlinear.operators import responses as P
from interlinear.plans.stub import stub_service

SPACED = '{"Source": "en", "Target": "zh", "ProjectId": 0, "SourceTextList": ["hi", "there"]}'
TS = 1636111645


def test_payload_json_is_compact_and_ordered(spark):
    df = spark.createDataFrame([("en", "zh", "hi\nthere")], "from_lang string, to_lang string, text string")
    r = R.payload_json(R.with_query(df)).collect()[0]
    assert r.payload == '{"Source":"en","Target":"zh","ProjectId":0,"SourceTextList":["hi","there"]}'


def test_signature_chain_goldens(spark):
    assert R.signing_key("0", "2021-11-05").hex() == "e67867cc6f99a088d74085ca77a6b4c1df2d4d888320836de1b00f7d7fbeb7b5"
    df = spark.createDataFrame([(SPACED,)], "payload string")
    r = df.select(F.sha2("payload", 256).alias("h"), R.tc3_signature_expr(F.col("payload"), "0", TS).alias("sig")).collect()[0]
    assert r.h == "132203170c4d03f4b351cacc51a7ceeed78ca571be42688945f74bb0796bb739"
    assert r.sig == "5a4474831e97a0b0e37730abf8de690234fb750be49bf5033469f2b626752eb5"
    canonical = R.TC3_CANONICAL_PREFIX + r.h
    assert hashlib.sha256(canonical.encode()).hexdigest() == "ef9234630cfbd7baf254265506ed5d0193d278468d367a9c8a809d6300173df1"


def test_hmac_matches_python(spark):
    import hmac
    df = spark.createDataFrame([("message ü",)], "m string")
    got = df.select(hmac_sha256_hex(b"k" * 70, F.col("m")).alias("h")).collect()[0].h
    assert got == hmac.new(b"k" * 70, "message ü".encode(), hashlib.sha256).hexdigest()


def test_build_requests_all_providers(spark):
    rows = [("baidu", 0, " hi\nthere\n"), ("tencent", 0, "hi\nthere\n"), ("niutrans", 0, "hi\n"), ("other", 0, "x\n")]
    b = spark.createDataFrame(rows, "provider string, batch_no int, text string") \
        .withColumn("from_lang", F.lit("en")).withColumn("to_lang", F.lit("zh")).withColumn("doc_id", F.lit(1))
    creds = R.Credentials(R.Md5FormUser("app", "key"), R.SignedJsonUser("0", "0"), R.PlainFormUser("api", "d1", "m1"))
    got = {r.provider: r for r in R.build_requests(b, creds, TS).collect()}
    assert got["baidu"].q == "hi\nthere"
    assert got["baidu"].sign == hashlib.md5(b"apphi\nthere0key").hexdigest()
    assert got["tencent"].headers["authorization"].startswith(
        "TC3-HMAC-SHA256 Credential=0/2021-11-05/tmt/tc3_request, SignedHeaders=content-type;host, Signature=")
    assert got["tencent"].headers["x-tc-region"] == "ap-beijing"
    assert '"memoryNo":"m1"' in got["niutrans"].payload and '"dictNo":"d1"' in got["niutrans"].payload
    assert got["other"].req_status == "unknown_provider"


def test_parse_goldens(spark):
    bodies = [
        ("baidu", '{"from":"en","to":"zh","trans_result":[{"src":"hello","dst":"你好"},{"src":"world","dst":"世界"}]}'),
        ("baidu", '{"error_code":"54001","error_msg":"Invalid Sign"}'),
        ("tencent", '{"Response":{"RequestId":"x","Source":"en","Target":"zh","TargetTextList":["嗨","那里"]}}'),
        ("tencent", '{"Response":{"Error":{"Code":"AuthFailure.SignatureFailure","Message":"m"},"RequestId":"x"}}'),
        ("niutrans", '{"tgt_text":"嗨\\n那里\\n","to":"zh","from":"en"}'),
        ("niutrans", '{"to":"zh","error_code":"13001","from":"en","error_msg":"m","src_text":"hi\\nthere","apikey":"xx"}'),
        ("baidu", "not json"),
    ]
    df = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(bodies)], "batch_no int, provider string, body string")
    out = P.explain_error(P.unify_responses(df), dims.error_codes(spark)).orderBy("batch_no").collect()
    assert [r.status for r in out] == ["ok", "error", "ok", "error", "ok", "error", "bad_json"]
    assert out[0].dst == ["你好", "世界"] and out[2].dst == ["嗨", "那里"] and out[4].dst == ["嗨", "那里"]
    assert [out[i].error_code for i in (1, 3, 5)] == ["54001", "AuthFailure.SignatureFailure", "13001"]
    assert out[1].meaning == "invalid signature; check how the sign is computed"
    fe = P.format_error(P.explain_error(P.unify_responses(df), dims.error_codes(spark))).filter("batch_no = 1").collect()[0]
    assert fe.error_text.startswith("error code: `54001`\nerror message: `Invalid Sign`\n")


def test_stub_service_round_trip(spark):
    b = spark.createDataFrame([(1, 0, p, "a\nb\n", False) for p in ("baidu", "tencent", "niutrans")],
                              "doc_id long, batch_no int, provider string, text string, oversize boolean") \
        .withColumn("from_lang", F.lit("en")).withColumn("to_lang", F.lit("zh"))
    creds = R.Credentials(R.Md5FormUser("a", "k"), R.SignedJsonUser("0", "0"), R.PlainFormUser("k"))
    out = P.unify_responses(stub_service(R.build_requests(b, creds, TS))).collect()
    assert all(r.dst == ["[zh] a", "[zh] b"] for r in out)


def test_regions_dimension(spark):
    assert len(dims.REGIONS) == 16
    assert len(dims.ERROR_CODES) == 13 + 54 + 15


def test_region_lookup(spark):
    df = spark.createDataFrame([(1, "ap-seoul"), (2, None), (3, "mars-1")], "id int, region string")
    got = {r.id: (r.region, r.region_ok) for r in R.region_lookup(df, dims.regions(spark)).collect()}
    assert got == {1: ("ap-seoul", True), 2: ("ap-beijing", True), 3: ("mars-1", False)}
    b = spark.createDataFrame([(1, 0, "tencent", "x\n")], "doc_id long, batch_no int, provider string, text string") \
        .withColumn("from_lang", F.lit("en")).withColumn("to_lang", F.lit("zh"))
    bad = R.Credentials(tencent=R.SignedJsonUser("0", "0", region="mars-1"))
    assert R.build_requests(b, bad, TS).collect()[0].req_status == "unknown_region"
