"""Requests, parameters and results: classification, lenient parsing, coercion and validation as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import stripped

# Plan, metric key and method of each kind of test.
PLANS = {
    "opamp_bandwidth": ("1) 配置AC扫频 2) 提取增益曲线 3) 计算-3dB带宽", "bandwidth_hz", "通过AC扫频后寻找增益下降3dB频点"),
    "dac_sfdr": ("1) 配置瞬态与采样 2) 执行FFT 3) 计算主瓣与最大杂散差值", "sfdr_db", "通过FFT频谱识别主信号与最大杂散分量"),
    "amp_loop_gain": ("1) 构建环路增益测试 2) 扫频或stb分析 3) 提取低频环路增益", "loop_gain_db", "通过环路断开或stb方式计算环路增益"),
}
# Parameters that are used where none can be read, and what names of nodes, commands and modules look like.
DEFAULTS = {"input_node": "vin", "output_node": "vout", "start_hz": 1.0, "stop_hz": 1e9, "points": 200, "target_gain_db": -3.0}
NODE, COMMAND, MODULE = r"^[A-Za-z_][A-Za-z0-9_.$:-]*$", r"^[A-Za-z0-9._+-]+$", r"^[A-Za-z_][A-Za-z0-9_.]*$"
# What a result can be refused for, in the order of the checks.
RESULT_ERRORS = [
    "result.json root must be an object",
    "result.json missing non-empty status",
    "result.json missing metrics object",
    "result.json metrics missing bandwidth_hz",
    "result.json metrics.bandwidth_hz must be numeric",
    "result.json missing notes list",
    "PASS result must have bandwidth_hz > 0",
]
# Parts of the messages of errors that may pass.
RETRYABLE = [
    "service load is too high", "badrequest.toolarge", "too many requests", "rate limit",
    "timed out", "timeout", "temporarily unavailable", "api urlerror",
]


def test_type(query: str | Column) -> Column:
    q = F.lower(query)
    loop = F.contains(q, F.lit("loop")) | F.contains(q, F.lit("环路"))
    return F.when(F.contains(q, F.lit("sfdr")), "dac_sfdr").when(loop, "amp_loop_gain").otherwise("opamp_bandwidth")


def plan_table(spark: SparkSession) -> DataFrame:
    """(test_type, plan, metric_key, method)"""
    return spark.createDataFrame([(k, *v) for k, v in PLANS.items()], "test_type string, plan string, metric_key string, method string")


def json_object(text: str | Column) -> Column:
    """The JSON object that the text is, else the one from its first { to its last }, else {}; as a JSON string."""
    text = stripped(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    whole = F.try_parse_json(text)
    span = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    obj = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))
    return F.coalesce(F.when(whole.isNotNull(), F.coalesce(obj(whole), F.lit("{}"))), obj(span), F.lit("{}"))


def node_or(value: str | Column, default: str) -> Column:
    v = stripped(value)
    return F.when(v.rlike(NODE), v).otherwise(default)


def double_or(value: str | Column, default: float) -> Column:
    """A number or numeric string as double, else the default."""
    return F.coalesce(stripped(value).try_cast("double"), F.lit(default))


def int_or(value: str | Column, default: int, is_string: bool | Column = True) -> Column:
    """A whole number, else the default; numbers (not strings) with a fraction are truncated."""
    text = stripped(value)
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    flag = F.lit(is_string) if isinstance(is_string, bool) else is_string
    return F.coalesce(whole, F.when(~flag, text.try_cast("double").try_cast("long")), F.lit(default))


def sweep_parameters(payload: str | Column) -> dict[str, Column]:
    """Coerced and clamped parameters from a JSON object; anything unusable is the default."""
    p = json_object(payload)
    v = F.try_parse_json(p)
    get = lambda k: F.get_json_object(p, f"$.{k}")
    text = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.lit(False))
    node = lambda k: F.when(text(k), node_or(get(k), DEFAULTS[k])).otherwise(DEFAULTS[k])
    start = double_or(get("start_hz"), DEFAULTS["start_hz"])
    start = F.when(start <= 0, DEFAULTS["start_hz"]).otherwise(start)
    stop = double_or(get("stop_hz"), DEFAULTS["stop_hz"])
    stop = F.when(stop <= start, F.greatest(start * 10, F.lit(DEFAULTS["stop_hz"]))).otherwise(stop)
    points = int_or(get("points"), DEFAULTS["points"], text("points"))
    return {
        "input_node": node("input_node"),
        "output_node": node("output_node"),
        "start_hz": start,
        "stop_hz": stop,
        "points": F.least(F.greatest(points, F.lit(20)), F.lit(20000)).cast("long"),
        "target_gain_db": double_or(get("target_gain_db"), DEFAULTS["target_gain_db"]),
    }


def without_fence(text: str | Column) -> Column:
    """The content of a text that is one fenced block as a whole, else the text."""
    fence = r"(?s)\A\s*```(?:python)?\s*(.*?)\s*```\s*\z"
    return F.when(F.regexp_like(text, F.lit(fence)), F.regexp_extract(text, fence, 1)).otherwise(F.col(text) if isinstance(text, str) else text)


def result_error(payload: str | Column) -> Column:
    """What is wrong with a result's JSON, or ''; the first of the checks that fails."""
    v = F.try_parse_json(payload)
    part = lambda path: F.try_variant_get(v, path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(part(path)), F.lit(""))
    status = F.try_variant_get(v, "$.status", "string")
    number = F.coalesce(F.try_variant_get(v, "$.metrics.bandwidth_hz", "double"), stripped(F.try_variant_get(v, "$.metrics.bandwidth_hz", "string")).try_cast("double"))
    number = F.when(~kind("$.metrics.bandwidth_hz").rlike("^(OBJECT|ARRAY|VOID)"), number)
    failed = [
        ~F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"),
        (kind("$.status") != "STRING") | (stripped(F.coalesce(status, F.lit(""))) == ""),
        ~kind("$.metrics").startswith("OBJECT"),
        part("$.metrics.bandwidth_hz").isNull(),
        number.isNull(),
        ~kind("$.notes").startswith("ARRAY"),
        (F.upper(stripped(status)) == "PASS") & (number <= 0),
    ]
    out = F.lit("")
    for test, error in reversed(list(zip(failed, RESULT_ERRORS, strict=True))):
        out = F.when(F.coalesce(test, F.lit(False)), error).otherwise(out)
    return out


#: What chat clients are told: how to answer with a script, and with parameters.
SCRIPT_PROMPT = (
    "You write one Python script that measures a circuit. Answer with its source only, without fences or explanations. "
    "Use the standard library, define run_test() -> dict with status, metrics and notes, and write result.json."
)
PARAMETER_PROMPT = f"You read parameters from a request. Answer with one JSON object with the keys {', '.join(DEFAULTS)}, and nothing else."


def script_request(query: str, circuit: str, kind: str, metric: str, method: str, plan: str, context: str) -> str:
    """The request for a script, with its evidence."""
    return f"Request: {query}\nCircuit: {circuit or 'not described'}\nTest: {kind}\nMetric: {metric}\nMethod: {method}\nPlan: {plan}\nEvidence:\n{context}"


def parameter_request(query: str, circuit: str, context: str) -> str:
    """The request for parameters, with its evidence."""
    return f"Request: {query}\nCircuit: {circuit or 'not described'}\nEvidence:\n{context}\nUse the defaults {DEFAULTS} for what isn't said."


SCRIPT = """import json

EVIDENCE_SOURCES = {sources!r}


def main(simulate):
    # simulate(start, stop, points) returns (frequency, gain in dB) pairs between the two nodes.
    nodes = ({input_node!r}, {output_node!r})
    sweep = list(simulate({start_hz!r}, {stop_hz!r}, {points!r}))
    limit = max(gain for _, gain in sweep) + {target_gain_db!r}
    passed = [f for f, gain in sweep if gain < limit]
    found = passed[0] if passed else 0.0
    result = {{"status": "PASS" if found > 0 else "FAIL", "metrics": {{"bandwidth_hz": found}}, "notes": list(nodes)}}
    with open("result.json", "w") as f:
        json.dump(result, f)
"""


def sweep_script(parameters: dict, sources: list[str] | None = None) -> str:
    """Source of a bandwidth measurement with the given parameters (keys of DEFAULTS) and the sources of its evidence. It is
    text and never run here."""
    return SCRIPT.format(sources=list(sources or []), **(DEFAULTS | parameters))


def retryable(message: str | Column) -> Column:
    """Whether an embedding error may pass."""
    m = F.lower(message)
    return F.exists(F.array(*[F.lit(x) for x in RETRYABLE]), lambda x: F.contains(m, x))


def batch_limit(message: str | Column) -> Column:
    """The batch size that an error message says must not be exceeded, or null."""
    return F.nullif(F.regexp_extract(message, r"(?i)not be larger than\s+(\d+)", 1), F.lit("")).try_cast("int")


def backoff(attempt: str | Column, base: float = 1.0) -> Column:
    """Seconds to wait after a failed attempt, from 1."""
    return F.lit(max(base, 0.1)) * F.pow(F.lit(2.0), (F.col(attempt) if isinstance(attempt, str) else attempt) - 1)


def request_error(query: str | Column, top_k: str | Column) -> Column:
    """What is wrong with a request, or ''."""
    k = F.coalesce(F.col(top_k) if isinstance(top_k, str) else top_k, F.lit(6))
    return F.when(F.isnull(query), "query is required").when((k < 1) | (k > 20), "top_k must be between 1 and 20").otherwise("")
