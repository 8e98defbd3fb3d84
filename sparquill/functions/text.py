"""Text functions as Column expressions: tokens, ids, estimates, redaction, injection signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores, and single Chinese characters (extensions A and B too), of lower-cased text.
TOKEN = "[a-z0-9_]+|[㐀-䶿一-鿿𠀀-𪛟]"

# fixed values: words that carry no search value in English and code
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must can shall of in on at to for with by from as "
    "into about over after under between through find show explain describe what how why when where who which that this these those and or but not no nor "
    "so if then me my we our you your he she it its they them their there here section content purpose definition implementation code method function "
    "class use used using get set return returns"
).split()

# fixed values: a credential's name and separator are kept, its value is replaced
CREDENTIALS = (
    (r"(?i)((?:api[_-]?key|token|secret)\s*[:=]\s*['\"]?)[A-Za-z0-9_\-]{16,}", "<api-key>"),
    (r"(?i)((?:password|passwd|pwd)\s*[:=]\s*['\"]?)[^\s'\"]{4,}", "<password>"),
    (r"(?i)((?:bearer|authorization)\s*[:=]\s*['\"]?)[A-Za-z0-9_\-.]{20,}", "<token>"),
)

# fixed values: signs of an attempt to steer a model, by name
HIGH_RISK = {
    "chat_delimiter_escape": r"(?i)<\|im_(?:start|end)\|>|<\|(?:system|user|assistant)\|>",
    "delimiter_escape": r"(?i)\]\]>|</prompt>|</system>|###\s*(?:system|instruction)",
    "role_hijack": r"(?i)ignore (?:all |any )?(?:previous|prior|above|earlier) (?:instructions?|prompts?|rules?)",
    "role_hijack_zh": r"忽略(?:之前|以上|先前|所有)的?(?:指令|提示|规则|要求)",
    "identity_override": r"(?i)you are now\b|act as (?:a |an )?(?:shell|admin|root)\b|你现在是|扮演(?:管理员|root)",
    "prompt_disclosure": r"(?i)(?:reveal|show|print|output).{0,40}(?:system|internal) prompt|泄露|输出.{0,12}(?:系统|内部)(?:提示|指令)",
    "tool_call_manipulation": r"(?i)(?:call|invoke|run) the (?:tool|function) [a-z_]+|调用工具\s*[a-z_]+",
    "user_concealment": r"(?i)do not (?:tell|inform|show) the user|不要告诉用户|瞒着用户",
}
LOW_RISK = {
    "suspicious_base64": r"(?i)\bbase64[:\s]",
    "jailbreak_marker": r"(?i)\bDAN mode\b|\bdeveloper mode\b|越狱模式",
}


def tokens(text: Column) -> Column:
    """Array of tokens without stop words; null for null text."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: ~F.array_contains(stop, t))


def term_id(term: Column) -> Column:
    """The first four bytes of the term's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("bigint")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def words_estimate(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def chars_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def excerpt(text: Column, size: int = 500) -> Column:
    return F.substring(text, 1, size)


def redact(text: Column) -> Column:
    for pattern, placeholder in CREDENTIALS:
        text = F.regexp_replace(text, pattern, "$1" + placeholder)
    return text


def injection_signs(text: Column) -> Column:
    """Struct of matched (names of signs), risk (high, low or none) and suspicious."""
    named = lambda rules: F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules.items())))
    high, low = named(HIGH_RISK), named(LOW_RISK)
    risk = F.when(F.size(high) > 0, "high").when(F.size(low) > 0, "low").otherwise("none")
    return F.struct(F.concat(high, low).alias("matched"), risk.alias("risk"), (risk != "none").alias("suspicious"))


def clamp01(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))))
