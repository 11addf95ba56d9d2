"""Text predicates and transformations as column expressions."""

from __future__ import annotations

import json
import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN, NO_TOKEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"

# Patterns of secrets and what they are called.
SECRETS = {
    "API key": r"(?i)(api[_-]?key|apikey)\s*[:=]\s*\S{10,}",
    "password/secret": r"(?i)(secret|password|passwd|pwd)\s*[:=]\s*\S{8,}",
    "OpenAI API key": r"sk-[a-zA-Z0-9]{20,}",
    "GitHub personal access token": r"ghp_[a-zA-Z0-9]{36}",
    "Bearer token": r"(?i)bearer\s+[a-zA-Z0-9._-]{20,}",
    "AWS access key": r"AKIA[0-9A-Z]{16}",
    "auth token": r"(?i)(token|auth)\s*[:=]\s*[a-zA-Z0-9._-]{20,}",
    "private key": r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----",
}

# Words that tell nothing, for keyword extraction.
STOP_WORDS = (
    "the", "and", "or", "but", "not", "in", "on", "at", "to", "for", "of", "is", "was", "are", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "should", "could", "may", "might", "can", "must", "a", "an", "as", "with", "from", "by", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they", "what", "which", "who", "when", "where", "why", "how",
)

# What a query is cleaned of.
XML_TAG = r"</?[a-zA-Z_][a-zA-Z0-9_:.-]*(?:\s[^>]*)?>"
FRAMING = r"(?mi)^(?:(?:Human|Assistant|System|User|AI|Claude)\s*:\s*|(?:###|##|#)\s*(?:Instructions?|Context|Query|Search|System)\s*\n)"
CODE_TICKS = r"```[a-z]*\n?|```|`{1,3}"
MAX_QUERY = 2048

CODE_FILE = r"\.(rs|ts|py|js|go|java|rb|cpp|c|h)"
CODE_RELATED = rf"/|{CODE_FILE}|[A-Z][a-z]+[A-Z]|[a-z]_[a-z]"
SESSION_QUERY = r"(?i)session|last time|previous|yesterday|earlier today"

# Fragments of field names whose values are hidden.
SENSITIVE_FIELDS = ("password", "secret", "token", "api_key", "apikey", "authorization", "credential", "private_key")


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters and digits; diacritics stay."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def fts_phrases(query: str) -> list[list[str]]:
    """A query as phrases that must all match: operator characters are blanks, inner punctuation makes a phrase of several tokens."""
    words = re.sub(r"[-*\"(){}:^+~`]", " ", query).split()
    phrases = [re.findall(r"[^\W_]+", w.lower()) for w in words]
    return [p for p in phrases if p]


def sanitize_query(c: Column) -> Column:
    """struct(text, removed, was_truncated) of a query with prompt debris taken out."""
    a = F.regexp_replace(c, XML_TAG, " ")
    b = F.regexp_replace(a, FRAMING, "")
    d = F.regexp_replace(b, CODE_TICKS, " ")
    trimmed = F.regexp_replace(d, r"^\s+|\s+$", "")
    e = F.regexp_replace(trimmed, r"\s+", " ")
    long_ = F.length(e) > MAX_QUERY
    cut = F.left(e, F.lit(MAX_QUERY))
    at = F.length(cut) - F.instr(F.reverse(cut), " ")
    f = F.when(~long_, e).when(F.contains(cut, F.lit(" ")), F.left(cut, at)).otherwise(cut)
    steps = F.array(F.when(a != c, "xml_tags"), F.when(b != a, "conversation_framing"), F.when(d != b, "markdown_noise"), F.when(e != trimmed, "whitespace_normalized"), F.when(long_, "truncated"))
    return F.struct(f.alias("text"), F.filter(steps, lambda x: x.isNotNull()).alias("removed"), long_.alias("was_truncated"))


def secret_labels(c: Column) -> Column:
    return F.filter(F.array(*[F.when(c.rlike(p), k) for k, p in SECRETS.items()]), lambda x: x.isNotNull())


def redact(c: Column) -> Column:
    hit = F.lit(False)
    for p in SECRETS.values():
        hit |= c.rlike(p)
    return F.when(hit, "[REDACTED]").otherwise(c)


def redact_fields(fields: Column) -> Column:
    """A map of strings with secret-looking values, and all values of sensitive fields, hidden."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE_FIELDS)), "[REDACTED]").otherwise(redact(v)))


_SECRET = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in SECRETS.values()))


def redacted(value):
    """A JSON value of any depth without secrets: all that a field of a sensitive name holds, and strings that look like one."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if any(f in k.lower() for f in SENSITIVE_FIELDS) else redacted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v) for v in value]
    return "[REDACTED]" if isinstance(value, str) and _SECRET.search(value) else value


def _redact_texts(texts: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(redacted(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return "[REDACTED]" if _SECRET.search(t) else t

    return texts.map(one)


def redact_json(c: Column) -> Column:
    """JSON texts with secrets hidden at any depth; what isn't JSON is hidden as a text would be. A walk over values of unknown depth has no column expression, so it runs in Arrow batches."""
    return F.pandas_udf(_redact_texts, "string")(c)


def code_related(c: Column) -> Column:
    return c.rlike(CODE_RELATED)


def session_query(c: Column) -> Column:
    return c.rlike(SESSION_QUERY)


def extract_keywords(c: Column) -> Column:
    words = F.transform(F.split(c, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) > 3) & ~w.isin(*STOP_WORDS))))


def source_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "markdown", "mdx"), "markdown").when(ext.isin("rs", "py", "js", "ts", "tsx", "jsx", "go", "java", "c", "cpp", "h", "hpp", "rb"), "code").otherwise("text")


def skipped_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(\.[^/]+|target|node_modules)(/|$)")


def snippet(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def dedupe_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 12)


def code_terms(query: str, most: int = 8) -> list[str]:
    """Names of code in a query: any part of what has a slash or colon, and words in camel or snake case; file endings are left off."""
    found = []
    for word in query.split():
        path = "/" in word or ":" in word
        for piece in re.findall(r"[^/:]+", word):
            bare = piece.strip(string.punctuation.replace("_", ""))
            stem = re.sub(r"\.[A-Za-z0-9]+$", "", bare)
            cased = re.search(r"[A-Z][a-z]+[A-Z]|[a-z]_[a-z]", bare)
            found += [stem] * (stem != bare) + [bare] * bool(path or cased)
    return [x for x in dict.fromkeys(found) if 0 < len(x) <= 64][:most]


def fragments(name: str, most: int = 5) -> list[str]:
    """Telling parts of a camel or snake name."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+", name)
    out: list[str] = []
    for p in parts:
        least = 2 if p.isupper() else 3
        low = p.lower()
        if len(low) >= least and low not in ("service", "manager", "controller", "handler", "impl") and low not in out:
            out.append(low)
    return out[:most]


def answer_passes(answer: Column, keywords: list[str], least: int) -> Column:
    """Whether an answer holds at least so many of the expected keywords."""
    return answer_score(answer, keywords) >= least


def answer_score(answer: Column, keywords: list[str]) -> Column:
    """How many of the expected keywords an answer holds, case aside."""
    return sum((F.contains(F.lower(answer), F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
