"""Checks of user queries, as ordered rules over a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Personal data, by kind, in the order they are tried.
PII = (
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit card", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"),
)
#: Attempts to override instructions.
INJECTION = (
    r"(?i)ignore\s+(all|any|the)?\s*(previous|prior|above)\s+instructions",
    r"(?i)disregard\s+(all|any|the)?\s*(previous|prior|above)",
    r"(?i)\byou\s+are\s+now\b",
    r"(?i)system\s*prompt",
    r"(?i)reveal\s+(your|the)\s+(system\s+)?prompt",
    r"\bDAN\b",
    r"(?i)\bjailbreak\b",
    r"(?i)</?(system|assistant|user)>",
    r"(?i)\bnew\s+instructions\b",
    r"(?i)act\s+as\s+(an?|the)\b.{0,40}\b(unfiltered|uncensored|no\s+restrictions)",
)
#: Disallowed terms.
HARMFUL = ("bomb", "weapon", "murder", "kill someone", "suicide", "self-harm", "self harm", "hate speech", "racial slur", "how to hack", "credit card fraud", "launder money")
#: Terms of which an allowed query has one.
DOMAIN = (
    "revenue", "margin", "earnings", "guidance", "growth", "quarter", "fiscal", "eps", "profit", "income", "segment", "forecast",
    "outlook", "sentiment", "claim", "filing", "10-q", "10-k", "10q", "10k", "transcript", "call", "cost", "expense", "cash flow",
    "operating", "gross", "net", "yoy", "qoq", "compare", "verify", "summar", "risk", "capex", "spend", "backlog", "demand",
    "management", "executive", "management's discussion", "mda", "balance sheet", "leadership", "ceo", "cfo", "investor",
    "shareholder", "stock", "share", "investment", "invest", "ai ", " ai", "artificial intelligence", "infrastructure", "data center",
    "datacenter", "chip", "semiconductor", "supply chain", "customer", "subscriber", "competition", "competitor", "market share",
    "buyback", "dividend", "headcount", "hiring", "layoff", "product", "launch", "pricing", "price", "tariff", "regulation", "macro",
    "cloud", "platform", "engagement", "advertising", "monetiz", "retention", "capacity", "utilization", "r&d",
    "research and development", "partnership", "acquisition", "strategy", "strategic", "priorit", "business", "company", "plan",
    "user", "users", "app", "apps", "daily active", "monthly active", "dau", "mau", "dap", "active people", "install", "downloads",
)
#: Words of questions that need reasoning, and of those that look up a fact.
PRIMARY = r"(?i)\b(compare|shift|changed?|contradict|summar\w+|analys\w+|analyze|explain|why|how did|what caused|guidance|outlook|risk)\b"
STANDARD = r"(?i)\b(what was|what is|how much|how many|when did|when was|who is|who was|list|state the|tell me the|what were|what did)\b"


def any_of(terms: tuple[str, ...]) -> str:
    return "|".join(t.replace(".", r"\.") for t in terms)


def violation(query: Column) -> Column:
    """Category of the first violation: pii, prompt_injection, harmful_content or off_topic; null for an allowed query."""
    lowered = F.lower(query)
    out = F.when(~lowered.rlike(any_of(DOMAIN)), "off_topic")
    out = F.when(lowered.rlike(any_of(HARMFUL)), "harmful_content").otherwise(out)
    out = F.when(query.rlike("|".join(f"(?:{p})" for p in INJECTION)), "prompt_injection").otherwise(out)
    return F.when(query.rlike("|".join(p for _, p in PII)), "pii").otherwise(out)


def reason(query: Column) -> Column:
    """Why a query is not allowed; null for an allowed one."""
    lowered = F.lower(query)
    pii = F.lit(None).cast("string")
    for kind, pattern in reversed(PII):
        pii = F.when(query.rlike(pattern), f"it holds a {kind}").otherwise(pii)
    term = F.get(F.filter(F.array(*[F.lit(t) for t in HARMFUL]), lambda t: F.contains(lowered, t)), F.lit(0))
    category = violation(query)
    return (
        F.when(category == "pii", pii)
        .when(category == "prompt_injection", "it overrides instructions")
        .when(category == "harmful_content", F.concat(F.lit("it has a disallowed term: "), term))
        .when(category == "off_topic", "it is not about earnings")
    )


def query_tier(query: Column) -> Column:
    """``primary`` for reasoning, blank and unclear queries, ``standard`` for look-ups."""
    return F.when(F.coalesce(F.trim(query), F.lit("")) == "", "primary").when(query.rlike(PRIMARY), "primary").when(query.rlike(STANDARD), "standard").otherwise("primary")
