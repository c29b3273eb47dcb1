"""What a failed call to a provider most likely means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In order: kind, whether case is ignored, and alternatives of which each is a list of strings that must all occur.
KINDS = (
    ("timeout", True, (("timed out",), ("timeout",))),
    ("unreachable", False, (("Connection refused",), ("Ensure Ollama is running",))),
    ("missing_model", False, (("model", "not found"),)),
    ("quota", False, (("insufficient_quota",), ("exceeded your current quota",))),
    ("no_access", False, (("model_not_found",), ("does not exist",))),
    ("bad_key", False, (("invalid_api_key",), ("Incorrect API key",))),
)
OTHER = "other"


def kind(message: Column) -> Column:
    out = F.lit(OTHER)
    for name, any_case, ways in reversed(KINDS):
        text = F.lower(message) if any_case else message
        hit = F.lit(False)
        for way in ways:
            every = F.lit(True)
            for part in way:
                every = every & F.contains(text, F.lit(part))
            hit = hit | every
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def kind_of(message: str) -> str:
    for name, any_case, ways in KINDS:
        text = message.lower() if any_case else message
        if any(all(part in text for part in way) for way in ways):
            return name
    return OTHER


def advice(message: str, provider: str, model: str) -> str:
    """One line that says what happened, and one that says what to do."""
    name = provider.upper()
    return {
        "timeout": f"{name} took too long and the call timed out.\n  Try a smaller or faster model, more hardware, or a budget.",
        "unreachable": "Nothing answers at the configured Ollama address.\n  Start the Ollama server and try again.",
        "missing_model": f"The model '{model}' was not found on the Ollama server.\n  Fetch it with: ollama pull {model}",
        "quota": f"The {name} account has used up its quota.\n  Look at the plan and the billing details.",
        "no_access": f"{name} has no model '{model}', or this key may not use it.\n  Choose another with the init command.",
        "bad_key": f"{name} does not accept the API key; it is invalid.\n  Set a new one with the init command.",
    }.get(kind_of(message), f"The call to {name} failed: {message}")
