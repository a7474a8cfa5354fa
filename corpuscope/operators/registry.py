"""X-1 / X-2: available analyzers by name, built from plugin-style settings."""

from __future__ import annotations

from typing import Mapping, Sequence

from corpuscope.operators.scan import (
    DANGEROUS_CALLS,
    DefinitionCountRule,
    EntropyRule,
    FileLengthRule,
    LineRulesRule,
    Rule,
    SecretPatternRule,
    TaintRule,
)

RULES: dict[str, type[Rule]] = {
    "file-length": FileLengthRule,
    "definition-count": DefinitionCountRule,
    "taint": TaintRule,
    "secret-patterns": SecretPatternRule,
    "secret-entropy": EntropyRule,
    "line-rules": LineRulesRule,
}


def describe() -> list[tuple[str, str]]:
    """(name, description) of every available rule."""
    return [(n, r.description) for n, r in RULES.items()]


def build_rules(enabled: Sequence[str], settings: Mapping[str, Mapping[str, object]] | None = None) -> list[Rule]:
    """Instantiate the enabled rules with their keyword settings (e.g. ``{"secret-entropy":
    {"threshold": 4.0}}``). Unknown names raise ``KeyError`` listing what exists."""
    settings = settings or {}
    out = []
    for name in enabled:
        if name not in RULES:
            raise KeyError(f"unknown rule {name!r}; available: {sorted(RULES)}")
        kw = dict(settings.get(name, {}))
        if name == "line-rules" and "rules" not in kw:
            kw["rules"] = list(DANGEROUS_CALLS)
        out.append(RULES[name](**kw))
    return out
