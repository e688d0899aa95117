"""Where tokenizer files lie. The path is always a parameter of the operators; this is the queries' default."""

from __future__ import annotations


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_pattern() -> str:
    """The pre-tokenizer of the ranked byte-level files."""
    import public_tokenizers

    return public_tokenizers.PATTERN
