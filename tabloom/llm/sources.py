"""Files of public tokenizers."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Content of a tokenizer's file, read on the driver and sent along with the tasks that need it."""
    path = Path(folder, name) if folder else Path(public_tokenizers.path(name))
    return path.read_text(encoding="utf-8")
