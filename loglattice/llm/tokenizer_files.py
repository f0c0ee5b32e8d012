"""Where tokenizer files are: a name in the installed collection, or a path."""

from __future__ import annotations

import os


def resolve(name: str) -> str:
    """The path of a tokenizer file; executors call this themselves, so no file is shipped."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
