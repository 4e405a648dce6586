"""Where the public vocabulary files are."""

from __future__ import annotations

import os


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """``folder`` if given, else that of the installed ``public_tokenizers`` package."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
