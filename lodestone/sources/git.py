"""The few facts a snapshot takes from git, on the driver; None where there is no repository."""

from __future__ import annotations

import subprocess


def _said(root: str, *words: str) -> str | None:
    try:
        got = subprocess.run(["git", *words], cwd=root, capture_output=True, check=False, text=True)
    except OSError:
        return None
    return got.stdout.strip() or None if got.returncode == 0 else None


def head(root: str) -> str | None:
    return _said(root, "rev-parse", "HEAD")


def commits_since(root: str, commit: str) -> int | None:
    n = _said(root, "rev-list", "--count", f"{commit}..HEAD")
    return int(n) if n and n.isdigit() else None
