"""A labelling service with known failures, for queries and tests."""

from __future__ import annotations

import json

import pandas as pd


def _said(request: str, n: int) -> tuple[str, str]:
    """Content and error of one answer; the checks' SQL states the same rules."""
    size, low = len(request), request.lower()
    if size % 11 == 0:
        return "", "model rejection"
    if size % 7 == 0:
        return "", "timeout"
    if size % 3 == 0 and n == 1 or size % 13 == 0 and n <= 2:
        return "", "API error: 429"
    if request.startswith("Does this site offer the niche"):
        label = request.split('"')[1] if "rings" in low else "Other"
    else:
        label = "Jewelry" if "rings" in low else "Fashion" if "shoes" in low else "Other"
    return json.dumps({"vertical": label, "confidence": (5 + size % 5) / 10, "reason": f"attempt {n}"}), ""


def flaky():
    """Answers about rings and shoes; fails for good, for a while or not at all,
    depending on the length of the question."""
    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        said = [_said(r, n) for r, n in zip(batch["request"], batch["n"], strict=True)]
        return pd.DataFrame(said, columns=["content", "error"])
    return answer
