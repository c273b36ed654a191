"""What an empty or reduced answer means, in a sentence, so that it is not read as a clean project."""

from __future__ import annotations


def window_note(since: str) -> str:
    return f"The window from {since} holds no commits; take a wider one, or the whole history."


def history_note(has_repository: bool, has_commits: bool) -> str | None:
    """Why there is no history to count, None if there is."""
    if not has_repository:
        return "This is no git repository, or git is missing, so nothing is known of its changes."
    return None if has_commits else "The repository has no commits yet, so nothing is known of its changes."


def refactor_note(lens: str, rows: int, min_risk: float, has_repository: bool, has_commits: bool, empty_window: str | None = None) -> str | None:
    """A note on priorities by lens fused, behavioral or structural; None where the answer stands for itself."""
    if lens not in ("fused", "behavioral", "structural"):
        raise ValueError("lens is fused, behavioral or structural")
    missing = history_note(has_repository, has_commits)
    above = f"no module is both central and unstable above a risk of {min_risk}; a lower bound shows more"
    if lens == "structural":
        return None if rows else above[0].upper() + above[1:] + "."
    if rows:
        return f"{missing} The ranking is by structure alone." if lens == "fused" and missing else None
    if missing:
        return f"{missing} " + ("Only structure was judged: " + above + "." if lens == "fused" else "Ask for the structural lens, which needs none.")
    if empty_window:
        return window_note(empty_window)
    return "No file is both complex and often changed" + (", and " + above + "." if lens == "fused" else ".")
