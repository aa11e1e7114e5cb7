"""What can go wrong, by code, with hints."""

from __future__ import annotations

HINTS = {
    "NO_SESSIONS": ["No local session files may have been written yet.", "Another home folder may be in use: point --home, --sessions-dir or --archived-dir at it."],
    "NO_SELECTION": ["Choose --all, --project NAME, --list, --list-sessions or --diagnose."],
    "NO_PROJECT_MATCH": ["See --list for the folders that sessions name.", "The folder's name may differ from the one that was recorded."],
    "OUTPUT_IN_TOOL_DIR": ["Exports hold private chats; write them outside this program's folder.", "--allow-output-in-tool-dir turns this check off."],
    "EXPORT_VERIFICATION_FAILED": ["The output folder may be restricted or unreliable; try a short path elsewhere."],
}


class SkeinError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def with_hints(error: Exception) -> str:
    return "\n".join([f"Export failed: {error}", *(f"- {h}" for h in HINTS.get(getattr(error, "code", ""), []))])
