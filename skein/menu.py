"""A menu over the command line, for people who would rather answer questions: python -m skein.menu"""

from __future__ import annotations

import sys
from collections.abc import Callable

from skein import cli

#: What can be chosen: a key, what it does, and the options that do it.
CHOICES = {
    "a": ("export every session", ["--all"]),
    "p": ("export the sessions of one project", ["--project"]),
    "l": ("list projects", ["--list"]),
    "s": ("list sessions", ["--list-sessions"]),
    "d": ("see which logs need attention", ["--diagnose"]),
    "h": ("see all options of the command line", ["--help"]),
    "q": ("leave", []),
}


def arguments(key: str, ask: Callable[[str], str]) -> list[str] | None:
    """The command line for a choice, after the questions that it needs; None if one is left without the answer it needs."""
    argv = list(CHOICES[key][1])
    if key == "p":
        name = ask("Name or path of the project: ").strip()
        if not name:
            return None
        argv.append(name)
    if key in "ap":
        if folder := ask("Folder to write to (empty: a new one here): ").strip():
            argv += ["--out", folder]
        if ask("Copy the logs themselves too? [Y/n] ").strip().lower().startswith("n"):
            argv.append("--no-raw")
    return argv


def run(ask: Callable[[str], str] = input, do: Callable[[list[str]], int] = cli.main) -> int:
    """Ask and do until someone leaves; returns the last command's code."""
    code = 0
    while True:
        print("\n".join(f"  {key}  {what}" for key, (what, _) in CHOICES.items()))
        try:
            key = ask("> ").strip().lower()[:1]
            if key == "q":
                return code
            if key in CHOICES and (argv := arguments(key, ask)) is not None:
                code = do(argv)
        except EOFError:
            return code


if __name__ == "__main__":
    sys.exit(run())
