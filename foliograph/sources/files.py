"""File patterns to ordered lists of files, and writing one file safely.

This runs where the job is started, on a local or mounted file system; data itself is
read by Spark.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from pathlib import Path

from ..functions.text import closest
from ..operators.ranges import parse_range


def natural_parts(name: str) -> tuple:
    """A key for sorted(): digit runs by value, then by length; A-Z without case."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), name)
    parts = re.findall(r"[0-9]+|[^0-9]", low)
    return tuple(("0", int(p), len(p)) if "0" <= p[0] <= "9" else (p, 0, 0) for p in parts), name


def _hidden(name: str) -> bool:
    return name.startswith(".")


def _listed(folder: Path, recursive: bool) -> list[Path]:
    try:
        entries = sorted(folder.iterdir(), key=lambda p: natural_parts(p.name))
    except PermissionError:
        return []
    out = [p for p in entries if p.is_file()]
    for p in entries:
        if recursive and p.is_dir() and not _hidden(p.name):
            out.extend(_listed(p, True))
    return out


def _matched(folder: Path, parts: list[str]) -> list[Path]:
    """Paths under folder that fit a pattern's parts; ** is any number of folders."""
    if not parts:
        return [folder]
    head, rest = parts[0], parts[1:]
    if head == "**":
        out = _matched(folder, rest)
        for p in sorted(folder.iterdir() if folder.is_dir() else [], key=lambda p: natural_parts(p.name)):
            if p.is_dir() and not _hidden(p.name):
                out.extend(_matched(p, parts))
        return out
    if not re.search(r"[*?\[]", head):
        return _matched(folder / head, rest) if (folder / head).exists() else []
    found = sorted((p for p in (folder.iterdir() if folder.is_dir() else []) if p.match(head)), key=lambda p: natural_parts(p.name))
    return [x for p in found if not rest or p.is_dir() for x in _matched(p, rest)]


def expand(patterns: list[str], accept: Callable[[str], bool] = lambda name: True, recursive: bool = False) -> tuple[list[str], list[str]]:
    """(files, problems): arguments in order, each in natural order, no file twice.

    A file named as it is isn't filtered by accept; folders give their files, and
    hidden subfolders are skipped. An argument that gives nothing is a problem, with a
    near name as a hint.
    """
    out: dict[str, str] = {}
    problems = []
    for pattern in patterns:
        path = Path(pattern)
        if not pattern:
            problems.append("an empty pattern")
            continue
        if path.is_file():
            found = [path]
        elif path.is_dir():
            found = [p for p in _listed(path, recursive) if accept(p.name)]
        elif re.search(r"[*?\[]", pattern):
            base = Path(path.anchor) if path.anchor else Path()
            hits = _matched(base, [p for p in path.parts if p != path.anchor])
            found = [q for p in hits for q in ([p] if p.is_file() else _listed(p, True) if recursive else []) if accept(q.name)]
        else:
            names = [p.name for p in _listed(path.parent, False)] if path.parent.is_dir() else []
            near = closest(path.name, names)
            problems.append(f"{pattern} does not exist" + (f"; is it {near}?" if near else ""))
            continue
        if not found:
            problems.append(f"{pattern} matches nothing")
        for p in found:
            out.setdefault(os.path.normcase(os.path.abspath(p)), str(p))
    return list(out.values()), problems


def shown(path: str) -> str:
    """A path as it is told: from the current folder on if it lies in it, else whole."""
    if path == "-":
        return "(standard input)"
    whole, here = os.path.abspath(path), os.getcwd()
    inside = os.path.commonpath([whole, here]) == here if os.path.splitdrive(whole)[0] == os.path.splitdrive(here)[0] else False
    return os.path.relpath(whole, here) if inside else whole


def with_extension(path: str, ending: str) -> str:
    """The path with what follows the last dot of its name replaced; ending has its dot."""
    name = re.search(r"[^/]*$", path)[0]
    return path[: len(path) - len(name)] + re.sub(r"\.[^.]*$", "", name) + ending


def split_spec(argument: str) -> tuple[str, str]:
    """(pattern, selection) of file@selection, cut at the last @; an existing file, and
    what isn't a selection, stays whole."""
    pattern, at, spec = argument.rpartition("@")
    if not at or not pattern or os.path.exists(argument):
        return argument, ""
    try:
        parse_range(spec)
    except ValueError:
        return argument, ""
    return pattern, spec


def check_output(path: str, inputs: list[str], force: bool = False, suffix: str = ".pdf") -> None:
    """Raise before anything is read if the output has a wrong name, is an input or exists."""
    if not path.lower().endswith(suffix):
        raise ValueError(f"the output must end in {suffix}")
    if any(os.path.exists(path) and os.path.exists(i) and os.path.samefile(path, i) for i in inputs):
        raise ValueError("the output is one of the inputs")
    if os.path.exists(path) and not force:
        raise FileExistsError(path)


def write_atomic(path: str, data: bytes, tries: int = 5, wait: float = 0.04) -> None:
    """Write beside the target and rename over it, trying again while it is busy."""
    temp = f"{path}.{os.getpid()}.part"
    try:
        with open(temp, "wb") as f:
            f.write(data)
        for k in range(tries):
            try:
                os.replace(temp, path)
                return
            except PermissionError:
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
    finally:
        if os.path.exists(temp):
            os.remove(temp)
