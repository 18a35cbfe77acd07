"""Declarations of a source text and how they nest, told by the first line and the indentation.

There is no grammar: a declaration is a line that begins with modifiers, a keyword and a name; it reaches to the last
line before one that is indented less, or no further and closes nothing.
"""

from __future__ import annotations

import re

_MODIFIERS = r"(?:(?:pub(?:\([\w ]+\))?|public|private|protected|internal|static|final|abstract|async|export|default|override|suspend|open|local|inline|const|unsafe|sealed|data|readonly|synchronized|partial|virtual|extern)\s+)*"
#: Modifiers, a keyword (with type parameters or a receiver) and a name.
DECLARATION = r"^\s*" + _MODIFIERS + r"(fn|def|function\*?|func|fun|proc|class|struct|interface|trait|enum|impl|module|namespace|type|object|record|union|protocol)(?:\s*<[^>]*>)?\s+(?:\([^)]*\)\s*)?(?:self\.)?([A-Za-z_][A-Za-z0-9_]*)"
#: A method without a keyword: at least one modifier, perhaps a type, a name and a bracket; the line ends no statement.
METHOD = r"^\s+(?:(?:public|private|protected|internal|static|final|abstract|async|override|synchronized|virtual)\s+)+(?:[A-Za-z_][\w<>,.?\[\]]*\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*$"
# Kinds of keywords that are called otherwise.
KINDS = {"fn": "function", "def": "function", "function": "function", "function*": "function", "func": "function", "fun": "function", "proc": "function", "impl": "implementation", "namespace": "module"}
#: A line that closes a block above it, or opens the one its declaration began.
CLOSER = r"^\s*(?:[)}\]{]|end\b)"

_DECLARATION, _METHOD, _CLOSER, _SOMETHING = (re.compile(p, re.A) for p in (DECLARATION, METHOD, CLOSER, r"\S"))


def declared(line: str) -> tuple[str, str] | None:
    """(kind, name) of what a line declares."""
    if m := _DECLARATION.match(line):
        return KINDS.get(m[1], m[1]), m[2]
    if m := _METHOD.match(line):
        return "method", m[1]
    return None


def outline(text: str) -> list[tuple[str, str, int, int, list[tuple[str, str, int, int]]]]:
    """(kind, name, first line, last line, declarations around it from the outermost in: (name, kind, first, last)) in order."""
    pieces = text.split("\n")
    if pieces and pieces[-1] == "":
        pieces.pop()
    out: list[list] = []
    open_: list[tuple[int, int]] = []  # (indentation, place in out)
    last = 0
    for number, line in enumerate(pieces, 1):
        line = line[:-1] if line.endswith("\r") else line
        if not _SOMETHING.search(line):
            continue
        bare = line.lstrip(" \t")
        indent = len(line) - len(bare)
        closes = bool(_CLOSER.match(line))
        while open_ and (open_[-1][0] > indent or (open_[-1][0] == indent and not closes)):
            out[open_.pop()[1]][3] = last
        if found := declared(line):
            out.append([*found, number, 0, [at for _, at in open_]])
            open_.append((indent, len(out) - 1))
        last = number
    for _, at in open_:
        out[at][3] = last
    return [(kind, name, first, end, [(out[i][1], out[i][0], out[i][2], out[i][3]) for i in around]) for kind, name, first, end, around in out]
